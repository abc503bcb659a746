"""Normalization of a catalogue: category, normalizer and typed specifications of every product."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerlake.functions import rules
from offerlake.sources.scratch import stored

from .builder import staged
from .ingest import upsert_specs


def classified(products: DataFrame) -> DataFrame:
    """products with coded, the coarse category of name, raw category and url, and granular, that of the title."""
    text = F.concat_ws(" ", "name", F.coalesce("category", F.lit("")), F.coalesce("product_url", F.lit("")))
    df = staged(products, t=F.lower(text), c=F.lit(rules.OTHER))
    df = staged(df, coded=rules.column(rules.category_sql())).drop("t")
    df = staged(df, t=F.lower("name"))
    return staged(df, granular=rules.column(rules.title_sql())).drop("t", "c")


def spec_text():
    """What specifications are read from: the title and the raw ones; a product without any has an empty object."""
    return F.lower(F.concat_ws(" ", "name", F.coalesce("specifications", F.lit("{}"))))


def normalized(products: DataFrame, granular: bool = False) -> DataFrame:
    """(id, category, kind, spec): the category, the normalizer that takes it and a struct for each normalizer, null but for its own.

    By the coarse category, as coded in the original system, motherboards, memory, supplies and
    drives are never reached; granular reads them by the title's category, as meant.
    """
    df = classified(products).withColumn("category", F.col("granular" if granular else "coded"))
    df = staged(df, kind=rules.kind_of(F.col("category"), granular), t=spec_text())
    specs = {k: F.when(F.col("kind") == k, F.struct(*[rules.column(e).alias(c) for c, e in columns.items()])) for k, columns in rules.SPECS.items()}
    return df.select("id", "category", "kind", *[s.alias(k) for k, s in specs.items()])


def spec_tables(found: DataFrame) -> dict[str, DataFrame]:
    """The typed rows of each normalizer: product_id and its columns.

    The catalogue is classified and written once, in folders by kind; each table reads its own folder.
    """
    rows = found.filter("kind is not null").select("kind", F.col("id").alias("product_id"), *rules.SPECS)
    once = stored(rows, "specifications", "kind")
    return {k: once.filter(F.col("kind") == k).select("product_id", f"{k}.*") for k in rules.SPECS}


def upsert(products: DataFrame, state: dict[str, DataFrame], granular: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """products with their new category, and each specification table after the normalized rows are taken in."""
    found = stored(normalized(products, granular), "normalized")
    tables = {k: upsert_specs(state[k], rows, list(rules.SPECS[k])) if k in state else rows for k, rows in spec_tables(found).items()}
    return products.drop("category").join(found.select("id", "category"), "id"), tables
