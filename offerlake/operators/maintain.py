"""Maintenance: purges, category updates, key re-derivation and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from offerlake.functions import rules
from offerlake.sources.scratch import stored

from .schedule import reset

#: Categories that are refined by the title.
GENERIC = ("Accessories", "CPU", "GPU", "RAM", "SSD", "PSU")


def purge(products: DataFrame, dependants: dict[str, DataFrame], doomed: Column) -> dict[str, DataFrame]:
    """products and their dependants (product_id) without the rows of doomed products; null is not doomed."""
    gone = products.filter(doomed).select(F.col("id").alias("product_id"))
    left = {k: d.join(gone, "product_id", "left_anti") for k, d in dependants.items()}
    return {"products": products.filter(~F.coalesce(doomed, F.lit(False))), **left}


@dataclass(frozen=True)
class Reference:
    """Rows of child name a row of parent: child.column is one of parent.key, which names a parent row."""

    child: str
    column: str
    parent: str
    key: str


def _ordered(references: list[Reference], start: str) -> list[str]:
    """Relations that hang on start, each after all that it hangs on itself; start first."""
    below, todo = {start}, [start]
    while todo:
        at = todo.pop()
        new = {r.child for r in references if r.parent == at} - below
        below |= new
        todo += new
    order: list[str] = []
    while len(order) < len(below):
        ready = sorted(x for x in below - set(order) if all(r.parent in order or r.parent not in below for r in references if r.child == x))
        if not ready:
            raise ValueError(f"references go in a circle: {sorted(below - set(order))}")
        order += ready
    return order


def cascade(relations: dict[str, DataFrame], references: list[Reference], start: str, doomed: Column) -> dict[str, DataFrame]:
    """relations without the doomed rows of start, the rows that name one of them, the rows that name one of those, and so on.

    The keys that go are stored once for each parent that rows hang on and read by all of its children; null
    names nothing, and a null condition dooms nothing. Relations that do not hang on start stay as they are.
    """
    gone: dict[tuple[str, str], DataFrame] = {}
    left = dict(relations)
    for name in _ordered(references, start):
        rows = relations[name]
        ways = [(r.column, gone[r.parent, r.key]) for r in references if r.child == name and (r.parent, r.key) in gone]
        hits = [rows.join(keys.withColumnRenamed("key", column), column, "left_semi") for column, keys in ways]
        if name == start:
            left[name] = rows.filter(~F.coalesce(doomed, F.lit(False)))
            hits.append(rows.filter(doomed))
        for column, keys in ways:
            left[name] = left[name].join(keys.withColumnRenamed("key", column), column, "left_anti")
        left[name] = left[name].select(*rows.columns)
        for key in sorted({r.key for r in references if r.parent == name}):
            keys = [h.select(F.col(key).alias("key")) for h in hits]
            gone[name, key] = stored(reduce(DataFrame.union, keys).filter("key is not null").distinct(), "doomed-keys")
    return left


#: What hangs on products: snapshots, links and the nine specification tables.
PRODUCT_REFERENCES = [Reference(child, "product_id", "products", "id") for child in ("history", "links", *rules.SPECS)]


def hanging(rows: DataFrame, reference: Reference, parents: DataFrame) -> DataFrame:
    """Rows of the child whose parent is not there."""
    return rows.filter(F.col(reference.column).isNotNull()).join(parents.select(F.col(reference.key).alias(reference.column)), reference.column, "left_anti")


def category_of_targets(products: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """products with the category of their last categorized target, the old one where there is none."""
    known = targets.filter("category is not null").select(F.col("id").alias("target_id"), F.col("category").alias("target_category"))
    last = links.join(known, "target_id").groupBy("product_id").agg(F.max_by("target_category", "target_id").alias("target_category"))
    out = products.join(last, products["id"] == last["product_id"], "left")
    return out.withColumn("category", F.coalesce("target_category", "category")).drop("product_id", "target_category")


def merge_keys(products: DataFrame, new_pid: Column) -> DataFrame:
    """(id, pid, master): the row that keeps each re-derived key: the one that has it already, else the smallest id."""
    keyed = products.select("id", "sid", F.col("pid").alias("old"), new_pid.alias("new"))
    owner = keyed.groupBy("sid", "new").agg(F.min_by("id", F.struct(F.when(F.col("old") == F.col("new"), 0).otherwise(1), "id")).alias("master"))
    return keyed.join(owner, ["sid", "new"]).select("id", F.col("new").alias("pid"), "master")


def merge(products: DataFrame, history: DataFrame, links: DataFrame, new_pid: Column) -> dict[str, DataFrame]:
    """products, history and links after the keys are re-derived: merged rows go, and what hung on them hangs on the row that stays.

    Links that the row which stays has already are not made twice.
    """
    owner = stored(merge_keys(products, new_pid), "key-owners")  # all three relations read it
    stay = products.join(owner.filter("id = master").select("id", F.col("pid").alias("_pid")), "id").withColumn("pid", F.col("_pid")).drop("_pid")
    moved = owner.select(F.col("id").alias("product_id"), "master")
    to = lambda df: df.join(moved, "product_id").withColumn("product_id", F.col("master")).drop("master").select(*df.columns)
    return {"products": stay, "history": to(history), "links": to(links).distinct()}


def purge_store(products: DataFrame, dependants: dict[str, DataFrame], targets: DataFrame, store_id: int, as_of: Column) -> dict[str, DataFrame]:
    """Everything without the products of one shop, and its targets reset to run at once."""
    return {**purge(products, dependants, F.col("sid") == store_id), "targets": reset(targets, store_id, as_of)}


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of child (product_id) whose product is not there."""
    return child.join(parent.select(F.col("id").alias("product_id")), "product_id", "left_anti")


def match_report(scraped: DataFrame, products: DataFrame) -> DataFrame:
    """Scraped keys with the product they meet; matched is false where there is none."""
    p = products.select("sid", "pid", "id")
    return scraped.select("sid", "pid").distinct().join(p, ["sid", "pid"], "left").withColumn("matched", F.col("id").isNotNull())


def reclassify(products: DataFrame, category: str, by_title: Column) -> DataFrame:
    """products with generic categories refined by the title; the others stay."""
    return products.withColumn(category, F.when(F.col(category).isin(*GENERIC), by_title).otherwise(F.col(category)))


def reassign(products: DataFrame, scraped: DataFrame, category: str) -> DataFrame:
    """products with this category where their key was scraped."""
    keys = scraped.select("sid", "pid").distinct().withColumn("_hit", F.lit(True))
    return products.join(keys, ["sid", "pid"], "left").withColumn("category", F.when(F.col("_hit"), category).otherwise(F.col("category"))).drop("_hit")
