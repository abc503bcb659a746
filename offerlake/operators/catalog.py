"""Catalogue reads: search, pages, lists of targets, price comparison and history."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F


def active(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("active").eqNullSafe(True))


def search(products: DataFrame, q: str = "", sid: int | None = None, in_stock: bool | None = None, least: Decimal | None = None, most: Decimal | None = None) -> DataFrame:
    """Products that meet all given conditions; % and _ in q are wildcards; null stock and prices meet no condition."""
    out = products
    if q:
        out = out.filter(F.col("name").ilike("%" + q.replace("\\", "\\\\") + "%"))
    if sid is not None:
        out = out.filter(F.col("sid") == sid)
    if in_stock is not None:
        out = out.filter(F.col("in_stock") == in_stock)
    if least is not None:
        out = out.filter(F.col("current_price") >= least)
    if most is not None:
        out = out.filter(F.col("current_price") <= most)
    return out


def page(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page, latest first; ids settle ties. A top-k, not a sort of all rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return rows.orderBy(F.desc("updated_at"), "id").offset((number - 1) * size).limit(size)


def with_targets(products: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """products with sorted lists target_ids and keywords, empty where there is no link."""
    lists = links.join(targets.select(F.col("id").alias("target_id"), "target_value"), "target_id").groupBy("product_id").agg(
        F.sort_array(F.collect_list("target_id")).alias("target_ids"), F.sort_array(F.collect_list("target_value")).alias("keywords")
    )
    out = products.join(lists, products["id"] == lists["product_id"], "left").drop("product_id")
    return out.withColumns({"target_ids": F.coalesce("target_ids", F.array().cast("array<bigint>")), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})


def offers(products: DataFrame, stores: DataFrame, q: str) -> DataFrame:
    """Offers of a search with the shop's name; unknown stock counts as in stock, a missing price as 0."""
    named = stores.select(F.col("id").alias("sid"), "display_name")
    return search(products, q).join(named, "sid", "left").select(
        "id", "sid", F.coalesce("display_name", F.concat(F.lit("Store #"), F.col("sid").cast("string"))).alias("store_name"),
        F.coalesce("current_price", F.lit(0)).cast("double").alias("price"), F.col("current_mrp").cast("double").alias("mrp"), F.coalesce("in_stock", F.lit(True)).alias("in_stock"), F.col("product_url").alias("url"),
    )


def comparison(products: DataFrame, stores: DataFrame, q: str) -> DataFrame:
    """One answer: the query, the summary of its offers and the offers as a list, by price and id.

    The list is of one search, as the answer to it is; offers() has the same as rows.
    """
    found = offers(products, stores, q)
    listed = found.agg(F.sort_array(F.collect_list(F.struct("price", "id", "sid", "store_name", "mrp", "in_stock", "url"))).alias("offers"))
    return compare(products, q).select(F.lit(q).alias("query"), "*").join(listed)


def by_name(stores: DataFrame, name: str) -> DataFrame:
    """The shop of this name; no row where there is none."""
    return stores.filter(F.col("name") == name)


def in_category(products: DataFrame, category: str) -> DataFrame:
    """Products of a category, whatever the case of its letters; all where it is empty. It goes before the page, so that pages are full."""
    return products.filter(F.upper(F.coalesce("category", F.lit(""))) == category.upper()) if category else products


def listing(products: DataFrame, links: DataFrame, targets: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page of products (already searched) with the lists of their targets, the total of all pages, page and size.

    The page is a top-k, so lists are made for its rows only. A page beyond the last gives no rows.
    """
    rows = page(products, number, size)
    few = F.broadcast(rows.select(F.col("id").alias("product_id")))  # at most size rows
    of_page = with_targets(rows, links.join(few, "product_id", "left_semi"), targets)
    total = products.agg(F.count("*").alias("total"))
    return of_page.join(F.broadcast(total)).withColumns({"page": F.lit(number), "size": F.lit(size)})


def detail(products: DataFrame, links: DataFrame, targets: DataFrame, product_id: int) -> DataFrame:
    """One product with the lists of its targets; no row where there is none, which a front end reports as not found."""
    one = products.filter(F.col("id") == product_id)
    return with_targets(one, links.filter(F.col("product_id") == product_id), targets)


def history(observations: DataFrame, product_id: int) -> DataFrame:
    """The snapshots of one product, oldest first; unknown stock counts as in stock and snapshots without a price are none."""
    rows = observations.filter((F.col("product_id") == product_id) & F.col("price").isNotNull())
    return rows.select("product_id", "price", "mrp", F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "scraped_at", "target_id").orderBy("scraped_at", "target_id", "price")


def answer(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def found(asked: DataFrame, rows: DataFrame, key: str, missing: Column) -> DataFrame:
    """(key, status, json, detail): the answer to each key that is asked for: the row as JSON with status 200, else 404 and what is said of a missing one."""
    known = rows.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    there = F.col("json").isNotNull()
    return asked.select(key).join(known, key, "left").select(key, F.when(there, 200).otherwise(404).alias("status"), "json", F.when(~there, missing).alias("detail"))


def compare(products: DataFrame, q: str) -> DataFrame:
    """One row: offers, and lowest, highest and average of the prices that are known."""
    p = F.col("current_price")
    return search(products, q).agg(
        F.count("*").alias("total_offers"), F.min(p).cast("double").alias("lowest_price"), F.max(p).cast("double").alias("highest_price"),
        (F.sum(p).cast("double") / F.count(p)).alias("average_price"),
    )


def stock_counts(products: DataFrame, category: str = "category") -> DataFrame:
    """In stock and out of stock for each category and, with a null category, in all; unknown stock is in neither."""
    return products.rollup(category).agg(F.count_if("in_stock").alias("n_in"), F.count_if(~F.col("in_stock")).alias("n_out"), F.count("*").alias("n"))
