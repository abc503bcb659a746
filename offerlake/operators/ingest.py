"""Keyed ingest: deduplication, guarded upsert, history and links, as state x batch -> state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from offerlake.sources.scratch import stored

KEY = ["sid", "pid"]
#: Rows of a group that one task numbers, about.
GROUP_ROWS = 1_000_000


def first_page_last_row(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row for each key: of the first page that shows it, the last row."""
    rank = F.struct((-F.col("page")).alias("page"), *order)
    rest = [c for c in batch.columns if c not in KEY]
    return batch.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("x")).select(*KEY, "x.*")


def until_stop(batch: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Rows of the pages before the first that is missing or brings no new key for its target, and of max_pages pages at most.

    A row whose key an earlier page had goes; equal keys of one page stay.
    """
    batch = batch if max_pages is None else batch.filter(F.col("page") <= max_pages)
    seen = batch.groupBy("target_id", *KEY).agg(F.min("page").alias("page"))
    new = seen.groupBy("target_id", "page").agg(F.count("*").alias("n"))
    # Pages that bring something are numbered; the first whose number is not its place is behind a stop.
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("page"))
    open_ = new.withColumn("at", rank).filter("page = at").select("target_id", "page")
    first = seen.join(open_, ["target_id", "page"])
    return batch.join(first, ["target_id", "page", *KEY], "left_semi")


def _merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state and batch by key; what the batch knows replaces what the state knows."""
    b = batch.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("price", "mrp", "in_stock")], F.lit(True).alias("seen"))
    more = [c for c in ("category",) if c in state.columns]
    return state.select(*KEY, "price", "mrp", "in_stock", *more, F.lit(True).alias("known")).join(b, KEY, "full")


def _taken(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEY, *[F.coalesce(f"new_{c}", c).alias(c) for c in ("price", "mrp", "in_stock")], F.coalesce("seen", F.lit(False)).alias("touched"), *more)


def save_offers(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state after a batch: known keys take what the batch knows, new keys come in only if they are in stock."""
    return _taken(_merged(state, batch).filter("known or new_in_stock"))


def save_details(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state after a batch of product pages: as save_offers, but new keys come in whatever their stock; no history."""
    return _taken(_merged(state, batch))


def history_rows(saved: DataFrame, batch: DataFrame) -> DataFrame:
    """Snapshots that a batch appends: of saved keys, with unknown stock as in stock."""
    return _snapshots(batch.join(saved.select(*KEY), KEY, "left_semi"))


def _snapshots(saved: DataFrame) -> DataFrame:
    return saved.filter("price is not null").select(*KEY, "price", "mrp", F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "scraped_at")


def save_batch(state: DataFrame, batch: DataFrame, order: list[str], hard_category: str | None = None) -> dict[str, DataFrame]:
    """All that saving a batch of found offers changes, as one answer: products, history and links.

    Of a key that the batch has more than once the last row by order counts. products takes
    hard_category where the batch touched a row, history gets one snapshot for each saved row, and
    links has the targets of saved rows. The caller writes the three in one job each or none.
    """
    rest = [c for c in batch.columns if c not in KEY]
    last = stored(batch.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*KEY, "x.*"), "last-offers")
    old = F.col("category") if "category" in state.columns else F.lit(None).cast("string")
    rows = _merged(state.select(*KEY, "price", "mrp", "in_stock", old.alias("category")), last).filter("known or new_in_stock")
    products = _taken(rows, "category").withColumn("category", F.when(F.col("touched"), F.coalesce(F.lit(hard_category), "category")).otherwise(F.col("category")))
    # Which offers were saved is asked of the keys alone, and once for both: known ones, and new ones in stock.
    known = state.select(*KEY, F.lit(True).alias("known"))
    saved = stored(last.join(known, KEY, "left").filter("known or in_stock").drop("known"), "saved-offers")
    linked = saved.filter("target_id is not null").select(*KEY, "target_id").distinct()
    return {"products": products, "history": _snapshots(saved), "links": linked}


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links that are not there yet."""
    return new.select("product_id", "target_id").distinct().join(links, ["product_id", "target_id"], "left_anti")


def upsert_specs(state: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Specs after a batch: what it knows replaces, what it lacks stays; rows without any value do nothing."""
    known = F.lit(False)
    for c in columns:
        known = known | F.col(c).isNotNull()
    some = batch.filter(known).select("product_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    return state.join(some, "product_id", "full").select("product_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """Ids in order of the key, dense over any number of partitions: the totals of groups give each its offset.

    Groups are hashes of a prefix of the order: the shop. A large shop is cut by ranges of pid that
    its own least and greatest give, so that a row's group depends on the row and the totals only
    and never on where it was computed; a repeated task gives the same ids.
    """
    span = rows.groupBy("sid").agg(F.min("pid").alias("_low"), F.max("pid").alias("_high"), F.count("*").alias("_n"))
    pieces = F.ceil(F.col("_n") / GROUP_ROWS)
    at = F.floor((F.col("pid") - F.col("_low")) / ((F.col("_high") - F.col("_low") + 1) / pieces)).cast("int")
    part = rows.join(span, "sid").withColumn("_p", at).drop("_low", "_high", "_n")
    totals = part.groupBy("sid", "_p").agg(F.count("*").alias("_n"))
    # Two small windows instead of one over all groups: pieces of a shop, then shops.
    piece = F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shops = span.select("sid", F.coalesce(F.sum("_n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_of_shop"))
    before = totals.select("sid", "_p", piece.alias("_of_piece")).join(shops, "sid").select("sid", "_p", (F.col("_of_piece") + F.col("_of_shop")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("sid", "_p").orderBy("pid"))
    return part.join(before, ["sid", "_p"]).withColumn("id", rank + F.col("_before") + start).drop("_p", "_before")
