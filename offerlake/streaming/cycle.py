"""The scheduled cycle as micro-batches: due targets, their captured results, enrichment, normalization."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlake.operators import ingest, normalize, schedule
from offerlake.sources.scratch import stored

#: Targets and products that one cycle takes, and minutes between cycles.
TARGETS, PRODUCTS, MINUTES = 10, 10, 15


@dataclass
class Cycle:
    """What one cycle leaves: the relations after it, and what it appends."""

    targets: DataFrame
    products: DataFrame
    history: DataFrame
    links: DataFrame


def run_due(targets: DataFrame, stores: DataFrame, products: DataFrame, results: DataFrame, failed: DataFrame, as_of: Column, order: list[str], as_coded: bool = False) -> Cycle:
    """Targets that are due take their results (target_id, page, sid, pid, price, mrp, in_stock, scraped_at).

    Each target reads its own number of pages until one is missing or brings nothing new. A target
    in failed saves nothing and stays due; the others are marked, whether or not they found
    something. A row takes the category that its target asks for; of several the last target's.
    """
    planned = schedule.plan(schedule.due(targets, stores, as_of, TARGETS), as_coded=as_coded)
    # Both are stored, for each of the four relations reads them: the plan of at most TARGETS rows, and what its targets have found.
    done = stored(planned.join(failed.select(F.col("target_id").alias("id")), "id", "left_anti"), "due-plan")
    asked = F.broadcast(done.select(F.col("id").alias("target_id"), "max_pages", "hard_category"))
    taken = stored(results.join(asked, "target_id").filter(F.col("page") <= F.col("max_pages")).drop("max_pages"), "taken")
    saved = ingest.save_batch(products, ingest.until_stop(taken), order)
    hard = taken.filter("hard_category is not null").groupBy(*ingest.KEY).agg(F.max_by("hard_category", "target_id").alias("hard_category"))
    after = saved["products"].join(hard, ingest.KEY, "left").withColumn("category", F.coalesce(F.when(F.col("touched"), F.col("hard_category")), "category")).drop("hard_category")
    return Cycle(schedule.mark_scraped(targets, done, as_of), after, saved["history"], saved["links"])


def unenriched(products: DataFrame, n: int = PRODUCTS) -> DataFrame:
    """The first n products by id that lack a description or specifications."""
    return products.filter("description is null or specifications is null").orderBy("id").limit(n)


def enrich(products: DataFrame, details: DataFrame, n: int = PRODUCTS) -> DataFrame:
    """products, of which the unenriched ones take what their product pages say (sid, pid, description, specifications)."""
    some = unenriched(products, n).select(*ingest.KEY)
    found = details.join(F.broadcast(some), ingest.KEY, "left_semi").groupBy(*ingest.KEY).agg(*[F.max(c).alias(f"new_{c}") for c in ("description", "specifications")])
    out = products.join(F.broadcast(found), ingest.KEY, "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("description", "specifications")}).select(*products.columns)


def steps(*each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A chain of steps over one micro-batch; a step that fails ends the batch, which is then tried again from the checkpoint."""

    def run(batch: DataFrame, number: int) -> None:
        for step in each:
            step(batch, number)

    return run


def every(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, minutes: int | None = MINUTES) -> StreamingQuery:
    """The chain on what came in each so many minutes, missed times not made up; without minutes, on all that is there now, once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if minutes is None else writer.trigger(processingTime=f"{minutes} minutes")).start()


def normalized(products: DataFrame, state: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The last step: categories and specification tables of all products."""
    return normalize.upsert(products, state, granular=True)
