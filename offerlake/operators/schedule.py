"""Scrape schedule: due targets and the next time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MANUAL, DAILY, HOURLY = 0, 1, 2
#: Keywords that every shop is seeded with, at most.
KEYWORDS = 10_000


def due(targets: DataFrame, stores: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """The n most urgent enabled targets of active shops: by priority, then by time; ids settle ties."""
    live = stores.filter("active").select(F.col("id").alias("store_id"))
    return targets.filter(F.col("enabled").eqNullSafe(True) & (F.col("next_scrape_at") <= as_of)).join(live, "store_id", "left_semi").orderBy(F.desc("priority"), "next_scrape_at", "id").limit(n)


def mark_scraped(targets: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """targets after a run: the done ones (id) wait an hour or a day."""
    hit = targets.join(done.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    wait = F.when(F.col("schedule_type") == HOURLY, F.expr("interval 1 hour")).otherwise(F.expr("interval 24 hour"))
    after = F.when(F.col("hit"), as_of + wait).otherwise(F.col("next_scrape_at"))
    return hit.withColumn("next_scrape_at", after).withColumn("last_scraped_at", F.when(F.col("hit"), as_of).otherwise(F.col("last_scraped_at"))).drop("hit")


#: Kinds of targets, as their definition has them; the original job compares with CODED.
SEARCH, CATEGORY, CODED = 0, 1, 2
#: Fixed value: pages of a target that asks for no number.
PAGES = 2


def plan(due_targets: DataFrame, pages: int = PAGES, as_coded: bool = False) -> DataFrame:
    """Due targets with is_category, max_pages and hard_category, which schedule_config (JSON) may set; searches keep the common number of pages.

    as_coded takes the number that the original job compares with, by which category targets
    without "catalog/" in their value run as searches. A config that is no JSON sets nothing.
    """
    asked = F.get_json_object("schedule_config", "$.max_pages").try_cast("int")
    category = (F.col("target_type") == (CODED if as_coded else CATEGORY)) | F.contains("target_value", F.lit("catalog/"))
    out = due_targets.withColumn("is_category", F.coalesce(category, F.lit(False)))
    return out.withColumn("max_pages", F.when(F.col("is_category"), F.coalesce(asked, F.lit(pages))).otherwise(pages)).withColumn("hard_category", F.get_json_object("schedule_config", "$.category"))


def reset(targets: DataFrame, store_id: int, as_of: Column) -> DataFrame:
    """targets with those of one shop due now and never scraped."""
    own = F.col("store_id") == store_id
    return targets.withColumns({"next_scrape_at": F.when(own, as_of).otherwise(F.col("next_scrape_at")), "last_scraped_at": F.when(~own, F.col("last_scraped_at"))})


#: Searches that every shop starts with.
SEED_KEYWORDS = (
    "ryzen 9000", "ryzen 7000", "intel core ultra", "intel core i9", "intel core i7", "intel core i5",
    "rtx 5090", "rtx 5080", "rtx 5070 ti", "rtx 5070", "rtx 5060 ti", "rtx 5060", "rx 9070 xt", "rx 9070",
    "b850 motherboard", "x870 motherboard", "b650 motherboard", "z890 motherboard",
    "ddr5 ram", "ddr4 ram", "32gb ddr5", "64gb ddr5", "6000mhz ram", "nvme ssd", "1tb ssd", "2tb ssd", "gen5 ssd",
    "650w psu", "750w psu", "850w psu", "1000w psu", "air cooler", "aio cooler", "240mm aio", "360mm aio", "atx cabinet", "matx cabinet",
    "1440p monitor", "4k monitor", "oled monitor",
)


def seed_targets(stores: DataFrame, present: DataFrame, as_of: Column, keywords: tuple[str, ...] = SEED_KEYWORDS) -> DataFrame:
    """New search targets of active shops: daily, of priority 1, enabled and due now. Those that are there as searches stay out."""
    words = stores.sparkSession.createDataFrame([(w,) for w in keywords], "target_value string")
    searches = present.filter(F.col("target_type") == SEARCH)
    return seed_keywords(stores, words, searches).select(
        "store_id", F.lit(SEARCH).alias("target_type"), "target_value", F.lit(DAILY).alias("schedule_type"), F.lit("{}").alias("schedule_config"),
        F.lit(1).alias("priority"), F.lit(True).alias("enabled"), as_of.alias("next_scrape_at"),
    )


def with_category(targets: DataFrame) -> DataFrame:
    """Targets whose schedule_config (JSON) names a category."""
    return targets.filter(F.get_json_object("schedule_config", "$.category").isNotNull())


def seed_keywords(stores: DataFrame, keywords: DataFrame, present: DataFrame) -> DataFrame:
    """(store_id, target_value) of active shops and keywords that are not there yet; every shop gets the whole list of at most KEYWORDS."""
    words = [r.target_value for r in keywords.select("target_value").distinct().limit(KEYWORDS + 1).collect()]
    if len(words) > KEYWORDS:
        raise ValueError(f"more than {KEYWORDS} keywords")
    pairs = stores.filter("active").select(F.col("id").alias("store_id"), F.explode(F.lit(words) if words else F.array().cast("array<string>")).alias("target_value"))
    return pairs.join(present.select("store_id", "target_value").distinct(), ["store_id", "target_value"], "left_anti")


def seed(state: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """state with the seeds: a seed replaces the whole row of its key, the other rows stay."""
    return state.join(seeds, key, "left_anti").unionByName(seeds.select(*state.columns))
