"""URL filters: allow and block rules as prefixes, found by a sort-merge range join.

A rule is a host (with all its subdomains) and a path prefix. A url asks for each suffix of its
host; the canonical key of host and path is the reversed host, a line feed and the path, so that a
rule is the interval of keys that start with its own key. Rules and keys are dealt to ranges of
the key; a rule goes to each range that its interval meets. Within a range, one sweep in key order
keeps the stack of rules that are still open, and its top is the longest rule of a key.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range, and ranges for each shuffle partition.
SAMPLE, RANGES = 20, 4
#: Urls that fewer pages share are never split over tasks; beyond it, those are which more than one page in HOT_SHARE has.
HOT_LEAST, HOT_SHARE = 1_000, 10_000
_END = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty where it is null or has no '://'."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("\n"), path)


def _probes(host: Column, path: Column) -> Column:
    """Keys of all suffixes of a host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("\n"), path))


def _dealt(keys: DataFrame, bounds: list[str], spread: bool) -> DataFrame:
    """keys with the range r that each lies in or, for rules (spread), each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_pylist()
            ranges = [range(bisect_left(bounds, k), bisect_right(bounds, k + _END) + 1) if spread else (bisect_right(bounds, k),) for k in own]
            take = pa.array([i for i, r in enumerate(ranges) for _ in r], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array([x for r in ranges for x in r], pa.int32())], names=[*batch.schema.names, "r"])

    return keys.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in keys.schema)}, r int")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longest open rule of each key; rows come by range, key, rules first."""
    stack: list[tuple[str, str, str]] = []
    at = None
    for batch in batches:
        out = []
        for r, key, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("r", "key", "rule", "verdict"))):
            if r != at:
                stack, at = [], r
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, verdict))
            elif stack:
                out.append((key, *stack[-1][1:]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ((), (), ()))], names=["key", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of each page.

    rules has host, path and verdict (allow or block). The longest rule (host and path together,
    then the longer host) wins; where one rule has both verdicts, block does. A null or empty url
    or one without host can only meet rules without host; a very long url is one key as any other.
    Repeated rows are judged alike and a null page_id stays; an empty rule table leaves every page
    to the default; an empty table gives no rows; other columns of pages are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Equal urls are one row from here on, and so are equal keys of hosts below one domain.
    asked = stored(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    probes = asked.select("host", "path", F.explode(_probes(F.col("host"), F.col("path"))).alias("key"))
    keys = stored(probes.select("key").distinct(), "url-keys")
    ranges = RANGES * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(keys.count(), 1)
    sample = sorted(x.key for x in keys.sample(min(1.0, SAMPLE * ranges / n), seed=11).collect())  # about SAMPLE * ranges keys
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    h, p = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    known = rules.groupBy(h.alias("host"), p.alias("path")).agg(F.max("verdict").alias("verdict"))
    known = known.select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    none = F.lit(None).cast("string")
    events = _dealt(known, bounds, True).unionByName(_dealt(keys, bounds, False).withColumns({"rule": none, "verdict": none}))
    found = events.repartition("r").sortWithinPartitions("r", "key", F.col("rule").isNull()).mapInArrow(_sweep, "key string, rule string, verdict string")
    # The key's host has as many characters as the rule's, so the longest key part is the longest host.
    best = stored(probes.join(found, "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length(F.substring_index("key", "\n", 1)).alias("h"), "rule", "verdict")).alias("b")
    ), "url-rules")
    # At most HOT_SHARE urls are that frequent; their pages are dealt to several tasks.
    least = max(HOT_LEAST, (asked.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(stored(asked.filter(F.col("n") > least).select("host", "path", F.ceil(F.col("n") / least).cast("int").alias("copies")), "hot-urls"))
    copies = F.coalesce("copies", F.lit(1))
    best = best.join(hot, ["host", "path"], "left").select("host", "path", "b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = urls.join(hot, ["host", "path"], "left").withColumn("copy", F.pmod(F.xxhash64("page_id"), copies).cast("int"))
    dropped(asked)
    dropped(keys)
    return dealt.join(best, ["host", "path", "copy"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
