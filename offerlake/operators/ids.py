"""Get-or-create of surrogate ids: known keys keep theirs, new ones get the next above a stored mark.

The mark is the largest id ever given, so an id is not given twice even if its row has been deleted.
New keys are sorted by range and stored; the counts of the sorted parts, a few numbers for each part,
give every part its offset, and the place in the part does the rest. What a row gets depends on the
stored table alone, so a repeated task or a lost executor changes no id.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from offerlake.sources.scratch import stored

#: A row's number is its part shifted by so many bits, and its place in the part.
_PLACE_BITS = 33


def get_or_create(state: DataFrame, batch: DataFrame, key: list[str], mark: int | None = None) -> tuple[DataFrame, int]:
    """(key, id, created) of the batch's keys, each once, and the mark after them.

    state is (key, id), mark the largest id ever given; without one the state's own largest id is
    taken. New keys are numbered in the order of the key. Keys with a null are keys like others.
    """
    if mark is None:
        mark = state.agg(F.max("id")).first()[0] or 0
    known = state.select(*key, "id")
    asked = batch.select(*key).distinct()
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    met = stored(asked.join(known, same(asked, known), "left").select(*[asked[c] for c in key], known["id"]), "asked-keys")
    new = met.filter("id is null").select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    new = stored(new.withColumn("at", F.monotonically_increasing_id()), "new-keys")
    part = F.shiftright("at", _PLACE_BITS)
    counts = sorted(new.groupBy(part.alias("part")).count().collect())
    sizes = [0] * (counts[-1]["part"] + 1 if counts else 1)
    for r in counts:
        sizes[r["part"]] = r["count"]
    *before, total = accumulate(sizes, initial=mark)
    offset = F.lit(before).cast("array<long>")[part.cast("int")]
    made = new.select(*key, (offset + F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1).cast("long").alias("id"), F.lit(True).alias("created"))
    old = met.filter("id is not null").select(*key, F.col("id").cast("long").alias("id"), F.lit(False).alias("created"))
    return old.unionByName(made), total
