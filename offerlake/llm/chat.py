"""Chat formatting by perspective rotation.

Each conversation is rendered once for each of its participants: that speaker is the assistant,
every other one a named user, and the spans of the mask keep the loss on the speaker's own words.
The system's turns stay the system's.

Turns are numbered within their conversation by a prefix sum over the partitions of one ordered
table, so a conversation may hold any share of all rows. A rendering holds PART turns at most; a
longer dialogue goes on in the next part, which bounds a row and the work of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, stored

SYSTEM, PART = "system", 256


def _plain(text: Column) -> Column:
    """A text in which nothing can pose as a mark of the template."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _numbered(turns: DataFrame) -> DataFrame:
    """turns with i, the place in their conversation: by turn (nulls first), speaker and text."""
    order = ["conv_id", "turn", "speaker", "text", "row"]
    # Both tables are stored: the first so that equal rows keep their number row, the second so that the order is what was written.
    once = stored(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = stored(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"p": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns-in-order")
    dropped(once)
    # A conversation has one row for each partition that it lies in.
    pieces = placed.groupBy("conv_id", "p").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("conv_id").alias("conv"), F.col("p").alias("piece"), (before - F.col("low")).alias("shift"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("p") == F.col("piece"))
    return placed.join(pieces, same).select("conv_id", "turn", "speaker", "text", (F.col("at") + F.col("shift")).alias("i"))


def rotate(conversations: DataFrame, speaker: str = "role", part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, spans (first and last character of own words), n_target_chars.

    speaker is the column that names participants. A null or blank speaker is the user "unknown";
    a null text is empty and a very long one stays whole; marks of the template in names and
    texts are broken up, and a line feed in a name is a space; a null conv_id is a conversation of
    its own; a conversation in which only the system speaks gives no rows. Turns of equal number
    come by speaker and text, and repeated rows are repeated turns. An empty table gives no rows.
    Other columns of any name are ignored.
    """
    name = F.coalesce(F.nullif(F.trim(F.replace(F.col(speaker), F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", _plain(name).alias("speaker"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
    turns = stored(_numbered(turns).withColumn("part", F.floor(F.col("i") / part).cast("int")), "turns-numbered")
    heard = turns.groupBy("conv_id").agg(F.max("part").alias("parts"))
    people = turns.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # One row for each rendering, so that the parts of one conversation are dealt to several tasks.
    wanted = people.withColumnRenamed("conv_id", "conv").join(heard, F.col("conv").eqNullSafe(F.col("conv_id"))).select("conv", "perspective", F.explode(F.sequence(F.lit(0), "parts")).alias("of_part"))
    seen = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("of_part")))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), "speaker"))
    piece = F.struct("i", F.concat(F.lit("<|"), head, F.lit("|>\n")).alias("head"), "text", own.alias("own"))
    tail = "\n<|end|>\n"
    # At most part turns.
    rows = seen.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        first = done["at"] + F.length(t["head"])
        last = first + F.length(t["text"])
        spans = F.when(t["own"], F.concat(done["spans"], F.array(F.struct(first.alias("first"), last.alias("last"))))).otherwise(done["spans"])
        return F.struct((last + len(tail)).alias("at"), spans.alias("spans"))

    rows = rows.withColumn("spans", F.aggregate("turns", start, step)["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(tail))), "")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return rows.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"), "spans", chars.alias("n_target_chars"))
