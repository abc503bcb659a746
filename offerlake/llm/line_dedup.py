"""Line dedup by a deletion-neighbourhood join, in built-in functions only.

Lines are compared by their words, lower-cased. Two lines are alike if they are equal or, where
both have FEWEST words or more, if one word inserted, deleted or replaced makes them equal (so at
least four words of five agree); there is no upper bound. A line goes if an earlier one (by doc_id,
then line number) is like it.

1. Every line emits the hash of its bag of words, whole and less each one word; lines that share
   none of these are alike to nothing. A line of more than LONG words does so only if it shares
   its first or last words with another, between a quarter and a half of them: an edit of one word
   leaves one of the two ends as it is. That spares a key for each of its words and drops no pair.
2. Lines that are left emit each variant that lacks one word as a 128-bit hash of words with their
   places, one step each. Lines that lack the same word place are all alike, and a shorter line is
   like each line that it is a variant of, so the earliest line of a variant decides and no pairs
   within a variant are made.
3. The pairs of a line and its earliest like are verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bucketed, dropped, stored

#: Fewest words of lines that an edit may part, and words beyond which lines meet by their ends first.
FEWEST, LONG = 5, 12
#: Tasks that the copies of one frequent line are dealt to.
SPREAD = 16
_KEY = ["k1", "k2"]


def _odd(text: Column) -> Column:
    odd = F.contains(text, F.lit("  "))
    for space in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(space))
    return odd


def _plain(text: Column) -> Column:
    # Most texts and lines have single spaces only; for them the regular expression is left out.
    each, single = F.split(F.lower(text), "\n"), lambda line: F.when(_odd(line), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    return F.when(_odd(text), F.transform(each, single)).otherwise(each)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, plain, k1, k2) of all lines that have a word."""
    rows = docs.select("doc_id", _text_hash().alias("text_hash"), F.posexplode(_plain(F.col("text"))).alias("line_no", "plain"))
    return rows.withColumn("plain", F.trim("plain")).filter("plain <> ''").withColumns({"k1": F.xxhash64("plain"), "k2": F.xxhash64(F.lit(1), "plain")})


def _size() -> Column:
    return F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1


def _end(n: Column) -> Column:
    """How many of a line's n > LONG words make an end: LONG / 2 times the power of 2 that makes them a half of n - 1 at most."""
    return (F.pow(F.lit(2), F.length(F.bin(F.floor((n - 1) / LONG))) - 1) * (LONG // 2)).cast("int")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """(k1, k2, first, copies, plain, n, ends): where each different line stands first and, if it may have variants, its words and their number.

    ends, of lines of LONG words or more, are the hashes of their first and last words: of two like
    lines, the longer of m words, the first or the last (m - 1) / 2 words are equal, and with them
    an end of _end(m); m is n or n + 1.
    """
    # Whether a line has that many words is seen at its start.
    start = F.substring_index("plain", " ", FEWEST - 1)
    some = F.when(F.octet_length(start) < F.octet_length("plain"), F.col("plain"))
    known = rows.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies"), F.max(some).alias("plain")).withColumn("n", _size())
    ends = lambda k: [F.xxhash64(F.lit(side), k, F.call_function("substring_index", F.col("plain"), F.lit(" "), k if side == 0 else -k)) for side in (0, 1)]
    of_n, of_more = _end(F.col("n")), _end(F.col("n") + 1)
    some = F.when(of_n == of_more, F.array(*ends(of_n))).otherwise(F.array(*ends(of_n), *ends(of_more)))
    return known.withColumn("ends", F.when(F.col("n") >= LONG, some))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h))


def _that_meet(lines: DataFrame, keys: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored (k1, k2) of the lines that share a key with another, and those keys (key)."""
    each = lines.select(*_KEY, F.explode(F.array_distinct(keys)).alias("key"))
    # Both are stored, so that Spark knows their size when it picks a join, and a few keys don't make all lines move.
    met = stored(each.groupBy("key").count().filter("count > 1").select("key"), name)
    out = stored(each.join(met, "key", "left_semi").select(*_KEY).distinct(), name + "-lines")
    return out, met


def _mismatch(a: Column, b: Column) -> Column:
    """How many words two lines have in common before the first that differs."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at == 0, F.size(a)).otherwise(at - 1)


def _one_edit(a: Column, b: Column) -> Column:
    return _mismatch(a, b) + _mismatch(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def repeated(known: DataFrame) -> DataFrame:
    """(k1, k2) of the lines that an earlier, different line is like."""
    by_ends, ends = _that_meet(known.filter(F.col("n") >= LONG), F.col("ends"), "ends-met")
    # known lies in buckets by the keys, so these joins move no lines.
    lines = known.filter("n is not null").select(*_KEY, "first", "n", "plain")
    words = F.split("plain", " ").alias("words")  # only of lines that are left
    sieved = lines.join(by_ends.withColumn("met", F.lit(True)).hint("shuffle_hash"), _KEY, "left").filter((F.col("n") <= LONG) | F.col("met"))
    # The hash of a bag of words is that of its variants after one step each.
    hashed = sieved.select(*_KEY, F.transform(words, lambda w: F.xxhash64(w)).alias("h")).withColumn("whole", _xor(F.col("h")))
    bags = F.concat(F.array("whole"), F.transform("h", lambda h: F.col("whole").bitwiseXOR(h)))
    bags = stored(hashed.select(*_KEY, bags.alias("bags")), "bags")  # which are read twice
    dropped(by_ends)
    dropped(ends)
    by_bags, met = _that_meet(bags, F.col("bags"), "bags-met")
    dropped(bags)
    some = stored(lines.join(by_bags.hint("shuffle_hash"), _KEY, "left_semi").select(*_KEY, "first", "n", words), "lines-met")
    dropped(by_bags)
    # The hash of a line is that of all its (word, place). Without word i, words before it keep their
    # place and words after it move up: moved ^ (in ^ moved of the words before i) ^ moved of word i.
    seeds = (0, 1)
    at_place = lambda seed, word, place: F.xxhash64(F.lit(seed), word, place)
    of_all = lambda seed, by: _xor(F.transform("words", lambda w, i: at_place(seed, w, i - by)))
    whole, moved = {f"v{s}": of_all(s, 0) for s in seeds}, {f"m{s}": of_all(s, 1) for s in seeds} | {"bag": _xor(F.transform("words", lambda w: F.xxhash64(w)))}
    each = some.withColumns(moved).select(*_KEY, "first", "n", *moved, F.posexplode("words").alias("at", "word"))
    before = Window.partitionBy(*_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = each.withColumns({f"h{s}": at_place(s, F.col("word"), F.col("at")) for s in seeds} | {f"g{s}": at_place(s, F.col("word"), F.col("at") - 1) for s in seeds})
    of_rest = lambda s: F.coalesce(F.bit_xor(F.col(f"h{s}").bitwiseXOR(F.col(f"g{s}"))).over(before), F.lit(0).cast("long"))
    less = [F.col(f"m{s}").bitwiseXOR(of_rest(s)).bitwiseXOR(F.col(f"g{s}")).alias(f"v{s}") for s in seeds]
    # A variant whose bag of words no other line shares is like nothing.
    here = here.withColumn("key", F.col("bag").bitwiseXOR(F.xxhash64("word"))).select(*_KEY, "first", "n", "at", "key", *less)
    variants = stored(here.join(met, "key", "left_semi").drop("key"), "variants")
    dropped(met)
    same = ["v0", "v1", "n"]
    line, other = F.struct("first", *_KEY), F.struct("first", F.col("k1").alias("o1"), F.col("k2").alias("o2"))
    one = variants.groupBy(*same, "at").agg(F.min(other).alias("before"), F.count("*").alias("c")).filter("c > 1").drop("c")
    replaced = variants.join(one, [*same, "at"]).filter(F.col("before.first") < F.col("first")).select(*_KEY, "before.o1", "before.o2")
    shorter = some.withColumns(whole).select(line.alias("short"), *same)
    longer = variants.withColumn("n", F.col("n") - 1).select(line.alias("long"), *same).join(shorter, same)
    a, b = F.greatest("long", "short"), F.least("long", "short")
    longer = longer.select(a["k1"].alias("k1"), a["k2"].alias("k2"), b["k1"].alias("o1"), b["k2"].alias("o2"), (a["first"] > b["first"]).alias("later")).filter("later").drop("later")
    pairs = replaced.unionByName(longer).distinct()
    others = some.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("words").alias("of_other"))
    checked = pairs.join(some.select(*_KEY, "words"), _KEY).join(others, ["o1", "o2"]).filter(_one_edit(F.col("words"), F.col("of_other")))
    near = stored(checked.select(*_KEY).distinct(), "near-lines")
    dropped(some)
    dropped(variants)
    return near


def marked(docs: DataFrame) -> DataFrame:
    """(row, text, lines, removed) of each row of docs: all its columns, its lines (null for a null text) and the numbers of those that go."""
    rows = lines(docs)
    known = bucketed(distinct_lines(rows), "lines", *_KEY)
    near = repeated(known)
    state = known.select(*_KEY, "first", "copies").join(near.withColumn("near", F.lit(True)), _KEY, "left").filter("near or copies > 1")
    state = stored(state, "line-state")
    dropped(known)
    dropped(near)
    # Only lines that repeat or are near meet here, and the copies of a frequent one are dealt to SPREAD tasks. The stored
    # state may be small, its copies are not: a merge join keeps them from being broadcast through the driver.
    state = state.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).hint("merge")
    here = F.struct("doc_id", "line_no")
    some = rows.select("doc_id", "text_hash", "line_no", *_KEY, F.pmod(F.xxhash64("doc_id", "text_hash", "line_no"), F.lit(SPREAD)).cast("int").alias("copy"))
    gone = some.join(state, [*_KEY, "copy"]).filter(F.col("near").isNotNull() | ~F.col("first").eqNullSafe(here))
    of_doc = gone.groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.collect_set("line_no").alias("removed"))
    own = docs.select(F.struct("*").alias("row"), "doc_id", _text_hash().alias("text_hash"), "text")
    joined = own.join(of_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    return joined.select("row", "text", F.split("text", "\n").alias("lines"), "removed")


def _kept() -> Column:
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with the lines that go taken out of text.

    Blank lines stay; a null text stays null; a text of which all lines go becomes empty; a very
    long text is only more lines, and a very long line only more words. Rows that repeat a doc_id
    have the same place in the order: of equal lines at the same place both stay. A null doc_id
    comes first. An empty table gives no rows. Extra columns of any name stay as they are.
    """
    return marked(docs).withColumn("row", F.col("row").withField("text", _kept())).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the text that stays) of each document; cases as in deduplicate()."""
    df = marked(docs.select("doc_id", "text"))
    return df.select(
        "row.doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(_kept(), F.lit("")).alias("kept"),
    )
