"""Source divergence audit: which words a source uses more than its language does, and how far sources are apart.

Everything is relational. Terms are exploded from the texts and counted by language and source; a
language keeps the terms that stand in enough of its documents. Groups are crossed with the kept
vocabulary of their language, so that a term a group never uses counts zero there; joined with
itself on language and term that table gives, for two sources, the sum of the differences of all
their shares, and a window ranks what comes out.

A share is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), with N the group's occurrences of
kept terms and V the number of kept terms. All arithmetic is on integers and exact.

Defined cases: null text, lang and source are empty strings. Repeated rows are documents of their
own. A group without terms, and a language that keeps no term, still take part: their sources are
at distance 0 there. A language with one source has no pairs. Ties go to the smaller item by its
UTF-8 bytes. A long text is one row of terms, as any other. An empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, stored

#: What a term is made of: letters A to Z and everything beyond ASCII; and what lies between terms.
TERM, APART = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term stands in; the scale of shares and what each count gets beforehand.
LEAST_DOCS, SCALE, SMOOTH = 30, 1_000_000_000, 5
#: Ranks of the most over-used terms of a group that are reported.
TOP_TERMS = 50
#: Parts that the vocabulary of a language is dealt in when groups are crossed with it.
DEALT = 64

_GROUP = ["lang", "source"]


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in _GROUP]


def _lowered(term: Column) -> Column:
    # Only A-Z are lowered; lower() is much faster and does the same to ASCII.
    return F.when(F.length(term) == F.octet_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents of the group that hold it."""
    # Splitting leaves empty strings at the ends of a text.
    terms = F.transform(F.split(F.coalesce(docs["text"], F.lit("")), APART), _lowered)
    found = docs.select(*_named(docs), terms.alias("terms"))
    # Every occurrence once, and once more each different term of a document.
    both = F.array(F.struct(F.col("terms"), F.lit(False).alias("once")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(True).alias("once")))
    each = found.select(*_GROUP, F.explode(both).alias("x")).select(*_GROUP, F.explode("x.terms").alias("term"), "x.once").filter("term <> ''")
    return each.groupBy(*_GROUP, "term").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total) of the terms that at least so many documents of their language hold; total is the language's n."""
    of_term = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"total": F.sum("n").over(of_term), "held": F.sum("docs").over(of_term)})
    return whole.filter(F.col("held") >= least).select("lang", "term", "source", "n", "total")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), by integer division of wide decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(12,0)"), wide(n) + wide(v) * SMOOTH
    return F.call_function("div", above, below) + 1


def dense(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, source, n, p, q): every group with every kept term of its language; p is the group's share, q the language's.

    The vocabulary of a language is dealt in parts, each of which meets the groups by itself, so no
    language is one task's. Counts are put beside by language, term and source.
    """
    terms = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy(*_GROUP).agg(F.sum("n").alias("group_n"))
    known = groups.join(sums, _GROUP, "left").join(langs, "lang").withColumn("group_n", F.coalesce("group_n", F.lit(0)))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int"))
    crossed = dealt.join(known, ["lang", "part"]).join(kept.drop("total"), ["lang", "term", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return crossed.select("lang", "term", "source", "n", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of differences of shares for every two sources of a language, in both directions."""
    shares = shares.select("lang", "term", "source", "p")
    # The empty string is no term: with it, sources of a language without kept terms meet as well.
    shares = shares.unionByName(groups.select("lang", F.lit("").alias("term"), "source", F.lit(0).cast("long").alias("p")))
    one, two = shares.withColumnsRenamed({"source": "a", "p": "pa"}), shares.withColumnsRenamed({"source": "b", "p": "pb"})
    met = one.join(two, ["lang", "term"]).filter("a < b")
    apart = met.groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return apart.select("lang", F.explode(ways).alias("x"), "value").select("lang", "x.*", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the other sources of the language by distance, part `term` the
    group's most over-used terms by the difference of its share and the language's."""
    groups = docs.select(*_named(docs)).distinct()
    counts = stored(term_counts(docs), "term-counts")
    kept = stored(kept_terms(counts, least), "kept-terms")
    dropped(counts)
    shares = stored(dense(groups, kept), "shares")
    dropped(kept)
    over = shares.filter("n > 0 and p > q").select(*_GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))
    pairs = _distances(groups, shares).withColumn("rank", place)
    terms = over.withColumn("rank", place).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select(*_GROUP, F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
