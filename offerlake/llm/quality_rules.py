"""Quality rules: a table of thresholds, compiled into projections of built-in functions.

Everything is computed in the row; no user function and no shuffle takes part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Frequent function words of the four languages.
STOP_WORDS = """
the of and to in is that for it was with as on be by at from this are or an a he she they we you not have has
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie
de la le et les des en un une du que est pour qui dans sur au pas par plus ce il
el los y las del se por con no una su para es lo como al
""".split()  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """kept needs least <= metric <= most; a null metric passes."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols to words", "symbol_ratio", most=0.10),
    Rule("stop words", "stop_ratio", least=0.04),
    Rule("repeated lines", "dup_line_ratio", most=0.50),
    Rule("words on a line", "words_per_line", least=3.0),
)


def _counts(docs: DataFrame) -> DataFrame:
    """Base counts of each text. Each step reads the columns of the one before it, so that the
    split into words is made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = text
    for c in "\n\t\r\x0b\x0c":
        plain = F.replace(plain, F.lit(c), F.lit(" "))  # a split at one literal character needs no regex
    df = docs.withColumns({"_words": F.array_remove(F.split(plain, " "), ""), "_lines": lines})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_n_lines": F.size("_lines"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.when(text.rlike(r"[#*$%&|<>]"), F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).otherwise(0).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
        "_windows": F.when(
            F.size("_words") >= 3,
            F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), 1, F.size("_words") - 2),
        ),
    })
    # A window that occurs again stands next to its equal in sorted order.
    df = df.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda e, j: F.coalesce(e["h"] == F.get("_sorted", j)["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("_stops", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "_n_lines"),
    "words_per_line": ("n_words", "_n_lines"),
}


def passes(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one condition."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & F.coalesce(F.col(r.metric) >= r.least, F.lit(True))
        if r.most is not None:
            out = out & F.coalesce(F.col(r.metric) <= r.most, F.lit(True))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, base counts, ratios and verdicts of each whole text.

    A null or empty text has no words and, like any text of fewer than 50 words, fails the base
    rules; a very long text is judged as a whole; a metric at its threshold passes; stop words are
    found in either case. Repeated rows are judged alike, an empty table gives no rows, extra
    columns of any name are not returned.
    """
    df = _counts(docs.select("doc_id", "text")).withColumns({m: _ratio(*of) for m, of in METRICS.items()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *METRICS, failed.alias("base_failed"), (~failed & passes(rules)).alias("kept"))
