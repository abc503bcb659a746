"""Benchmark decontamination by winnowing.

The smallest hash of each run of consecutive k-grams is a fingerprint of the run. Runs span
exactly one window of benchmark words, so a window that occurs in a document gives a fingerprint
that both have. Fingerprints are joined, and each joined pair is extended word by word.

Before words are put beside a document's fingerprint, it is held against a bit map of the
benchmark's. The map has the same size for any benchmark; what passes it by chance ends in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, texts

#: Words of a window and of a k-gram. k + run - 1 = WINDOW, where run is the number of k-grams in a window.
WINDOW, GRAM = 10, 5
#: Binary digits of a place in the bit map (2^23 bits, 1 MB), which is the first digits of a fingerprint.
MAP_DIGITS = 23
CHUNK, CACHE_WORDS = 2 << 20, 500_000
_OWN = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _OWN or c >= 128 else 32 for c in range(256))
_ROWS = "array<struct<g:bigint,pos:int,left:int,need:int,context:string>>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


_hashes = _Hashes()


def text_hash():
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of digits, a-z (A-Z lowered) and all characters beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k words from each position on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(29))


def _selected(h: np.ndarray, ends: np.ndarray, short: list[int], wanted: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """(positions, hashes, k, words needed) of the fingerprints of texts that stand end to end in h;
    ends has the end of its text for each position."""
    out = []
    for need in [WINDOW, *short]:
        k = GRAM if need == WINDOW else need
        g, run = _grams(h, k), need - k + 1
        if len(g) < run:
            continue
        starts = np.flatnonzero(np.arange(len(g) - run + 1) + need <= ends[: len(g) - run + 1])
        if run > 1:
            least = starts + np.lib.stride_tricks.sliding_window_view(g, run)[starts].argmin(1)
            least = np.unique(least)
        else:
            least = starts
        values = g[least]
        if wanted is not None:
            at = values >> np.uint64(65 - (64 * len(wanted)).bit_length())
            there = wanted[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
            least, values = least[there], values[there]
        out.append((least, values, k, need))
    return out


def _fingerprints(df: DataFrame, key: str, short: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(key, text_hash, n_words, prints): fingerprints with the words around them."""
    schema = T.StructType([df.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("prints", T._parse_datatype_string(_ROWS))])
    kind = pa.list_(pa.struct([("g", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("need", pa.int32()), ("context", pa.string())]))

    def of(some: list[bytes | None]) -> tuple[list[int], list[list[dict]]]:
        words = list(map(words_of, some))
        n = np.array(list(map(len, words)))
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
        ends = np.repeat(starts + n, n)
        prints: list[list[dict]] = [[] for _ in some]
        for at, values, k, need in _selected(h, ends, short, wanted):
            owner = np.searchsorted(starts, at, side="right") - 1
            for i, p, g in zip(owner.tolist(), (at - starts[owner]).tolist(), values.astype(np.int64).tolist()):
                left = min(p, need - k)
                prints[i].append({"g": g, "pos": p, "left": left, "need": need, "context": b" ".join(words[i][p - left : p + need]).decode("utf-8", "replace")})
        return n.tolist(), prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts, a, size = texts(batch), 0, 0
            for b, text in enumerate(all_texts, 1):
                size += len(text or b"")
                if size < CHUNK and b < len(all_texts):
                    continue
                some = all_texts[a:b]
                n, prints = of(some)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (key, "text_hash")), pa.array(n, pa.int64()), pa.array(prints, kind)], names=schema.names)
                a, size = b, 0
        _hashes.clear()  # the worker lives on and has other work

    return df.select(key, text_hash().alias("text_hash"), "text").mapInArrow(run, schema)


def _map(prints: DataFrame) -> np.ndarray:
    """The bit map of fingerprints g in 64-bit numbers; the driver receives at most as many rows as it has numbers."""
    at = F.shiftrightunsigned("g", 64 - MAP_DIGITS)
    numbers = prints.select(F.shiftright(at, 6).alias("i"), at.bitwiseAND(63).cast("int").alias("b")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, b))").alias("x"))
    out = np.zeros(1 << MAP_DIGITS - 6, np.uint64)
    for r in numbers.collect():
        out[r.i] = r.x & (1 << 64) - 1
    return out


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Span of equal words around each joined pair, where it has a whole window."""
    for batch in batches:
        keep, first, last = [], [], []
        for i, (pos, need, la, ca, lb, cb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pos", "need", "left", "context", "item_left", "item_context")))):
            a, b, before, after = ca.split(" "), cb.split(" "), 0, 0
            while before < min(la, lb) and a[la - before - 1] == b[lb - before - 1]:
                before += 1
            while la + after < len(a) and lb + after < len(b) and a[la + after] == b[lb + after]:
                after += 1
            if before + after >= need:
                keep.append(i)
                first.append(pos - before)
                last.append(pos + after)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "text_hash", "item_id")), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "text_hash", "item_id", "first", "last"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored per-document rows (doc_id, text_hash, n_words) and hits (doc_id, text_hash, item_id, first, last).

    Rows that repeat a doc_id with another text stay apart by text_hash.
    """
    items = benchmark.filter("item_id is not null")
    sizes = _fingerprints(items, "item_id", [], np.zeros(1 << MAP_DIGITS - 6, np.uint64)).select("n_words").filter(F.col("n_words").between(1, WINDOW - 1)).distinct()
    short = sorted(r.n_words for r in sizes.collect())  # below WINDOW values
    prints = stored(_fingerprints(items, "item_id", short, None).select("item_id", "n_words", F.inline("prints")).filter(F.col("need") == F.least("n_words", F.lit(WINDOW))), "items")
    rows = stored(_fingerprints(docs, "doc_id", short, _map(prints)), "fingerprints")
    sides = prints.select("g", "need", "item_id", F.col("left").alias("item_left"), F.col("context").alias("item_context")).distinct()
    pairs = rows.select("doc_id", "text_hash", F.inline("prints")).join(sides, ["g", "need"])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), benchmark.schema["item_id"], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    hits = pairs.select("doc_id", "text_hash", "item_id", "pos", "need", "left", "context", "item_left", "item_context").mapInArrow(_extended, schema)
    return rows.select("doc_id", "text_hash", "n_words"), hits.distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, sorted as strings), n_items, contaminated for each document.

    A null or empty text has no words and is clean; an item without words, or with a null id, is
    left out; a shorter item than a window is one window; of equal hashes in a window the first is
    its fingerprint; a very long text is taken as a whole. Repeated rows get equal results, a null
    doc_id stays null, an empty table gives no rows, without items all is clean; other columns are
    ignored.
    """
    rows, hits = overlaps(docs, benchmark)
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    grown = lambda acc, s: F.struct((acc["n"] + F.greatest(s["last"] - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("n"), F.greatest(s["last"], acc["end"]).alias("end"))
    found = found.withColumn("n_hit", F.aggregate("spans", start, grown)["n"]).drop("spans")
    none = F.array().cast("array<string>")
    same = (rows["doc_id"].eqNullSafe(found["doc_id"])) & (rows["text_hash"] == found["text_hash"])
    return rows.join(found, same, "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")
    ).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; cases as in decontaminate(), and extra columns of any name stay as they are."""
    hits = overlaps(docs, benchmark)[1].select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("text_hash"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left_anti").select("row.*")
