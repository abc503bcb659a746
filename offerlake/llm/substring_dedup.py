"""Substring dedup: passages of a whole window of words or more that stand anywhere else.

1. Winnowed anchors (the smallest word-gram hash of each window) are counted; a window that
   stands twice has an anchor that does. Each recurring anchor is sent to the shard of one of the
   documents that have it, so neighbouring anchors of a copied passage share a shard.
2. A segment is the stretch of a document about its anchors of one shard. Windows of segments are
   counted by hash, and the first segment of each that is met twice gives the recurring passages:
   runs of such windows, each window in one passage.
3. Each shard compiles Aho-Corasick automata over the phrases of its passages and streams the
   segments of all documents through them. A phrase that is hit is extended word by word, and
   where the passage and the text agree over a whole window or more, the passage occurs.

Positions come from the automata only: the counts say which passages recur, not where. Shards with
many words are split, passages by hash (each segment then visits every part) and segments by hash
(each part of the passages is then compiled in several tasks), so no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, stored, texts

#: Words of a window, words of an anchor, and k-grams of a window of which the smallest is the anchor.
WINDOW, GRAM = 35, 8
CHUNK, CACHE_WORDS = 2 << 20, 500_000
#: Words of the passages of one automaton, and words of the segments that one task streams through it before they are split.
SHARD_WORDS, STREAM_WORDS = 500_000, 250_000
#: Words of one piece of a passage, and of all passages of one automaton: each has a sign of its own at most, and there are 1,112,062 signs.
PIECE, SIGNS = 20_000, 1_000_000
#: Copies of the small plan of shards, so that segments of one large shard are dealt to several tasks.
SPREAD = 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


_hashes = _Hashes()


def _hash(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k words from each position on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(29))


def _leftmost_min(g: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each width values in a row stands, the leftmost of equal ones, by doubling the width."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at, have = np.where(g[right] < g[left], right, left), have + step
    return at


def _chunks(rows: list[bytes | None]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Rows a to b with their words, about CHUNK bytes of text at a time."""
    a, size = 0, 0
    for b, text in enumerate(rows, 1):
        size += len(text or b"")
        if size >= CHUNK or b == len(rows):
            yield a, b, [(t or b"").split() for t in rows[a:b]]
            a, size = b, 0


def _flat(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and where each text starts and ends."""
    n = np.array(list(map(len, words)), np.int64)
    ends = np.cumsum(n)
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum())), ends - n, ends


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, g, pos): the anchors of each text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _chunks(texts(batch)):
                h, starts, ends = _flat(words)
                at, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                if len(h) >= window:
                    g = _hash(h, gram)
                    whole = np.flatnonzero(np.arange(len(h) - window + 1) + window <= np.repeat(ends, ends - starts)[: len(h) - window + 1])
                    if len(whole):
                        at = np.unique(_leftmost_min(g, window - gram + 1)[whole])
                        values = g[at]
                owner = np.searchsorted(ends, at, side="right")
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("doc_id", "text_hash")), pa.array(values.view(np.int64)), pa.array((at - starts[owner]).astype(np.int32))],
                    names=["doc_id", "text_hash", "g", "pos"],
                )

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("text_hash", "g")], T.StructField("pos", T.IntegerType())])
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _segments(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """(rep, doc_id, text_hash, first, at, n, words): stretches of words about the anchors of one shard; at has the anchors' places in it."""

    def of(words: list[bytes], places: list[dict]) -> Iterator[tuple[int, int, list[int], int, bytes]]:
        open_: dict[int, list] = {}

        def closed(rep: int) -> tuple[int, int, list[int], int, bytes]:
            low, high, at = open_.pop(rep)
            return rep, low, [p - low for p in at], high - low, b" ".join(words[low:high])

        for p, rep in sorted((x["pos"], x["rep"]) for x in places):
            low, high = max(0, p + gram - window), min(len(words), p + window)
            if rep in open_ and low > open_[rep][1]:
                yield closed(rep)
            if rep in open_:
                open_[rep][1] = high
                open_[rep][2].append(p)
            else:
                open_[rep] = [low, high, [p]]
        for rep in list(open_):
            yield closed(rep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            for a, b, words in _chunks(texts(batch)):
                found = [(i + a, *x) for i, (w, of_row) in enumerate(zip(words, places[a:b])) for x in of(w, of_row)]
                owner, rep, first, at, n, text = map(list, zip(*found)) if found else ([], [], [], [], [], [])
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep, pa.int64()), *(batch.column(c).take(take) for c in ("doc_id", "text_hash")), pa.array(first, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(text, pa.binary())],
                    names=["rep", "doc_id", "text_hash", "first", "at", "n", "words"],
                )

    long, int_ = T.LongType(), T.IntegerType()
    schema = T.StructType([T.StructField("rep", long), marked.schema["doc_id"], T.StructField("text_hash", long), T.StructField("first", int_), T.StructField("at", T.ArrayType(int_)), T.StructField("n", int_), T.StructField("words", T.BinaryType())])
    return marked.select("doc_id", "text_hash", "text", "places").mapInArrow(run, schema)


def _windows(segments: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, seg): each window of a document once, in the segment that has its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, seg = batch.column("at").to_pylist(), batch.column("seg").to_numpy()
            for a, b, words in _chunks(texts(batch, "words")):
                h, starts, ends = _flat(words)
                if len(h) < window:
                    continue
                own = np.zeros(len(h), bool)
                own[np.repeat(starts, list(map(len, places[a:b]))) + np.fromiter(chain.from_iterable(places[a:b]), np.int64)] = True
                n = len(h) - window + 1
                whole = np.flatnonzero(np.arange(n) + window <= np.repeat(ends, ends - starts)[:n])
                at = whole[own[_leftmost_min(_hash(h, gram), window - gram + 1)[whole]]]
                yield pa.RecordBatch.from_arrays([pa.array(_hash(h, window)[at].view(np.int64)), pa.array(seg[a + np.searchsorted(ends, at, side="right")])], names=["h", "seg"])

    return segments.select("seg", "at", "words").mapInArrow(run, "h bigint, seg bigint")


def _passages(chosen: DataFrame, window: int) -> DataFrame:
    """(rep, n, words): runs of the chosen windows (their hashes, hs) in each segment, long ones in pieces; a window that it repeats counts where it is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, rep, rows = batch.column("hs").to_pylist(), batch.column("rep").to_pylist(), []
            for r, hs, text in zip(rep, wanted, texts(batch, "words")):
                words = text.split()
                h = _hash(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)), window)
                firsts = np.sort(np.unique(h, return_index=True)[1])
                at = firsts[np.isin(h[firsts], np.array(hs, np.int64).view(np.uint64))]
                rows += [(r, b - a, b" ".join(words[a:b])) for low, high in _runs(at, window) for a, b in _pieces(low, high, window)]
            rep, n, text = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.binary())], names=["rep", "n", "words"])

    return chosen.select("rep", "words", "hs").mapInArrow(run, "rep bigint, n int, words binary")


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word spans that windows at the starts (in order) cover, each a run of windows one word apart."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist()))


def _pieces(low: int, high: int, window: int) -> list[tuple[int, int]]:
    """A span in pieces of PIECE words at most, which overlap so that every window lies within one."""
    step = max(PIECE, 2 * window) - window + 1
    return [(at, min(at + step + window - 1, high)) for at in range(low, high - window + 1, step)]


def _bounded(passages: list[bytes]) -> Iterator[list[bytes]]:
    """The passages in order, in groups of at most SIGNS words (or of one passage)."""
    group, n = [], 0
    for p in passages:
        words = p.count(b" ") + 1
        if group and n + words > SIGNS:
            yield group
            group, n = [], 0
        group.append(p)
        n += words
    if group:
        yield group


class Automaton:
    """Aho-Corasick over the phrases of some passages.

    Each word of the passages has a sign, all other words share one. A passage is laid out as
    phrases of (window + 1) / 2 words end to end; a window of it holds at least one whole phrase.
    """

    def __init__(self, passages: list[bytes], window: int):
        import ahocorasick

        self.window, self.size, self.signs = window, (window + 1) // 2, {}
        self.lines = ["".join([self.signs.setdefault(w, chr(len(self.signs) + 2 + 2048 * (len(self.signs) + 2 >= 0xD800))) for w in p.split()]) for p in passages]  # no surrogates
        phrases: dict[str, list[tuple[int, int]]] = {}
        for k, line in enumerate(self.lines):
            for at in range(0, len(line) - self.size + 1, self.size):
                phrases.setdefault(line[at : at + self.size], []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, places in phrases.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Word spans of the text, in order, that agree with a passage over a window or more."""
        line = "".join([self.signs.get(w, "\x01") for w in text.split()])
        done: dict[tuple[int, int], int] = {}
        found = []
        for end, places in self.automaton.iter(line):
            for k, at in places:
                start = end - self.size + 1
                shift, passage = start - at, self.lines[k]
                if done.get((k, shift), 0) > start:
                    continue
                low, high = max(shift, 0), min(shift + len(passage), len(line))
                if line[low:high] != passage[low - shift : high - shift]:
                    low, high, most, least = start, end + 1, high, low
                    while low > least and line[low - 1] == passage[low - 1 - shift]:
                        low -= 1
                    while high < most and line[high] == passage[high - shift]:
                        high += 1
                done[k, shift] = high
                if high - low >= self.window:
                    found.append((low, high))
        out: list[tuple[int, int]] = []
        for low, high in sorted(found):
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], high))
            else:
                out.append((low, high))
        return out


def _located(dealt: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, first, last): where passages occur; rows come by shard and part, passages (kind 0) before segments (kind 1)."""
    by = ("rep", "part", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, passages, automata = None, [], None
        for batch in batches:
            owner, spans = [], []
            for i, (*key, kind, first, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*by, "kind", "first", "words")))):
                if key != here:
                    here, passages, automata = key, [], None
                if kind == 0:
                    passages.append(text)
                    continue
                if automata is None:
                    # Parts are dealt by hash, so one may hold more than its share: it then gets several automata.
                    automata = [Automaton(group, window) for group in _bounded(passages)]
                for automaton in automata:
                    found = automaton.spans(text)
                    owner += [i] * len(found)
                    spans += [(first + a, first + b) for a, b in found]
            take = pa.array(owner, pa.int64())
            low, high = zip(*spans) if spans else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "text_hash")), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["doc_id", "text_hash", "first", "last"])

    schema = T.StructType([dealt.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    return dealt.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(run, schema)


def _dealt(passages: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows for _located: each passage in one part of its shard, each segment with all parts, both cut by salt where a shard is large."""
    size = lambda df, n, most: df.groupBy("rep").agg(F.ceil(F.sum("n") / most).cast("int").alias(n))
    plan = stored(size(passages, "parts", SHARD_WORDS).join(size(segments, "salts", STREAM_WORDS), "rep"), "shards")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    kind = segments.schema["doc_id"].dataType
    own = passages.join(plan, "rep").select("rep", hashed("words", "parts").alias("part"), each("salts").alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), F.lit(0).alias("first"), "words")
    # The stored plan is small, its copies are not: a merge join keeps them from being broadcast through the driver.
    wide = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).hint("merge")
    there = segments.withColumn("copy", F.pmod(F.xxhash64("seg"), F.lit(SPREAD)).cast("int")).join(wide, ["rep", "copy"])
    return own.unionByName(there.select("rep", each("parts").alias("part"), hashed("seg", "salts").alias("salt"), F.lit(1).alias("kind"), "doc_id", "text_hash", "first", "words"))


def _places(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Stored (doc_id, text_hash, first, last): word spans of documents that recurring passages cover."""
    anchors = stored(_anchors(docs, window, gram), "anchors")
    twice = anchors.groupBy("g").agg(F.min(F.xxhash64("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Stored, so that Spark may split the join of a frequent anchor.
    twice = stored(twice, "recurring")
    places = stored(anchors.join(twice, "g").groupBy(*_named()).agg(F.collect_set(F.struct("pos", "rep")).alias("places")), "anchor-places")
    dropped(anchors)
    dropped(twice)
    marked = docs.join(places, _same(docs, places)).select("doc_id", "text_hash", "text", "places")
    segments = stored(_segments(marked, window, gram).withColumn("seg", F.monotonically_increasing_id()), "segments")
    dropped(places)
    chosen = _windows(segments, window, gram).groupBy("h").agg(F.min("seg").alias("seg"), F.count("*").alias("n")).filter("n > 1")
    chosen = segments.join(chosen.groupBy("seg").agg(F.collect_list("h").alias("hs")), "seg")
    passages = stored(_passages(chosen, window), "passages")
    found = stored(_located(_dealt(passages, segments), window), "passage-places")
    dropped(segments)
    dropped(passages)
    return found


def _named():
    return [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]


def _same(docs: DataFrame, named: DataFrame):
    return docs["doc_id"].eqNullSafe(named["_id"]) & (docs["text_hash"] == named["_hash"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document.

    A null or empty text has no words; a very long text is only more segments, and its words need
    no signs of their own; repeated rows are each other's repeats, and of equal passages none is
    spared; a text shorter than the window keeps all words; an empty table gives no rows; other
    columns are ignored. Rows of one doc_id with different texts stay apart by a hash of the text.
    """
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    spans = _places(docs, window, gram).groupBy(*_named()).agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone_of = batch.column("spans").to_pylist()
            for a, b, words in _chunks(texts(batch)):
                removed, kept = [], []
                for w, gone in zip(words, gone_of[a:b]):
                    stay = w
                    if gone:
                        out = np.zeros(len(w) + 1, np.int64)
                        for span in gone:
                            out[span["first"]] += 1
                            out[span["last"]] -= 1
                        stay = [w[i] for i in np.flatnonzero(np.cumsum(out)[:-1] == 0)]
                    removed.append(len(w) - len(stay))
                    kept.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, words)), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return docs.join(spans, _same(docs, spans), "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
