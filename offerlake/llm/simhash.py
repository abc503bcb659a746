"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of five segments. If two fingerprints differ in at most four bits, then
from some segment on, each chain of l consecutive segments differs in at most floor(4 l / 5) bits:
the first segment is equal, the first two differ in at most one bit, the first three in two. The
first two segments make the key: one fingerprint asks with the second segment as it is and with
each of its bits turned, so that chains within the budget meet under one key of about 26 bits.
What meets is held against the longer chains and then the full distance.

near_duplicates() takes one fingerprint of a text's word shingles. Four of its 64 bits are a cosine
of about 0.98, which most copies with a few changed words miss. deduplicate() therefore searches
with FAMILIES fingerprints of the words themselves, which move less, holds what meets against 128
bits over five-word shingles, of which two texts of the asked similarity differ in few enough, and
last compares the shingles of linked texts themselves.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, stored, texts
from .components import components

#: Words of a shingle, bits that linked fingerprints may differ in, and the segments' widths.
SHINGLE, DISTANCE, WIDTHS = 4, 4, (13, 13, 13, 13, 12)
#: Of deduplicate(): words of a shingle, similarity of near copies, word fingerprints (64 bits each) and shingle bits.
NEAR_SHINGLE, SIMILARITY, FAMILIES, CHECK = 5, 0.8, 3, 128
#: Links of one text that one task checks; texts with more are dealt to several.
LINKS = 1_000
#: Members of a key up to which all its pairs are compared at once; larger ones are searched from member to member.
PAIRS = 12
#: Links that one batch of a large key holds, about.
PAIR_ROWS = 50_000
#: Words whose hashes one Python worker remembers; bytes of a word beyond which its weight stays.
CACHE_WORDS, LONG_WORD = 100_000, 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FROM = [sum(WIDTHS[:i]) for i in range(5)]
_MASKS = np.array([((1 << w) - 1) << s for w, s in zip(WIDTHS, _FROM)], np.uint64)
_BLOCK = 1 << 14


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = xxhash.xxh3_128_digest(word) + xxhash.xxh64_digest(word)
        if len(word) <= 64:
            self[word] = out
        return out


_digests = _Digests()


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def _shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    """All runs of k words, joined by one space; all words where there are fewer."""
    joined, n = b" ".join(words), max(len(words) - k + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(k, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    return map(joined.__getitem__, map(slice, first, last))


def _majority(hashes: np.ndarray) -> bytes:
    """Of rows of bytes: each bit that is set in over half the rows."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one whole text; 0 where there is no word."""
    words = _words(text)
    if not words:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, _shingles(words, shingle), repeat(42)), np.uint64, max(len(words) - shingle + 1, 1))
    return int.from_bytes(_majority(hashes.view(np.uint8).reshape(-1, 8)), "little")


def mark(text: bytes | None, shingle: int = NEAR_SHINGLE) -> tuple[bytes, bytes]:
    """FAMILIES fingerprints of one whole text's words, and CHECK bits of its different shingles; zeros where there is no word.

    A word weighs the square root of its count times its length, so that neither words that every
    text has nor a single changed word decide many bits.
    """
    words = _words(text)
    if not words:
        return bytes(8 * FAMILIES), bytes(CHECK // 8)
    counts = Counter(words)
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))) * np.minimum(np.fromiter(map(len, counts), np.float64, len(counts)), LONG_WORD)
    hashes = np.frombuffer(b"".join(map(_digests.__getitem__, counts)), np.uint8).reshape(-1, 8 * FAMILIES)
    sums = np.zeros(64 * FAMILIES)
    for at in range(0, len(hashes), _BLOCK):
        sums += weights[at : at + _BLOCK] @ np.unpackbits(hashes[at : at + _BLOCK], axis=1, bitorder="little")
    parts = b"".join(map(xxhash.xxh3_128_digest, set(_shingles(words, shingle))))
    return np.packbits(sums * 2 > weights.sum(), bitorder="little").tobytes(), _majority(np.frombuffer(parts, np.uint8).reshape(-1, CHECK // 8))


def allowed(similarity: float = SIMILARITY) -> int:
    """Of CHECK bits, how many two texts may differ in whose shingle sets are this similar: the expected number and three deviations.

    Sets of Jaccard similarity s have a cosine of 2 s / (1 + s), and each bit differs with the share of the angle in a half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(CHECK * share + 3 * math.sqrt(CHECK * share * (1 - share)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("bits", T.LongType())]))


def marks(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, words, bits) of each row of docs: the mark of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [mark(t, shingle) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([m[k] for m in of], pa.binary()) for k in (0, 1))], names=["doc_id", "words", "bits"])
        _digests.clear()  # the worker lives on and has other work

    schema = T.StructType([docs.schema["doc_id"], T.StructField("words", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _keys(bits: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring keys of fingerprints (family, start, first segment, second segment as it is and with each bit turned) and whose they are."""
    segments = [(bits >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(_FROM, WIDTHS)]
    keys = []
    for i in range(5):
        j = (i + 1) % 5
        head = (np.uint64(family) << np.uint64(29)) | (np.uint64(i) << np.uint64(26)) | (segments[i] << np.uint64(13))
        keys += [head | (segments[j] ^ np.uint64(turned)) for turned in [0, *(1 << b for b in range(WIDTHS[j]))]]
    return np.concatenate(keys).astype(np.int64), np.tile(np.arange(len(bits)), len(keys))


def _near(apart: np.ndarray, keys: np.ndarray, check: int) -> np.ndarray:
    """Whether differing bits (the fingerprint's, then the check's) keep the budgets of the chains from the keys' start on, of the whole and of the check."""
    start, own = (keys >> 26) & 7, apart[:, 0]
    within, mask = np.ones(len(apart), bool), np.zeros(len(apart), np.uint64)
    for length in range(1, 5):
        mask = mask | _MASKS[(start + length - 1) % 5]
        within &= np.bitwise_count(own & mask) <= DISTANCE * length // 5
    within &= np.bitwise_count(own) <= DISTANCE
    return within & (np.bitwise_count(apart[:, 1:]).sum(1) <= check)


def _forest(members: np.ndarray, key: int, check: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that connect what is near within one key, at most one for each member."""
    links, left = [], members
    while len(left):
        front, left = [left[:1]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(left ^ x, np.full(len(left), key), check)
            if near.any():
                found, left = left[near], left[~near]
                links.append((np.repeat(x, len(found), 0), found))
                front += np.split(found, len(found))
    return links


def _across(members: np.ndarray, labels: np.ndarray, key: int, check: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links within one key between members of different labels, a block of at most about PAIR_ROWS at a time.

    Two members meet in several keys of a family: at each start from which they keep their budgets, and there in 14 keys
    if their second segments agree, in two if these differ. They are linked in one of them, the
    first start and the smaller of their second segments.
    """
    a, b, n = [], [], 0
    start, asked = key >> 26 & 7, key & (1 << 13) - 1
    j = (start + 1) % 5
    second = (members[:, 0] >> np.uint64(_FROM[j])) & np.uint64((1 << WIDTHS[j]) - 1)
    for i in range(len(members) - 1):
        rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        rest = rest[np.minimum(second[rest], second[i]) == asked]
        near = rest[_near(members[rest] ^ members[i], np.full(len(rest), key), check)] if len(rest) else rest
        for earlier in range(start):
            near = near[~_near(members[near] ^ members[i], np.full(len(near), earlier << 26), check)]
        if len(near):
            a.append(np.repeat(members[i : i + 1], len(near), 0))
            b.append(members[near])
            n += len(near)
        if n >= PAIR_ROWS:
            yield np.concatenate(a), np.concatenate(b)
            a, b, n = [], [], 0
    if n:
        yield np.concatenate(a), np.concatenate(b)


def links(prints: DataFrame, check: int | None = None, labelled: bool = False) -> DataFrame:
    """Links (a, b) that connect all fingerprints within DISTANCE of each other.

    Without check, prints has bits (a long, distinct), which are both the fingerprint and what is
    linked. With it, prints has words (FAMILIES fingerprints) and bits (CHECK bits): bits are
    linked where the fingerprints of one family are within DISTANCE and at most check of the bits
    differ. Equal fingerprints are one member beforehand, so a key holds as many members as there
    are different fingerprints with 25 equal bits, not as many as there are copies. Within a key
    of many members, at most one link for each is made, never all pairs. With labelled, prints has
    a label too, and the links are all those between members of different labels.
    """
    alone = check is None
    columns = ["own"] if alone else ["own", *(f"c{k}" for k in range(CHECK // 64)), *["label"] * labelled]

    def numbers(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = batch.column("bits").to_numpy().view(np.uint64).reshape(-1, 1) if alone else numbers(batch.column("words"))
            nodes = families[:, :0] if alone else numbers(batch.column("bits"))
            if labelled:
                nodes = np.concatenate([nodes, batch.column("label").to_numpy().view(np.uint64).reshape(-1, 1)], 1)
            for at in range(0, len(families), 4096):
                for family in range(families.shape[1]):
                    own = families[at : at + 4096, family]
                    keys, whose = _keys(own, family)
                    row = np.concatenate([own[:, None], nodes[at : at + 4096]], 1)[whose]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, row.T.copy().view(np.int64))], names=["key", *columns])

    def ends_of(sides: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(side) for side in zip(*sides))
        if alone:
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64)) for x in (a, b)], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in np.ascontiguousarray(x[:, 1:])], pa.binary()) for x in (a, b)], names=["a", "b"])

    def between(keys: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(keys)) + 1
        labels, bits = bits[:, -1], bits[:, :-1]
        for first, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])):
            if end - first > 1 and (labels[first:end] != labels[first]).any():
                for side in _across(bits[first:end], labels[first:end], int(keys[first]), check):
                    yield ends_of([side])

    def found(keys: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(keys)) + 1
        firsts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        size = ends - firsts
        some = np.repeat((size > 1) & (size <= PAIRS), size)
        k, b = keys[some], bits[some]
        sides = [(bits[:0], bits[:0])]
        for d in range(1, PAIRS):
            if len(k) <= d:
                break
            same = np.flatnonzero(k[d:] == k[:-d])
            same = same[_near(b[same + d] ^ b[same], k[same], check or 0)]
            sides.append((b[same], b[same + d]))
        for i in np.flatnonzero(size > PAIRS):
            sides += _forest(bits[firsts[i] : ends[i]], int(keys[firsts[i]]), check or 0)
        yield ends_of(sides)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key. The last key of a batch waits for the next."""
        rest_k, rest_b = np.zeros(0, np.int64), np.zeros((0, len(columns)), np.uint64)
        for batch in batches:
            keys = np.concatenate([rest_k, batch.column("key").to_numpy()])
            bits = np.concatenate([rest_b, np.stack([batch.column(c).to_numpy() for c in columns], 1).view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            rest_k, rest_b = keys[cut:], bits[cut:]
            if cut:
                yield from made(keys[:cut], bits[:cut])
        if len(rest_k):
            yield from made(rest_k, rest_b)

    made = between if labelled else found
    asked = prints.select("bits", *["words"] * (not alone), *["label"] * labelled).mapInArrow(ask, ", ".join(f"{c} bigint" for c in ("key", *columns)))
    # The further order makes the same member the first of all keys of a crowd, so that most of its links are the same.
    ordered = asked.repartition("key").sortWithinPartitions("key", *columns[::-1])
    kind = prints.schema["bits"].dataType
    return ordered.mapInArrow(meet, T.StructType([T.StructField(c, kind) for c in "ab"]))


def _similar(edges: DataFrame, rows: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of marks whose texts' shingle sets are of the similarity or more; named is (doc_id, text)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("bits")).distinct()
    which = rows.join(ends, "bits", "left_semi").groupBy("bits").agg(F.min("doc_id").alias("doc_id"))
    # Of copies one text is read.
    known = named.join(which, "doc_id").groupBy("bits").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _shingles(w, shingle)), np.uint64)).tobytes() if (w := _words(t)) else b"" for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("bits"), pa.array(found, pa.binary())], names=["bits", "found"])

    grams = stored(known.mapInArrow(sets, "bits binary, found binary"), "shingles")
    many = edges.groupBy("a").count().filter(F.col("count") > LINKS).select("a", F.ceil(F.col("count") / LINKS).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = grams.withColumnsRenamed({"bits": "a", "found": "of_a"}).join(many, "a", "left").select("a", "of_a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    right = edges.join(grams.withColumnsRenamed({"bits": "b", "found": "of_b"}), "b").join(many, "a", "left").withColumn("salt", F.pmod(F.hash("b"), salts).cast("int"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    return right.join(left, ["a", "salt"]).select("a", "b", "of_a", "of_b").mapInArrow(compare, "a binary, b binary")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _torn(rows: DataFrame, met: DataFrame, alike: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame | None:
    """The links of similar texts that the first search has not asked for; None where there can be none.

    Within a key of many members the search makes one link for each. Where such a link is between texts
    that are not similar enough, the group that it held together is torn into parts, and one of its texts may be similar to
    another of a different part. So in torn groups every pair of different parts that meets is compared. What is linked then
    does not depend on how many members a key has.
    """
    trees = components(met)
    parts = components(alike)
    whole = trees.join(parts.withColumnRenamed("root", "part"), "node", "left").select("node", "root", F.coalesce("part", "node").alias("part"))
    whole = stored(whole, "parts")
    dropped(trees)
    dropped(parts)
    torn = whole.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("root")
    again = stored(whole.join(torn, "root", "left_semi").select(F.col("node").alias("bits"), F.xxhash64("part").alias("label")), "torn")
    dropped(whole)
    if again.isEmpty():
        return None
    members = rows.select("words", "bits").distinct().join(again, "bits")
    across = _ordered(links(members, allowed(similarity), labelled=True)).join(met, ["a", "b"], "left_anti")
    across = stored(across, "links-across")
    dropped(again)
    return stored(_similar(across, rows, named, shingle, similarity), "links-more")


def _found(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(bits, component_id) of prints (bits, least): the smallest doc_id that links reach."""
    roots = components(edges)
    member = prints.join(roots, prints["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    member = stored(member, "members")
    dropped(roots)
    return member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")


def _prints(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bits").agg(F.min("doc_id").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach).

    A null or empty text has fingerprint zero and links as any other; a very long text is hashed
    in blocks. Repeated rows get equal results, and of equal ids none is preferred; a null doc_id
    is kept and never becomes a component_id unless nothing else is there; an empty table gives no
    rows; other columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle), "simhash")
    prints = _prints(rows)
    return rows.join(_found(prints, links(prints)), "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, nulls last (of rows that repeat it, the first by text hash).

    Near copies are texts whose word fingerprints link and whose shingle sets are of the similarity
    or more. Null and empty texts are copies of each other; a very long text is
    hashed in blocks; of rows that repeat both id and text any stays, since they are alike but for
    other columns; an empty table gives no rows; extra columns of any name stay as they are.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    # Rows are named by id and text, since an id may be null or stand for several texts.
    name = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", text_hash.alias("hash"))
    named = docs.select(name.alias("doc_id"), "text")
    rows = stored(marks(named, shingle), "marks")
    prints = _prints(rows)
    met = links(rows.select("words", "bits").distinct(), allowed(similarity))
    met = stored(_ordered(met), "links-met")
    alike = stored(_similar(met, rows, named, shingle, similarity), "links-alike")
    more = _torn(rows, met, alike, named, shingle, similarity)
    found = _found(prints, alike if more is None else alike.unionByName(more))
    kept = docs.select(F.struct("*").alias("row"), name.alias("name")).join(found.select(F.col("component_id").alias("name")).distinct(), "name", "left_semi")
    # Only rows that repeat both id and text meet here; groups are single rows in a sound corpus.
    return kept.groupBy("name").agg(F.first("row").alias("row")).select("row.*")
