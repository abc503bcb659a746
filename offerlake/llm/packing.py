"""Packing: tokens of all documents, end to end, cut into windows of a fixed length.

Concatenate and cut in two passes. The first pass tokenizes each input partition once and stores
every document's ids with the number of tokens before it in its partition. The partition totals
(one row for each partition) give every partition its global offset by a prefix sum. The second
pass cuts each document at the multiples of the window length. No row is shuffled, no partition
is held whole, and a very long document is only a longer run of cuts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored, texts

#: Words whose ids one Python worker remembers, the longest such word in bytes, and the bytes of text split at a time.
CACHE_WORDS, CACHE_BYTES, CHUNK = 1_000_000, 48, 8 << 20
#: Marks that are looked up by themselves after a letter of _LETTERS, as other letters may become a letter and a sign.
MARKS = ".,;:!?|"
#: Lower-case letters of ASCII and Latin-1: none is changed by lower-casing or joined with another by NFC.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SPACE = re.compile(rb"[\x09-\x0D ]")
_caches: dict[str, "_WordIds"] = {}


class _WordIds(dict):
    """Ids of words as little-endian bytes.

    The tokenizer never merges across ASCII white space, so a text's ids are its words' ids in
    order. It lowers the case itself and takes letters and marks apart: words are remembered with
    A-Z lowered, unless the text may hold a special token, and a mark after a letter is looked up
    by itself. Words of plain letters go to the tokenizer's model at once. The memory is bounded
    and refilled on demand.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model, self.letters = self.tokenizer.model, {}
        for c in map(chr, range(0x61, 0x100)):
            if _LETTERS.fullmatch(c):
                self.letters[ord(c)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        self.marks = dict(zip(MARKS, self._encode(list(MARKS))))

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array(self.dtype.char, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_letters(self, word: str) -> bytes:
        """Ids of a word that normalization leaves as it is and that stays in one piece, from the tokenizer's model."""
        return array(self.dtype.char, [x.id for x in self.model.tokenize(word.translate(self.letters))]).tobytes()

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of some different words; those not known yet are taken in, unless they are long."""
        out = list(map(self.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
        parts, cores = [], {}
        for k in new:
            word, mark = words[k], ""
            s = word.decode("utf-8", "replace")
            if len(word) <= CACHE_BYTES and len(s) > 1 and s[-1] in MARKS and _LETTERS.fullmatch(s[-2].lower()):
                s, mark = s[:-1], s[-1]
            parts.append((k, s, mark))
            cores[s] = None
        rest = [s for s in cores if not _LETTERS.fullmatch(s)]
        known = {s: self._of_letters(s) for s in cores.keys() - rest} | dict(zip(rest, self._encode(rest)))
        for k, s, mark in parts:
            out[k] = ids = known[s] + self.marks[mark] if mark else known[s]
            if len(words[k]) <= CACHE_BYTES:
                self[words[k]] = ids
        return out


def _word_ids(path: str) -> _WordIds:
    if path not in _caches:
        _caches[path] = _WordIds(path)
    return _caches[path]


def _chunks(text: bytes | None) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes that end at white space."""
    text, at = text or b"", 0
    while len(text) - at > CHUNK and (m := _SPACE.search(text, at + CHUNK)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def _ids_of(batch: list[bytes | None], words: _WordIds, end: bytes) -> Iterator[bytes]:
    """Ids of each text with the end id, as bytes; about CHUNK bytes of text are split at a time.

    Each different word of them is looked up once, and Arrow puts the ids in the order of the text.
    """
    waiting: list[tuple[bytes, bool]] = []  # a part, and whether it ends its text
    size, head = 0, b""

    def flush() -> Iterator[bytes]:
        nonlocal head
        split = pc.ascii_split_whitespace(pa.array([x for x, _ in waiting], pa.binary()).view(pa.string()))
        coded = split.flatten().dictionary_encode()
        ids = pa.array(words.of(coded.dictionary.view(pa.binary()).to_pylist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(waiting) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        for (_, last), a, b in zip(waiting, ends, ends[1:]):
            head += data[a:b]
            if last:
                yield head + end
                head = b""

    for text in batch:
        parts = list(_chunks(text if text is None or b"<|" in text else text.lower()))
        for k, part in enumerate(parts):
            waiting.append((part, k == len(parts) - 1))
            size += len(part)
            if size >= CHUNK:
                yield from flush()
                waiting, size = [], 0
    yield from flush()


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored table (part, before, doc_id, n, ids): ids in the tokenizer's narrowest integer type."""
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
        docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = _word_ids(tokenizer), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize
        for batch in batches:
            ids = list(_ids_of(texts(batch), words, end))
            n = [len(x) // width for x in ids]
            starts = list(accumulate(n, initial=before))
            before = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "before", "doc_id", "n", "ids"],
            )

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it comes from and where it lies.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids when
    with_ids is set. Every sequence but the last is full, so padding is below one window in all.
    A null or empty text is its end id alone; repeated rows are packed as often as they occur; a
    null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    table = token_table(docs, tokenizer, end_id)
    # One row for each input partition: the bound is the number of tasks of the first pass.
    totals = sorted(table.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).collect())
    base = dict(zip([r.part for r in totals], accumulate([r.n for r in totals], initial=0)))
    dtype = _word_ids(tokenizer).dtype
    schema = T.StructType([
        docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, pieces = [], [], []
            for i, (part, before, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "before", "ids")))):
                wide, at = np.frombuffer(ids, dtype).astype("<u4"), base[part] + before
                cuts = [0, *range(window - at % window, len(wide), window), len(wide)]
                for a, b in zip(cuts, cuts[1:]):
                    owner.append(i)
                    rows.append((a, b - a, zlib.crc32(wide[a:b]), len(wide), (at + a) // window, (at + a) % window))
                    if with_ids:
                        pieces.append(wide[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *map(pa.array, np.array(rows, np.int64).reshape(-1, 6).T)]
            if with_ids:
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *pieces]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """Rows (sequence_id, ids) of pack(with_ids=True), padded to the window unless the length is a power of two.

    A group holds one window of ids at most.
    """
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids")
    )
    n = F.size("ids")
    full = n.bitwiseAND(n - 1) == 0
    return joined.select("sequence_id", F.when(full, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))).alias("ids"))
