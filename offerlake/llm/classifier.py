"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Features are ratios of one whole text, computed where the row lies. A pair holds a row of label 1
and a row of label 0; the logistic loss on the difference of their features gives weights, so a
document's score is the log-odds by which it is preferred. The cut is the score quantile of the
training rows that parts the labels best.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import texts

#: Labelled rows that the fit takes at most (expected number; they are drawn by a hash of doc_id).
SAMPLE_ROWS = 20_000
PAIRS_PER_ROW, L2, CUT = 8, 1e-3, 0.3
#: Byte classes whose share in a text is a feature.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"!", b"?", b".,;:", b"|", b"#*$%&<>", b"\"'()[]{}/\\@^_`~+=-", bytes(range(128, 256))]
SIZE = 2 * (len(CLASSES) + 6) + 3
_MEMBER = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES):
    _MEMBER[list(_bytes), _k] = 1


def features(text: bytes | None) -> np.ndarray:
    """Features of one whole text; a null text counts as empty."""
    text = text or b""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(len(words), 1), max(len(text), 1)
    distinct, lengths = set(words), list(map(len, words))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBER / size
    some = [x for x in lines if x and not x.isspace()]
    ratios = np.array([
        *shares,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(distinct) / n,
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(some)) / max(len(some), 1),
        min(sum(lengths) / n / 20, 1),
        min(max(lengths, default=0) / 200, 1),
    ])
    return np.concatenate([ratios, np.sqrt(ratios), [np.log1p(len(words)), np.log1p(len(some)), np.log1p(len(words) / max(len(some), 1))]])


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, v): one row for each document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))], names=["doc_id", "v"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """score(text) = sigmoid(w . (features - mean) / scale - t + logit(CUT)); t is the cut of the raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    rows: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)) + 1e-9  # rounding never drops a score at the cut
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry on rows x with labels y. With one label only, or no rows, every text scores at the cut."""
    flat = Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, len(y))
    if len(set(y.tolist())) < 2:
        return flat
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z, rng = (x - mean) / scale, np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = PAIRS_PER_ROW * min(len(good), len(bad)) + max(len(good), len(bad))
    d = z[good[rng.permutation(pairs) % len(good)]] - z[bad[rng.permutation(pairs) % len(bad)]]
    w = np.zeros(SIZE)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / pairs - L2 * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + L2 * np.eye(SIZE), gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    cuts = np.quantile(raw, np.linspace(0.002, 0.998, 499))
    balanced = [((raw[good] >= c).mean() + (raw[bad] < c).mean()) for c in cuts]
    best = np.flatnonzero(np.array(balanced) >= max(balanced) - 1e-12)
    return Model(mean, scale, w, float(cuts[best[len(best) // 2]]), len(y))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Labels of one doc_id are averaged, and so are the features of its copies, hence the driver
    receives one row of SIZE numbers for each sampled id and no more.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    ids = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    share = min(1.0, sample_rows / max(ids.count(), 1))
    drawn = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = _feature_rows(docs.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi"))
    mean = rows.groupBy("doc_id").agg(*[F.avg(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)])
    got = mean.join(drawn, "doc_id").orderBy("doc_id").toPandas()
    return fit_pairs(got[[f"v{i}" for i in range(SIZE)]].to_numpy(float).reshape(-1, SIZE), got["y"].to_numpy(int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns score and predicted (1 where score >= 0.3).

    Empty, null and very long texts are scored as any other; repeated rows are scored alike; an
    empty table gives no rows; extra columns pass, but columns of docs named score or predicted are
    replaced (select() keeps them).
    """
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([features(t) for t in texts(batch)]).reshape(-1, SIZE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=schema.names)

    return kept.mapInArrow(run, schema)


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with predicted 1, with all their columns of any name as they are."""
    names = [c if c == "text" else f"column{k}" for k, c in enumerate(docs.columns)]
    rows = score(docs.toDF(*names), model).filter("predicted = 1").select(*names)
    return rows.toDF(*docs.columns)
