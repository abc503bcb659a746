"""Nearest neighbours by largest inner product: adaptive dimension scan of probed lists.

Index. Equal vectors become one, which keeps the ids that can ever be among the nearest (one more
than are asked for, the smallest first). A k-means fit on a bounded sample gives the centres, and
every vector goes to the list of its nearest centre; a list is cut into blocks of bounded size.

Search. Vectors are turned by one random rotation and read in blocks of columns. After each block
a hypothesis test holds the partial distance, scaled up to all dimensions, against the distance that the
query's last place still allows: a candidate that is significantly farther is abandoned, the others
read on. What survives all blocks is scored on the original vectors in double precision. The nearest list
of a query is searched first, then rounds of four times as many; the last place so far is the bound of the next round.

How many lists a query probes is measured, not guessed: a bounded sample of queries is answered by
brute force over all vectors, and the least number of lists that hold RECALL of their neighbours is
taken. On data without structure that may be most of the lists, on grouped data a few.

Defined cases: null and zero vectors and those that hold null, NaN or infinite entries take no part, nor do vectors of
another length than most have (the longer of two as common). A row leaves out itself only:
other rows with its id or its vector are candidates, and each of several rows with one id is
answered. Ties go to the smaller id, null ids last; a null id asks nothing. With fewer
candidates than places all are returned. An empty table, or one without queries, gives an empty result; other columns
are not read. What depends on chance (rotation, sample) comes from fixed seeds and hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, stored

#: Neighbours of a query, and which ids ask.
PLACES, EVERY = 20, 20
#: Rows of a list on average, and most lists; beyond their product lists grow.
LIST_ROWS, MOST_LISTS = 1024, 4096
#: Vectors that centres are fitted on, and rounds of the fit.
SAMPLE_ROWS, FIT_ROUNDS = 65_536, 8
#: Queries answered by brute force to choose the number of probed lists, and the share of neighbours these must hold.
TRIAL_QUERIES, RECALL = 256, 0.96
#: Columns of one block, and how many standard errors beyond its bound a candidate must lie to be abandoned.
COLUMNS, ERRORS = 16, 2.1
#: Lists are probed in rounds, each to so many times the lists of the round before; the bound is drawn tighter in between.
GROWTH = 4
#: Rows of a block of a list and queries of one group; pairs of one step are QUERY_STEP by ROW_STEP.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048
QUERY_STEP, ROW_STEP = 128, 512

_KEY = ["h1", "h2"]


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


@lru_cache(4)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2): vectors that take part; h1 and h2 stand for the vector."""
    v = F.col("embedding")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    some = vectors.select("vec_id", v.alias("v")).filter(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0))
    lengths = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return some.filter(F.size("v") == (lengths["d"] if lengths else -1)).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def distinct(rows: DataFrame, places: int) -> DataFrame:
    """(h1, h2, v, ids): each different vector with the ids of its first places + 1 rows, smallest first."""
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.asc_nulls_last("vec_id")))
    first = rows.withColumn("place", place).filter(F.col("place") <= places + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"])
    return first.groupBy(*_KEY).agg(F.first("v").alias("v"), ids.alias("ids"))


def fit(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centres of k lists by k-means; a centre that loses all its vectors moves to the vector farthest from its own."""
    rng = np.random.default_rng(11)
    centres = sample[rng.permutation(len(sample))[:k]].astype(np.float32)
    for _ in range(rounds if k > 1 else 0):
        near, far = nearest_centres(sample, centres)
        sums, n = np.zeros_like(centres, dtype=np.float64), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        lost = np.flatnonzero(n == 0)
        centres[lost] = sample[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (centres * centres).sum(axis=1) / 2
    best = [((b := half - x[k : k + 4096] @ centres.T).argmin(axis=1), b.min(axis=1)) for k in range(0, len(x), 4096)]
    near, value = (np.concatenate(p) for p in zip(*best)) if best else (np.zeros(0, int), np.zeros(0))
    return near, 2 * value + (x * x).sum(axis=1)


class _Found:
    """The best candidates of each query so far, by score and then by least id."""

    def __init__(self, bound: np.ndarray, places: int):
        self.bound, self.places = bound.copy(), places
        self.q, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.least = np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, b: np.ndarray, score: np.ndarray, least: np.ndarray) -> None:
        good = score >= self.bound[q]
        q, b, score, least = (np.concatenate((old, new[good])) for old, new in ((self.q, q), (self.b, b), (self.score, score), (self.least, least)))
        order = np.lexsort((least, -score, q))
        q, b, score, least = q[order], b[order], score[order], least[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.places
        self.q, self.b, self.score, self.least = q[keep], b[keep], score[keep], least[keep]
        last = place[keep] == self.places - 1
        np.maximum.at(self.bound, self.q[last], self.score[last])


def scan(rows: np.ndarray, least: np.ndarray, queries: np.ndarray, bound: np.ndarray, places: int) -> _Found:
    """The places best rows for each query with a score of at least its bound, by the adaptive scan."""
    d = rows.shape[1]
    turn = rotation(d)
    x, y = rows.astype(np.float32) @ turn, queries.astype(np.float32) @ turn
    rows, queries = rows.astype(np.float64), queries.astype(np.float64)
    cuts = [(k, min(k + COLUMNS, d)) for k in range(0, d, COLUMNS)]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    found = _Found(bound, places)
    for q0 in range(0, len(y), QUERY_STEP):
        for r0 in range(0, len(x), ROW_STEP):
            a, b = y[q0 : q0 + QUERY_STEP], x[r0 : r0 + ROW_STEP]
            # What the distance may be at most for the score to reach the bound, with room for the rounding of floats.
            total = yy[q0 : q0 + QUERY_STEP, None] + xx[None, r0 : r0 + ROW_STEP]
            allowed = total * (1 + 1e-5) - 2 * found.bound[q0 : q0 + QUERY_STEP, None].astype(np.float32)
            part, alive, q, r = np.zeros(allowed.shape, np.float32), np.ones(allowed.shape, bool), None, None
            for low, high in cuts:
                if q is None:
                    u, w = a[:, low:high], b[:, low:high]
                    part += (u * u).sum(axis=1)[:, None] + (w * w).sum(axis=1)[None, :] - 2 * (u @ w.T)
                else:
                    step = a[q, low:high] - b[r, low:high]
                    part += (step * step).sum(axis=1)
                test = (1 + ERRORS / np.sqrt(high)) ** 2 * high / d if high < d else 1.0
                near = part <= allowed * test
                if q is None:
                    alive &= near
                    if np.count_nonzero(alive) * 4 < alive.size:
                        q, r = np.nonzero(alive)
                        part, allowed = part[q, r], allowed[q, r]
                else:
                    q, r, part, allowed = q[near], r[near], part[near], allowed[near]
                if q is not None and not len(q):
                    break
            if q is None:
                q, r = np.nonzero(alive)
            if len(q):
                q, r = q + q0, r + r0
                found.add(q, r, (queries[q] * rows[r]).sum(axis=1), least[r])
    return found


def _largest_last(ids: pa.ChunkedArray) -> np.ndarray:
    """The first id of each list; nulls come after all others."""
    firsts = [x[0] for x in ids.to_pylist()]
    return np.array([np.iinfo(np.int64).max if x is None else x for x in firsts], np.int64)


def _searched(index: DataFrame, asked: DataFrame, blocks: Column, chunks: Column, places: int) -> DataFrame:
    """(q1, q2, score, ids, same): the best of each block for the queries (h1, h2, v, list, bound) that probe its list."""
    places += 1
    ids = dict(index.dtypes)["ids"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = lambda t, k, c: t.column(k).combine_chunks().take(pa.array(c, pa.int64()))
        if len(left) and len(right):
            bound = right.column("bound").to_numpy()
            got = scan(_matrix(left.column("v")), _largest_last(left.column("ids")), _matrix(right.column("v")), bound, places)
            q, b = got.q, got.b
        else:
            left, right, q, b = left.slice(0, 0), right.slice(0, 0), [], []
        columns = [at(right, "h1", q), at(right, "h2", q), pa.array(got.score if len(q) else [], pa.float64()), at(left, "ids", b), at(left, "h1", b), at(left, "h2", b)]
        return pa.table(columns, names=["q1", "q2", "score", "ids", "h1", "h2"])

    group = ["list", "block", "chunk"]
    rows = index.withColumns({"block": F.pmod("h1", blocks), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    asked = asked.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)), "chunk": F.pmod("h2", chunks)})
    met = rows.select(*group, *_KEY, "v", "ids").groupBy(*group).cogroup(asked.select(*group, *_KEY, "v", "bound").groupBy(*group))
    out = met.applyInArrow(run, f"q1 long, q2 long, score double, ids {ids}, h1 long, h2 long")
    return out.select("q1", "q2", "score", "ids", ((F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2"))).alias("same"))


def _best(found: DataFrame, places: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0])))
    return found.withColumn("place", place).filter(F.col("place") <= places + 1).drop("place")


def _probes(index: DataFrame, asking: DataFrame, centres: np.ndarray, places: int, queries: int, recall: float) -> int:
    """Lists that hold the wanted share of the neighbours of a sample of queries, which are found by brute force."""
    chosen = asking.orderBy(*_KEY).limit(queries).collect()
    if not chosen:
        return 1
    q = np.array([r["v"] for r in chosen], np.float64)
    keys = np.array([[r["h1"], r["h2"]] for r in chosen], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for b in batches:
            score = q @ _matrix(b.column("v")).astype(np.float64).T
            own = (keys[:, 0, None] == b.column("h1").to_numpy()) & (keys[:, 1, None] == b.column("h2").to_numpy())
            score = np.hstack((best[0], np.where(own, -np.inf, score)))
            lists = np.hstack((best[1], np.broadcast_to(b.column("list").to_numpy(), own.shape)))
            top = np.argsort(-score, axis=1, kind="stable")[:, :places]
            best = np.take_along_axis(score, top, 1), np.take_along_axis(lists, top, 1)
        i, j = np.nonzero(np.isfinite(best[0]))
        yield pa.record_batch({"q": pa.array(i, pa.int32()), "score": pa.array(best[0][i, j]), "list": pa.array(best[1][i, j], pa.int32())})

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    near = index.select(*_KEY, "v", "list").mapInArrow(run, "q int, score double, list int").withColumn("place", place).filter(F.col("place") <= places).collect()
    ranks = np.argsort(np.argsort(-(q @ centres.T.astype(np.float64)), axis=1, kind="stable"), axis=1)
    held = np.sort([ranks[r["q"], r["list"]] for r in near])
    return int(held[int(np.ceil(recall * len(held))) - 1]) + 1 if len(held) else 1


def search(
    vectors: DataFrame, places: int = PLACES, every: int = EVERY, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS,
    sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each row whose id is divisible by `every`, among all other rows."""
    rows = usable(vectors)
    asks = rows.filter(F.col("vec_id") % every == 0)
    base = stored(distinct(rows, places), "vectors")
    n = base.count()
    k = max(1, min(most_lists, -(-n // list_rows)))
    share = F.pmod("h2", F.lit(1 << 30)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = _matrix(base.filter(share).orderBy(*_KEY).select("v").toArrow().column("v")).astype(np.float32)
    centres = fit(sample, k) if len(sample) else np.zeros((k, 0), np.float32)
    k = max(1, len(centres))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near, _ = nearest_centres(_matrix(b.column("v")).astype(np.float32), centres)
                yield b.append_column("list", pa.array(near, pa.int32()))

    index = stored(base.mapInArrow(assigned, f"{_ddl(base)}, list int"), "lists")
    dropped(base)
    asking = stored(asks.groupBy(*_KEY).agg(F.first("v").alias("v")), "queries")
    probes = _probes(index, asking, centres, places, TRIAL_QUERIES, recall)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                order = np.argsort(-(_matrix(b.column("v")).astype(np.float64) @ centres.T.astype(np.float64)), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel()))
                yield b.append_column("lists", lists)

    asked = stored(asking.mapInArrow(listed, f"{_ddl(asking)}, lists array<int>"), "probes")
    dropped(asking)
    cuts = lambda df, size: _per_list(df, k, size)
    blocks = cuts(index.select("list"), block_rows)
    near, start = None, 0
    while start < probes:
        end = min(max(1, GROWTH * start), probes)
        probed = asked.select(*_KEY, "v", F.explode(F.slice("lists", start + 1, end - start)).alias("list"))
        chunks = cuts(probed.select("list"), query_rows)
        if near is None:
            found = _searched(index, probed.withColumn("bound", F.lit(float("-inf"))), blocks, chunks, places)
        else:
            full = near.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            full = full.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.when(F.col("n") > places, F.col("least")).alias("known"))
            bounded = probed.join(full, _KEY, "left").select(*probed.columns, F.coalesce("known", F.lit(float("-inf"))).alias("bound"))
            found = near.unionByName(_searched(index, bounded, blocks, chunks, places))
        before, near = near, stored(_best(found, places), "found")
        if before is not None:
            dropped(before)
        start = end
    dropped(index)
    dropped(asked)
    each = near.select("q1", "q2", "score", "same", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    each = each.withColumn("place", place).filter(F.col("place") <= places + 1)
    lists = each.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("near"))
    lists = stored(lists, "nearest")  # so that the join can split a vector that many rows ask for
    dropped(near)
    got = asks.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(lists, ["q1", "q2"])
    own = F.array_position(F.transform("near", lambda x: x["same"] & x["vec_id"].eqNullSafe(F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, places)
    out = got.select("query_id", F.posexplode(others).alias("k", "x"))
    return out.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def _per_list(lists: DataFrame, k: int, size: int) -> Column:
    """Into how many parts of that size each list goes, by its number; there are at most MOST_LISTS of them."""
    parts = [1] * k
    for r in lists.groupBy("list").count().collect():
        parts[r["list"]] = -(-r["count"] // size)
    return F.lit(parts).cast("array<long>")[F.col("list")]
