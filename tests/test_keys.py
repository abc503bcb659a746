"""Keys derived anew along chains and rings, and ids that stay, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from offerlake.operators import ids, rekey


def ends(points):
    """Root of each id by walking: a row that points to itself, else the largest id of the ring."""
    out = {}
    for i in points:
        seen, at = [], i
        while at not in seen:
            seen.append(at)
            at = points[at]
        out[i] = max(seen[seen.index(at) :])
    return out


def keys(spark, rows):
    return spark.createDataFrame(rows, "id long, sid long, pid string, new string")


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_rings_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for sid in (1, 2):
        numbers = rnd.sample(range(1000), 60)
        for k, i in enumerate(numbers):
            new = rnd.choice([f"k{k}", f"k{(k + 1) % 60}", f"k{k + 1 - 4 * (k % 4 == 3)}", f"k{rnd.randrange(60)}", f"free{rnd.randrange(8)}"])
            rows.append((i + 1000 * sid, sid, f"k{k}", new))
    had = {(s, p): i for i, s, p, _ in rows}
    least = {}
    for i, s, _, n in sorted(rows):
        least.setdefault((s, n), i)
    want = ends({i: had.get((s, n), least[s, n]) for i, s, _, n in rows})
    got = {r.id: (r.pid, r.master) for r in rekey.rederive(keys(spark, rows), F.col("new")).collect()}
    assert got == {i: (n, want[i]) for i, _, _, n in rows}
    stay = [(s, n) for i, s, _, n in rows if want[i] == i]
    assert len(stay) == len(set(stay))  # a key has one row in the end


def test_long_chain_swap_and_ring(spark):
    chain = [(k, 1, f"c{k}", f"c{k + 1}") for k in range(200)] + [(200, 1, "c200", "c200")]
    swap = [(300, 1, "a", "b"), (301, 1, "b", "a")]
    ring = [(400 + k, 1, f"r{k}", f"r{(k + 1) % 7}") for k in range(7)] + [(390, 1, "tail", "r2")]
    plain = [(500, 1, "x", "x"), (501, 1, "old", "fresh"), (502, 1, None, None)]
    got = {r.id: r.master for r in rekey.rederive(keys(spark, chain + swap + ring + plain), F.col("new")).collect()}
    assert all(got[k] == 200 for k in range(201)) and got[300] == got[301] == 301
    assert {got[i] for i in (390, *range(400, 407))} == {406} and [got[i] for i in (500, 501, 502)] == [500, 501, 502]


def test_history_and_links_follow(spark):
    rows = keys(spark, [(1, 1, "a", "b"), (2, 1, "b", "c"), (3, 1, "c", "c"), (4, 1, "d", "e")])
    history = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (4, "z")], "product_id long, at string")
    links = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 7)], "product_id long, target_id long")
    left = rekey.merged(rows, {"history": history, "links": links}, rekey.rederive(rows, F.col("new")))
    assert sorted((r.id, r.pid) for r in left["products"].collect()) == [(3, "c"), (4, "e")]
    assert sorted(map(tuple, left["history"].collect())) == [(3, "x"), (3, "x"), (3, "y"), (4, "z")]
    assert sorted(map(tuple, left["links"].collect())) == [(3, 7), (3, 8), (4, 7)]
    none = rows.limit(0)
    assert rekey.rederive(none, F.col("new")).count() == 0


def test_ids_stay_and_are_dense(spark):
    none = spark.createDataFrame([], "sid long, pid long, id long")
    batch = spark.createDataFrame([(s, p) for s in (3, 1) for p in range(50) for _ in range(2)] + [(None, 5), (None, 5)], "sid long, pid long")
    first, mark = ids.get_or_create(none, batch, ["sid", "pid"], 10)
    rows = {(r.sid, r.pid): r.id for r in first.collect()}
    assert sorted(rows.values()) == list(range(11, 112)) and mark == 111 and all(r.created for r in first.collect())
    order = sorted((k for k in rows if k[0] is not None), key=lambda k: rows[k])
    assert order == sorted(order)
    again, same = ids.get_or_create(first, batch, ["sid", "pid"], mark)
    assert same == mark and {(r.sid, r.pid): r.id for r in again.collect()} == rows and not any(r.created for r in again.collect())
    kept = first.filter("id < 100")  # deleted rows' ids are not given again
    more, last = ids.get_or_create(kept, batch.limit(0).union(spark.createDataFrame([(9, 9), (3, 49)], "sid long, pid long")), ["sid", "pid"], mark)
    assert sorted(r.id for r in more.collect()) == [112, 113] and last == 113
    assert ids.get_or_create(none, batch.limit(0), ["sid", "pid"])[1] == 0
