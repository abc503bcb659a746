"""Operators 11 to 13 against brute force on small tables."""

import math
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import divergence, license_scan, line_dedup, nearest, simhash, substring_dedup, whitening

VECTORS = "vec_id long, embedding array<float>, label int, h1 string, list string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "clash", "clash") for i, v in rows], VECTORS)


def brute(rows, places=20):
    """Nearest of each asking row among all others, as (id, [(other id, score)])."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    usual = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good, out = [(i, v) for i, v in good if len(v) == usual], []
    for k, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            near = [(-float((q * v).sum()), math.inf if j is None else j, j) for m, (j, v) in enumerate(good) if m != k]
            out.append((i, [(j, -s) for s, _, j in sorted(near, key=lambda x: x[:2])[:places]]))
    return sorted(out, key=repr)


def found(df):
    lists = df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x")).collect()
    return {r.query_id: [(x.vec_id, x.score) for x in r.x] for r in lists}


def test_nearest_edges_by_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, rnd.integers(-3, 4, 8).tolist()) for k in range(90)]  # whole numbers: many ties
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [float("nan")]), (260, [1.0] * 7 + [None]), (280, [1.0] * 7 + [float("inf")]), (300, [1.0, 2.0])]
    rows += [(101, rows[40][1]), (102, rows[40][1]), (None, rows[40][1]), (None, [3.0] * 8)]
    got = found(nearest.search(table(spark, rows), list_rows=16, recall=1.0))
    want = dict(brute(rows))
    assert set(got) == set(want) == {0, 20, 40, 60, 80}
    for i, near in want.items():
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in near]) and [j for j, _ in got[i]] == [j for j, _ in near]
    assert nearest.search(table(spark, rows[:0])).count() == 0
    assert nearest.search(table(spark, [(1, [1.0, 2.0]), (3, [2.0, 1.0])])).count() == 0
    assert found(nearest.search(table(spark, [(0, [1.0, 2.0])]))) == {}
    few = found(nearest.search(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])])))
    assert few == {0: [(2, 5.0), (1, 4.0)]}


def test_nearest_repeated_rows_and_ids(spark):
    v, w = [1.0, 0.5, 0.25], [0.5, 1.0, 0.0]
    rows = [(20, v)] * 3 + [(40, v), (40, w), (7, w)] + [(100 + k, v) for k in range(60)]
    got = nearest.search(table(spark, rows)).collect()
    lists = Counter((r.query_id, r["rank"]) for r in got)
    assert {(q, n) for (q, _), n in lists.items()} == {(20, 3), (40, 2), (100, 1), (120, 1), (140, 1)}
    firsts = sorted(((r.query_id, r.vec_id) for r in got if r["rank"] == 1), key=repr)
    assert firsts == sorted([(20, 20)] * 3 + [(40, 20)] + [(40, 7)] + [(q, 20) for q in (100, 120, 140)], key=repr)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == [20, 20, 20, 40, *range(101, 117)]


def test_nearest_recall_and_adaptive_scan(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((1500, 24)) + 2 * rnd.standard_normal((12, 24))[rnd.integers(0, 12, 1500)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got, want = found(nearest.search(table(spark, rows), list_rows=64, block_rows=40, query_rows=16)), dict(brute(rows))
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in near}) for i, near in want.items())
    assert hits >= 0.9 * 20 * len(want) and all(len(near) == 20 for near in got.values())
    exact = {i: dict(near) for i, near in want.items()}
    assert all(abs(exact[i].get(j, s) - s) < 1e-9 for i, near in got.items() for j, s in near)
    # Abandoned candidates are those beyond the bound: with an infinite one nothing is, with the true one nothing near is.
    q = x[:30]
    best = nearest.scan(x, np.arange(1500), q, np.full(30, -np.inf), 20)
    score = np.sort(q @ x.T, axis=1)[:, -20:]
    again = nearest.scan(x, np.arange(1500), q, score[:, 0] - 1e-6, 20)
    for run in (best, again):
        hit = sum(len(set(run.b[run.q == i]) & set(np.argsort(-(x @ q[i]))[:20])) for i in range(30))
        assert hit >= 0.98 * 600


def test_whitening_by_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((300, 3)) @ rnd.standard_normal((3, 12)) + 0.05 * rnd.standard_normal((300, 12))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(7, base[7].tolist()), (None, base[8].tolist())]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [1.0] * 11 + [float("-inf")]), (904, [1.0]), (905, [])]
    got = whitening.components(table(spark, rows + bad)).collect()
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for k in range(8):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        want = (x - s / n) @ u[:, k] / math.sqrt(e[k])
        sign = math.copysign(1, mine[0] * want[0])
        assert all(abs(sign * mine[i] - w) < 1e-6 for (i, _), w in zip(rows, want))
        assert {r.explained for r in got if r.component == k + 1}.pop() == pytest.approx(e[k] / e.sum(), rel=1e-9)
    off = {i: int(((n * v.astype(object) - s.astype(object)) ** 2).sum()) for (i, _), v in zip(rows, x)}
    assert all(r.deviation == off[r.vec_id] for r in got)


def test_whitening_degenerate_tables(spark):
    assert whitening.components(table(spark, [])).count() == 0
    one = whitening.components(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = whitening.components(table(spark, [(k, [float(k), 5.0]) for k in range(10)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12
    big = whitening.components(spark.createDataFrame([(1, [1e12]), (2, [-1e12]), (3, [1e300])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in big} == {(1, 2, None), (2, 2, None)}


def test_jacobi_keeps_small_eigenvalues():
    rnd = np.random.default_rng(4)
    scale = np.diag(10.0 ** -np.arange(8))
    a = scale @ (np.eye(8) + 0.1 * (lambda m: m + m.T)(rnd.standard_normal((8, 8)))) @ scale
    e, u = whitening.jacobi(a)
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-13) and (np.diff(e) <= 0).all()
    # Cholesky-free check in exact arithmetic: the determinant is the product of all eigenvalues.
    m = [[Fraction(float(x)) for x in row] for row in (a + a.T) / 2]
    det = Fraction(1)
    for k in range(8):
        det *= m[k][k]
        for i in range(k + 1, 8):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k])]
    assert math.prod(e) == pytest.approx(float(det), rel=1e-10)
    seen = sorted((int(p), int(q)) for ps, qs in whitening.rounds(7) for p, q in zip(ps, qs))
    assert seen == [(p, q) for p in range(7) for q in range(p + 1, 7)]


DOCS = "doc_id long, text string, lang string, source string, term string, n string, value string, part string"


def audited(rows, least):
    """The audit in plain Python on exact integers."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        held = Counter(t for w, _, _ in own for t in set(w))
        kept = {t for t, n in held.items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        counts = {s: Counter(t for w, _, x in own if x == s for t in w) for s in {r[2] for r in own}}
        p, q = {s: share(c) for s, c in counts.items()}, share(Counter(t for w, _, _ in own for t in w))
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, 50)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)}
    return out


def test_divergence_by_brute_force(spark):
    rnd = np.random.default_rng(5)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["Été", "été", "ÉTÉ", "naïve", "𝒳y", "The", "the"]
    rows = []
    for k in range(160):
        text = " ".join(rnd.choice(words, rnd.integers(0, 30))) + " 12 x-y_z"
        rows.append((text, ["en", "de", None, "fr"][k % 4], ["s1", "s2", None, "é", "z", "S"][int(rnd.integers(0, 6))]))
    rows += [("the The THE", "once", "a"), (None, "once", "b"), ("", "once", None), ("alone", "single", "a"), rows[0], rows[0], ("the " * 30_000, "en", "s1")]
    df = spark.createDataFrame([(k % 50 or None, *r, "clash", "clash", "clash", "clash") for k, r in enumerate(rows)], DOCS)
    got = divergence.audit(df, least=5)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == audited(rows, 5)
    assert got.count() == len(audited(rows, 5)) and dict(got.dtypes)["rank"] == "int"
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_are_split_and_lowered_one_by_one(spark):
    texts = ["The the ÉTÉ été, Été", "İx İX \u212a K\u212a", " -- ", "", None, "..lead trail!!", "a1b_C\U0001d4b3Y\x7fz\x80q", "THE"]
    want = {}
    for t in texts:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(divergence.TERM, t or "")]
        for w in words:
            n, held = want.get(w, (0, 0))
            want[w] = (n + 1, held)
        want |= {w: (want[w][0], want[w][1] + 1) for w in set(words)}
    counts = divergence.term_counts(spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string"))
    assert {r.term: (r.n, r.docs) for r in counts.collect()} == want
    # Lowering whole texts letter by letter had taken most of the time.
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(text" not in plan and "translate(coalesce(text" not in plan and "regexp_extract_all" not in plan


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def crowd(n, seed, edits=(3, 4, 5), size=150):
    """Edited copies of one text: most are similar to it or to a few others, but not to all."""
    rnd = np.random.default_rng(seed)
    base, out = [f"word{k}" for k in rnd.integers(0, 10_000, size)], []
    for _ in range(n):
        w = list(out[int(rnd.integers(len(out)))].split()) if out and rnd.random() < 0.5 else list(base)
        for k in rnd.choice(size, int(rnd.choice(edits)), replace=False):
            w[k] = f"new{rnd.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def groups(texts, similarity=0.8):
    """Number of groups that texts of the similarity or more make."""
    of, own = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i, a in enumerate(of):
        for j in range(i):
            if len(a & of[j]) >= similarity * len(a | of[j]):
                own[root(i)] = root(j)
    return len({root(i) for i in range(len(texts))})


def test_near_dedup_does_not_depend_on_the_size_of_a_key(spark, monkeypatch):
    crowds = [crowd(n, n) for n in (13, 50, 500)]
    owner = [k for k, texts in enumerate(crowds) for _ in texts]
    docs = spark.createDataFrame(list(enumerate(t for texts in crowds for t in texts)), "doc_id long, text string").repartition(4)
    kept = []
    for most in (2, 12, 10_000):
        monkeypatch.setattr(simhash, "PAIRS", most)
        kept.append(sorted(r.doc_id for r in simhash.deduplicate(docs).collect()))
    assert kept[0] == kept[1] == kept[2]
    # Every kept text but one of each group is a copy that was missed, by fingerprints that never met.
    for k, texts in enumerate(crowds):
        n, least, left = len(texts), groups(texts), sum(owner[d] == k for d in kept[0])
        assert least <= left and n - left >= 0.9 * (n - least)


def test_substring_dedup_of_repeated_texts_with_very_many_words(spark):
    copies = 3
    long = " ".join(map(str, range(1_200_000)))
    docs = spark.createDataFrame([(k, long) for k in range(copies)] + [(9, "short"), (10, long[-5000:] + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert all((got[k].n_words, got[k].n_removed, got[k].kept) == (1_200_000, 1_200_000, "") for k in range(copies))
    assert got[9].n_removed == 0 and got[10].kept.endswith("end") and got[10].n_words - got[10].n_removed <= 2


def broadcast_parts(df):
    """What a plan broadcasts, each with what it is made of."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(re.match(r"[\s:+*|-]*", line)[0])
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((m for m in range(k + 1, len(lines)) if depth(lines[m]) <= depth(line)), len(lines))
            out.append("\n".join(lines[k:below]))
    return out


def test_copies_of_the_plan_of_shards_are_not_broadcast(spark):
    passages = substring_dedup.stored(spark.createDataFrame([(1, 40, b"a b"), (2, 40, b"c d")], "rep long, n int, words binary"), "passages")
    segments = [(rep, doc, 7, 3, 50, doc, b"x y") for doc, rep in enumerate([1, 1, 2, 3])]
    segments = substring_dedup.stored(spark.createDataFrame(segments, "rep long, doc_id long, text_hash long, first int, n int, seg long, words binary"), "segments")
    dealt = substring_dedup._dealt(passages, segments)
    assert not [x for x in broadcast_parts(dealt) if "explode" in x]
    assert sorted((r.rep, r.part, r.salt, r.kind, r.doc_id) for r in dealt.collect() if r.kind) == [(1, 0, 0, 1, 0), (1, 0, 0, 1, 1), (2, 0, 0, 1, 2)]
    assert sorted((r.rep, bytes(r.words)) for r in dealt.collect() if not r.kind) == [(1, b"a b"), (2, b"c d")]


def test_lines_know_their_size_and_copies_of_their_state_are_not_broadcast(spark):
    texts = ["a b c d", "a b c d e", "a b  c\td e", "é à ü ö", "é à ü ö ß", "one", "a b c d e f\none\n", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = line_dedup.distinct_lines(line_dedup.lines(docs))
    assert sorted((r.plain, r.n) for r in known.collect() if r.plain) == [("a b c d e", 5), ("a b c d e f", 6), ("é à ü ö ß", 5)]
    # Words are counted once for each different line, after lines are put together.
    assert known._jdf.queryExecution().optimizedPlan().toString().count("replace(plain") == 1
    assert not [x for x in broadcast_parts(line_dedup.marked(docs)) if "explode" in x and "copy" in x]
    assert {r.doc_id: r.n_removed for r in line_dedup.report(docs).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 2, 7: 0, 8: 0}


def test_long_lines_give_two_ends_one_of_which_an_edit_leaves(spark):
    ends = spark.range(13, 3000).select("id", line_dedup._end(F.col("id")).alias("k")).collect()
    assert all(2 * r.k < r.id <= 4 * r.k for r in ends)
    whole = {n: [f"w{i}" for i in range(n)] for n in range(12, 52)}
    edits = {n: [w[:i] + new + w[i + 1 :] for i in range(n) for new in ([], ["x"], [w[i], "x"])] for n, w in whole.items()}
    lines = {" ".join(w) for w in [*whole.values(), *(x for xs in edits.values() for x in xs)]}
    docs = spark.createDataFrame([(0, "\n".join(sorted(lines)))], "doc_id long, text string")
    got = {r.plain: set(r.ends) for r in line_dedup.distinct_lines(line_dedup.lines(docs)).filter("ends is not null").collect()}
    # Halves, as they were before, took four hashes of a line, which read its words twice.
    assert all(len(x) == (4 if len(plain.split(" ")) in (24, 48) else 2) for plain, x in got.items())
    like = [(whole[n], x) for n in whole for x in edits[n] if min(n, len(x)) >= 12 and max(n, len(x)) > 12]
    assert len(like) > 3000 and all(got[" ".join(a)] & got[" ".join(b)] for a, b in like)


def test_passages_in_pieces_and_bounded_automata(spark, monkeypatch):
    spans = substring_dedup._pieces(7, 7 + 100_003, 35)
    assert spans[0][0] == 7 and spans[-1][1] == 100_010 and all(b - a <= substring_dedup.PIECE for a, b in spans)
    assert all(b - c == 34 for (_, b), (c, _) in zip(spans, spans[1:])) and substring_dedup._pieces(3, 38, 35) == [(3, 38)]
    monkeypatch.setattr(substring_dedup, "SIGNS", 100)
    passages = [" ".join(f"p{k}w{i}" for i in range(n)).encode() for k, n in enumerate([40, 70, 35, 35, 30, 300])]
    made = list(substring_dedup._bounded(passages))
    assert [p for g in made for p in g] == passages and [len(g) for g in made] == [1, 1, 3, 1] and list(substring_dedup._bounded([])) == []


def test_license_scan_of_very_many_notices_and_its_parameters(spark):
    notice = license_scan.TEMPLATES["MIT"]
    many = "\n".join([notice] * 20_000)
    start = time.perf_counter()
    found = license_scan.scan(spark.createDataFrame([(1, many)], "doc_id long, text string"))
    assert found.filter("license = 'MIT'").count() == 20_000 and time.perf_counter() - start < 120
    docs = spark.createDataFrame([(1, "Licensed under CC BY-ND 4.0."), (2, notice), (3, "Released under the BSD License.")], "doc_id long, text string")
    rows = lambda *args: sorted(map(tuple, license_scan.scan(docs, *args).collect()))
    assert rows() == rows(license_scan.TEMPLATES) == [r for r in rows() if r[0] == 2]
    assert {r[0] for r in rows(None, 0.8, {})} == {1, 2, 3}
    places = [(0.9, 3, 8, "b"), (1.0, 5, 9, "a"), (1.0, 9, 12, "a"), (0.8, 0, 5, "c"), (0.8, 0, 6, "d")]
    assert license_scan._apart(places) == [("c", 0.8, 0, 5), ("a", 1.0, 5, 9), ("a", 1.0, 9, 12)]


def test_license_scan_finds_changed_copies(spark):
    """Every copy with words left out, changed or put in is found as long as its common words reach the coverage."""
    rnd = np.random.default_rng(6)
    texts, want = [], []
    for name in ("MIT-text", "BSD-text", "GPL-3.0", "Apache-2.0"):
        words = license_scan.TEMPLATES[name].split()
        for _ in range(12):
            w, gone = list(words), int(rnd.integers(0, len(words) // 6 + 1))
            for k in sorted(rnd.choice(len(w), gone, replace=False), reverse=True):
                w[k : k + 1] = [] if rnd.random() < 0.5 else [f"zz{k}"]
            common = len(words) - gone
            around = [f"f{k}" for k in rnd.integers(0, 500, 40)]
            texts.append(" ".join(around[:20] + w + around[20:]))
            want.append((name, common / len(words)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in license_scan.scan(docs).collect():
        got[r.doc_id, r.license] = max(r.coverage, got.get((r.doc_id, r.license), 0))
    near = [(k, name, share) for k, (name, share) in enumerate(want) if share >= 0.83]
    assert len(near) > 35
    for k, name, share in near:
        own = len(license_scan.words_of(license_scan.TEMPLATES[name].encode()))
        assert (k, name) in got and got[k, name] >= share - 2 / own, (k, name, share)


def test_links_between_parts_are_all_and_few(spark):
    rnd = np.random.default_rng(8)
    rows = {}
    for _ in range(6):
        base = int.from_bytes(rnd.bytes(40), "little")
        for _ in range(30):
            x = base
            for at, n, size in ((0, 64, 4), (64, 64, 6), (128, 64, 20), (192, 128, 30)):
                for b in rnd.choice(n, int(rnd.integers(0, size)), replace=False):
                    x ^= 1 << int(at + b)
            raw = x.to_bytes(40, "little")
            rows[raw[24:]] = (raw, int(rnd.integers(0, 3)))
    check = simhash.allowed()
    apart = lambda a, b, at, n: ((int.from_bytes(a, "little") ^ int.from_bytes(b, "little")) >> at & (1 << n) - 1).bit_count()
    near = lambda a, b: min(apart(a, b, at, 64) for at in (0, 64, 128)) <= 4 and apart(a, b, 192, 128) <= check
    frame = spark.createDataFrame([(bytearray(r[:24]), bytearray(r[24:]), k) for r, k in rows.values()], "words binary, bits binary, label long")
    found = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in simhash.links(frame, check, labelled=True).collect()]
    all_ = list(rows.items())
    want = {tuple(sorted((a, b))) for i, (a, (x, k)) in enumerate(all_) for b, (y, m) in all_[:i] if k != m and near(x, y)}
    assert set(found) == want and len(want) > 200 and len(found) <= 3 * len(want)  # once for each family at most
