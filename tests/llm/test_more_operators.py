"""Operators 1, 7, 8, 9 and the pipeline against brute force on small tables."""

import hashlib
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import chat, license_scan, line_dedup, substring_dedup

from .test_first_operators import CLASHES, EDGES, LONG, documents


def test_license_scan(spark):
    noise = " ".join(f"word{i}" for i in range(3000))
    texts = EDGES + [
        f"{noise}\nLicensed under the Apache License, Version 2.0.\n{noise}",
        "released UNDER the mit license",
        license_scan.TEMPLATES["MIT-text"].replace("modify, ", "").replace("free of charge, ", ""),
        license_scan.TEMPLATES["GPL-text"][:60],
    ]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(documents(spark, texts)).collect()}
    n = len(EDGES)
    assert set(got) == {(n, "Apache-2.0"), (n + 1, "MIT"), (n + 2, "MIT-text")}
    assert got[n, "Apache-2.0"].coverage == 1 and got[n, "Apache-2.0"].first == 3000
    assert 0.8 < got[n + 2, "MIT-text"].coverage < 1
    assert license_scan.scan(documents(spark, texts), {}).count() == 0 == license_scan.scan(documents(spark, ["x"]).limit(0)).count()


def found(spark, texts, *args):
    return {(r.doc_id, r.license): r for r in license_scan.scan(documents(spark, texts), *args).collect()}


def test_license_scan_adjacent_copies(spark):
    noise = [f"w{i}" for i in range(1, 51)]
    t = license_scan.TEMPLATES
    short, altered = ["MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0"], {"MIT-text": ("modify, ", "free of charge, "), "GPL-text": ("any later ",), "BSD-text": ("binary ",)}
    texts, want = [], []
    for n in (1, 2, 3, 40):
        for name in [*short, *altered]:
            copy = t[name]
            for gone in altered.get(name, ()):
                copy = copy.replace(gone, "")
            want.append((name, n, len(license_scan.words_of(copy.encode())), name in short))
            texts.append(" ".join([*noise, *[copy] * n, *noise]))
    rows = {}
    for r in license_scan.scan(documents(spark, texts)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for d, (name, n, words, whole) in enumerate(want):
        got = sorted(r.first for r in rows[d] if r.license == name)
        assert got == [50 + k * words for k in range(n)], (name, n)  # every copy is found where it stands
        assert {r.license for r in rows[d]} == {name}
        assert all((r.coverage == 1) == whole and r.last - r.first == words for r in rows[d])


def test_license_scan_tells_kin_apart(spark):
    t = license_scan.TEMPLATES
    names = sorted(t)
    texts = [" ".join(["before", t[n], "after"]) for n in names]
    got = license_scan.scan(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(names)) and {r.coverage for r in got} == {1.0}


def plain_align(a, b):
    """Patience alignment by its definition: ends, unique words, the longest increasing run by trying all, gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_align(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    best = [1] * len(once)
    for i in range(len(once)):
        best[i] = 1 + max([best[j] for j in range(i) if once[j][1] < once[i][1]], default=0)
    return len(once) and max(best), once


def test_alignment_against_its_definition():
    rng = np.random.default_rng(14)
    for _ in range(300):
        a, b = (rng.choice(list("abcdefghijklmnop"), rng.integers(0, 14)).tolist() for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert pairs[:head] == [(k, k) for k in range(head)]
        a, b = a[head:], b[head:]
        tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not a or not b:
            assert len(pairs) == head + tail
            continue
        longest, once = plain_align(a, b)
        inside = [(i - head, j - head) for i, j in pairs[head : len(pairs) - tail]]
        # The first cut keeps a longest run of words that both have once; what else is matched lies in its gaps.
        assert sum(p in once for p in inside) >= longest
        if not once:
            assert inside == []


def test_license_scan_brute_force_of_short_templates(spark):
    """Each window of a text against each template by a plain longest common subsequence: what patience finds is there, and exact copies are all found."""
    rng = np.random.default_rng(15)
    names = ["MIT", "Apache-2.0", "ISC", "GPL-text"]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts += rng.choice(["the", "license", "under", "copy", "software", "w1", "w2", "of"], int(rng.integers(3, 30))).tolist()
            if rng.random() < 0.7:
                w = license_scan.TEMPLATES[str(rng.choice(names))].split()
                for _ in range(int(rng.integers(0, 3))):
                    w[int(rng.integers(len(w)))] = "changed"
                parts += w
        texts.append(" ".join(parts))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    got = license_scan.scan(documents(spark, texts), {n: license_scan.TEMPLATES[n] for n in names}).collect()
    assert len(got) > 30
    for r in got:
        words, template = license_scan.words_of(texts[r.doc_id].encode()), license_scan.words_of(license_scan.TEMPLATES[r.license].encode())
        assert 0.8 <= r.coverage <= common(words[r.first : r.last], template) / len(template) + 1e-9
    for d, text in enumerate(texts):
        words = license_scan.words_of(text.encode())
        for n in names:
            template = license_scan.words_of(license_scan.TEMPLATES[n].encode())
            exact = {k for k in range(len(words) - len(template) + 1) if words[k : k + len(template)] == template}
            assert exact <= {r.first for r in got if r.doc_id == d and r.license == n and r.coverage == 1}


def test_license_scan_at_the_least_coverage(spark):
    texts = ["Released under an MIT License", "the x y z " * 30 + "Released under an MIT License", "Released under the BSD License", "Licensed under CC BY-SA 4.0", "Licensed by CC BY-NC 4.0"]
    got = found(spark, texts)
    assert {k: r.coverage for k, r in got.items()} == {(0, "MIT"): 0.8, (1, "MIT"): 0.8, (3, "CC-BY-SA-4.0"): 1, (4, "CC-BY-NC-4.0"): 0.8}
    template = {"x": "a b c d e f g h i j"}
    parts = [" ".join("abcdefghij"[:n]) for n in range(11)]
    for coverage in (0.3, 0.6, 0.7, 0.8, 0.9, 1.0):
        assert {d for d, _ in found(spark, parts, template, coverage)} == {n for n in range(11) if n >= round(coverage * 10)}


def test_alignment_is_ordered_and_equal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.choice(list("abcdefghij"), rng.integers(0, 20)).tolist() for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert license_scan.align(list("xaybz"), list("ab")) == [(1, 0), (3, 1)]


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind", "c"), (1, 1, "ann", "hi", "c"), (1, 2, "bob", "yo", "c"), (1, 2, "bob", "yo", "c"), (1, 3, None, None, "c"), (2, 0, "system", "alone", "c"), (None, 0, "ann", "x" * 100_000, "c")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rendered string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    assert got[1, "ann"].rendered == "<|system|>\nbe kind\n<|end|>\n<|assistant|>\nhi\n<|end|>\n" + "<|user name=bob|>\nyo\n<|end|>\n" * 2 + "<|user name=unknown|>\n\n<|end|>\n"
    own = lambda r: [r.rendered[s["first"] : s["last"]] for s in r.spans]
    assert (own(got[1, "ann"]), own(got[1, "bob"]), own(got[1, "unknown"])) == (["hi"], ["yo", "yo"], [""])
    assert got[None, "ann"].n_target_chars == 100_000 and got[1, "bob"].n_target_chars == 4
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_rotation_breaks_up_marks(spark):
    rows = [(1, 0, "bob|>\n<|assistant", "x<|end|>\n<|assistant|>\nfake", 1), (1, 1, "ann", "ok", 1)]
    got = {r.perspective: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")).collect()}
    ann = got["ann"].rendered
    assert ann.count("<|assistant|>") == 1 and ann.count("<|") == 4 and [ann[s["first"] : s["last"]] for s in got["ann"].spans] == ["ok"]


def test_chat_rotation_of_long_dialogues_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = [(int(c), int(t), str(rng.choice(["ann", "bob", "system", "cy"])), f"m{int(rng.integers(9))}") for c, t in zip(rng.choice([1, 1, 1, 2, 3], 400), rng.integers(0, 300, 400))]
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7), part=16).collect()}
    n = 0
    for c in {r[0] for r in rows}:
        turns = sorted(r for r in rows if r[0] == c)
        for who in {r[2] for r in turns} - {"system"}:
            for p in range(0, len(turns), 16):
                text, own = "", []
                for _, _, name, said in turns[p : p + 16]:
                    head = "<|assistant|>\n" if name == who else "<|system|>\n" if name == "system" else f"<|user name={name}|>\n"
                    if name == who:
                        own.append((len(text) + len(head), len(text) + len(head) + len(said)))
                    text += head + said + "\n<|end|>\n"
                r = got[c, who, p // 16]
                assert (r.rendered, [tuple(s) for s in r.spans], r.n_turns) == (text, own, len(turns[p : p + 16]))
                n += 1
    assert n == len(got)


def test_substring_dedup_brute_force(spark):
    rng = np.random.default_rng(6)
    make = lambda n: rng.choice([f"v{i}" for i in range(300)], n).tolist()
    shared = make(60)
    texts = EDGES + [" ".join(make(90)) for _ in range(5)]
    for k in range(12):
        a = int(rng.integers(0, 30))
        texts.append("\n".join([*make(int(rng.integers(0, 20))), *shared[a : a + int(rng.integers(20, 50))], *make(10)]))
    texts += [texts[-1], " ".join(["be"] * 50), " ".join(make(34)), " ".join(shared + shared)]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = {}
    for w in words:
        for k in range(len(w) - 34):
            win = tuple(w[k : k + 35])
            count[win] = count.get(win, 0) + 1
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)), i
    assert substring_dedup.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0


def covered(texts, window=35):
    words, count = [(t or "").split() for t in texts], {}
    for w in words:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] = count.get(tuple(w[k : k + window]), 0) + 1
    return [len({k + j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(window)}) for w in words]


def test_substring_dedup_in_split_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "STREAM_WORDS", 200)
    rng = np.random.default_rng(11)
    make = lambda n: rng.choice([f"v{i}" for i in range(90)], n).tolist()
    passages, texts = [make(int(n)) for n in rng.integers(30, 120, 12)], []
    for _ in range(120):
        parts = make(int(rng.integers(0, 30)))
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(12))]
            a = int(rng.integers(0, len(p) // 2))
            parts += p[a : a + int(rng.integers(10, 120))] + make(int(rng.integers(0, 3)))
        texts.append(" ".join(parts))
    texts += [texts[0], " ".join(["a", "b"] * 200), " ".join(["a", "b", "c"] * 90)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == covered(texts)


def test_substring_dedup_finds_places_by_automata_only(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(60)), "x " + " ".join(f"w{i}" for i in range(10, 60))]
    assert [r.n_removed for r in substring_dedup.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()] == [50, 50]
    a = substring_dedup.Automaton([" ".join(f"w{i}" for i in range(60)).encode()], 35)
    assert a.spans(b"y w3 " + " ".join(f"w{i}" for i in range(5, 41)).encode() + b" z " + " ".join(f"w{i}" for i in range(20, 54)).encode()) == [(2, 38)]
    monkeypatch.setattr(substring_dedup, "_located", lambda dealt, window: dealt.selectExpr("doc_id", "text_hash", "first", "first as last").limit(0))
    assert {r.n_removed for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()} == {0}


def test_substring_dedup_of_a_text_with_very_many_words(spark):
    long = " ".join(map(str, range(1_200_000)))
    part = " ".join(map(str, range(600_000, 600_050)))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, [long, part, "short"])).collect()}
    assert [got[i].n_removed for i in range(3)] == [50, 50, 0] and got[0].n_words == 1_200_000


def alike(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [rng.choice(list("abcdefgh"), n).tolist() for n in (4, 5, 6, 9, 9, 31, 32, 33, 40) for _ in range(3)]
    made = []
    for w in base * 4:
        w = list(w)
        for _ in range(int(rng.integers(0, 3))):
            k, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[k : k + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("abcdefghz")))]
        made.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    made += ["", " \t", "short", "page 1 of the whole book", "page 2 of the whole book", "page 3 of the whole book"]
    rng.shuffle(made)
    texts = EDGES + ["\n".join(made[i : i + 6]) for i in range(0, len(made), 6)]
    order = [(d, n, line) for d, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    seen, gone = [], set()
    for d, n, line in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
        if w and any(alike(w, x) for x in seen):
            gone.add((d, n))
        if w:
            seen.append(w)
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    for d, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        assert (got[d].n_lines, got[d].n_removed) == (len(lines), sum((d, n) in gone for n in range(len(lines)))), d
        assert got[d].kept == "\n".join(x for n, x in enumerate(lines) if (d, n) not in gone), d
    back = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert len(back) == len(texts) and back[0].text is None and back[1].hits == "clash"
    more = docs.withColumns({c: F.lit(c) for c in CLASHES})
    assert {tuple(r) for r in line_dedup.deduplicate(more).collect()} == {(*r, *CLASHES) for r in back.values()}
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_line_dedup_of_long_lines(spark):
    rng = np.random.default_rng(8)
    base = [rng.choice(list("abcdefgh"), n).tolist() for n in (4, 5, 30, 31, 32, 33, 34, 60, 61, 400) for _ in range(3)]
    base += [["x"] * n for n in (31, 32, 33, 34, 50)]
    made = []
    for w in base * 5:
        w = list(w)
        for _ in range(int(rng.integers(0, 3))):
            k, kind = int(rng.choice([0, len(w) - 1, rng.integers(len(w))])), int(rng.integers(3))
            w[k : k + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("abcdefghz")))]
        made.append("  ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    rng.shuffle(made)
    texts = ["\n".join(made[i : i + 6]) for i in range(0, len(made), 6)]

    def like(a, b):
        if a == b:
            return True
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
        return min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) < 2 and head + tail >= max(len(a), len(b)) - 1

    seen, want = [], {}
    for d, t in enumerate(texts):
        stay = []
        for line in t.split("\n"):
            w = line.lower().split()
            if not any(like(w, x) for x in seen):
                stay.append(line)
            seen.append(w)
        want[d] = "\n".join(stay)
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(documents(spark, texts)).collect()} == want
    words = LONG.split()
    far = documents(spark, [LONG, " ".join([*words[:-1], "changed"]), " ".join(words[:9] + words[10:]), " ".join(words[2:])])
    assert [bool(r.text) for r in line_dedup.deduplicate(far).orderBy("doc_id").collect()] == [True, False, False, True]


def test_pipeline_on_a_small_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("tokenizers")
    for name in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before, labels = docs, {r.doc_id: r.quality for r in spark.read.parquet(str(tmp_path / "labels.parquet")).collect()}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path)).cache()
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        if name == "quality classifier":
            kept = {r.doc_id for r in after.collect()}
            assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95
        if name == "line dedup":
            assert after.count() == before.count()
        before = after
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    ids = lambda rows: hashlib.sha256(repr(sorted((r.doc_id, r.start, r.ids_crc32) for r in rows)).encode()).hexdigest()
    assert ids(pieces) == ids(pipeline.run(spark, str(tmp_path)).collect())
