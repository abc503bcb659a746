"""Operators 2 to 6 and 10 against brute force on small tables."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from offerlake.llm import classifier, decontaminate, packing, quality_rules, simhash, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


#: Extra columns with names that operators might use.
CLASHES = ["_id", "_hash", "_lines", "_removed", "score", "predicted", "row", "name", "lines", "removed", "text_hash", "line_no", "k1", "copy", "key", "bits", "_words", "_text", "hash"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", " \n\t", "one", "a\xa0b c\x1cd", "x " * 200, "a b c a b c d", LONG, "Same text here.", "Same text here."]


def test_quality_rules_brute_force(spark):
    texts = EDGES + ["the cat of the hat and the cat of the mat\n" * 9, "### $$$ the of and " * 20]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {w for w in set(wins)} and {w for w, n in zip(*np.unique(np.array([" ".join(w) for w in wins]), return_counts=True)) if n > 1}
        covered = {k + j for k, w in enumerate(wins) if " ".join(w) in (twice or ()) for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(documents(spark, ["x"]).limit(0)).count() == 0


def test_classifier_learns_and_handles_edges(spark):
    good = ["the ship of the river went to the old town and came back with %d men" % i for i in range(60)]
    bad = ["BUY!! NOW!! ### $$$ %d BUY!! NOW!!" % i for i in range(60)]
    docs = documents(spark, good + bad + EDGES)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs.withColumnRenamed("hits", "score"), model).collect()
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id < 60) for r in rows if r.doc_id < 120)
    seen = {r.doc_id for r in labels.filter(~classifier.held_out()).collect() if r.doc_id is not None}
    assert seen == {i for i in range(120) if zlib.crc32(str(i).encode()) % 5}
    more = docs.withColumns({c: F.lit(c) for c in CLASHES})
    assert {(r.doc_id, *r[6:]) for r in classifier.select(more, model).collect()} == {(r.doc_id, *CLASHES) for r in rows if r.predicted}
    one = classifier.fit(docs, labels.filter("quality = 1"))
    assert all(r.predicted == 1 and abs(r.score - 0.3) < 1e-6 for r in classifier.score(docs, one).collect())
    assert classifier.fit(docs.limit(0), labels).rows == 0


def plain_features(text):
    """The features one by one, from their definitions."""
    b = (text or "").encode()
    words, lines = re.split(rb"[ \t\n\r\x0b\x0c]+", b.strip(b" \t\n\r\x0b\x0c")) if b.strip() else [], [x for x in b.split(b"\n") if x.strip()]
    n, size = max(len(words), 1), max(len(b), 1)
    out = [sum(1 for c in b if c in kind) / size for kind in classifier.CLASSES]
    out += [sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, 1 - len(set(words)) / n, sum(w.isupper() for w in words) / n, 1 - len(set(lines)) / max(len(lines), 1)]
    out += [min(sum(map(len, words)) / n / 20, 1), min(max([len(w) for w in words], default=0) / 200, 1)]
    return [*out, *(x**0.5 for x in out), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(words) / max(len(lines), 1))]


def test_classifier_against_plain_numpy():
    for t in EDGES + ["A B b b\nc!? 12\n\nÜ | x", "#x"]:
        assert np.allclose(classifier.features(t if t is None else t.encode()), plain_features(t)), t
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(200, classifier.SIZE)), np.arange(200) % 2
    x[y == 1, :3] += 0.7
    model = classifier.fit_pairs(x, y)
    z, pick = (x - x.mean(0)) / x.std(0), np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = classifier.PAIRS_PER_ROW * 100 + 100
    d = z[good[pick.permutation(pairs) % 100]] - z[bad[pick.permutation(pairs) % 100]]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + classifier.L2 / 2 * w @ w
    least = loss(model.weights)
    assert least < loss(np.zeros(classifier.SIZE))
    for _ in range(200):  # the loss is convex, so no step may lower it
        assert loss(model.weights + rng.normal(size=classifier.SIZE) * 10 ** rng.uniform(-4, 0)) >= least - 1e-9
    raw = z @ model.weights
    balance = lambda c: (raw[good] >= c).mean() + (raw[bad] < c).mean()
    assert balance(model.threshold) >= max(map(balance, np.quantile(raw, np.linspace(0.002, 0.998, 499)))) - 1e-9
    s = model.score(x)
    assert np.array_equal(s >= classifier.CUT, raw >= model.threshold - 1e-9) and np.array_equal(np.argsort(s, kind="stable"), np.argsort(raw, kind="stable"))


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = classifier.score(docs, classifier.fit(docs, labels)).join(labels, "doc_id").filter(classifier.held_out()).collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_url_filter_brute_force(spark, monkeypatch):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "", "block"), ("example.net", "/de/8", "block"), ("a.example.net", "/de/8/9", "allow")]
    urls = [None, "", "nohost/en/7", "http://example.com/en/7", "https://A.Example.COM/en/78?x#y", "http://xexample.com/en/71", "http://example.net", "http://b.example.net?q", "http://c.a.example.net/de/8/9/1", "http://exa.net/de/8", "http://network/de/", "x://com/en/", "http://com/en"]
    urls += ["http://hot.example.com/en/7"] * 50
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(urls)], "page_id bigint, url string, html string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, table).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    monkeypatch.setattr(url_filter, "HOT_LEAST", 4)  # the url of 50 pages is split
    again = {r.page_id: r for r in url_filter.judge(pages, table).collect()}
    assert again == got
    assert {r.verdict for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), table).count() == 0


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_decontamination_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(40)] + ["ü", "é9"]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [make(n) for n in (25, 10, 11, 9, 3, 1, 60)] + [None, "", "!!", "x " * 30]
    texts = EDGES + [make(80) for _ in range(30)]
    for k in range(40):
        src = items[k % 7].split()
        a = int(rng.integers(0, max(len(src) - 9, 1)))
        texts.append(" ".join([make(12).upper(), ", ".join(src[a : a + int(rng.integers(8, 16))]), make(9)]))
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, texts), benchmark).collect()}
    wins = [(i, (w := words_of(t))[k : k + min(len(w), 10)]) for i, t in enumerate(items) if words_of(t) for k in range(max(len(words_of(t)) - 9, 1))]
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        w, hit, ids = words_of(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
        r = got[d]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(ids), bool(hit)), d
    more = documents(spark, texts).withColumns({c: F.lit(c) for c in CLASHES})
    kept = decontaminate.clean(more, benchmark).collect()
    assert {r.doc_id for r in kept} == {d for d in got if not got[d].contaminated} and all(r[c] == c for r in kept for c in CLASHES)
    monkeypatch.setattr(decontaminate, "MAP_DIGITS", 7)  # a map that lets most fingerprints pass
    again = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, texts), benchmark).collect()}
    assert again == got
    assert {r.contaminated for r in decontaminate.decontaminate(documents(spark, texts), benchmark.limit(0)).collect()} == {False}
    assert decontaminate.clean(documents(spark, ["x"]).limit(0), benchmark).count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    s = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def test_simhash_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice([f"v{i}" for i in range(500)], 120)) for _ in range(25)]
    texts = EDGES[:7] + EDGES[8:] + base
    for t in base[:12]:
        for _ in range(6):
            w = t.split()
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(list(range(len(texts))), prints)


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}


def test_near_dedup_finds_copies_of_similarity_08_and_leaves_others(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 7)}{i}" for i in range(4000)]
    draw = lambda n: [vocabulary[int(4000 * x**3)] for x in rng.random(n)]
    groups, texts, owner = [draw(int(n)) for n in rng.integers(80, 1500, 60)], [], []
    for g, base in enumerate(groups):
        texts.append(" ".join(base))
        owner.append(g)
        for _ in range(3):
            w = list(base)
            for k in rng.choice(len(w), max(1, len(w) // 60), replace=False):
                w[k] = str(rng.choice(vocabulary))
            if len(shingles(" ".join(w)) & shingles(texts[-1])) and len(shingles(" ".join(w)) & shingles(" ".join(base))) >= 0.8 * len(shingles(" ".join(w)) | shingles(" ".join(base))):
                texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
                owner.append(g)
    texts += [" ".join(draw(300)) for _ in range(200)]
    owner += range(60, 260)
    kept = [r.doc_id for r in simhash.deduplicate(documents(spark, texts)).collect()]
    assert {owner[d] for d in kept} == set(owner)  # every group has a row left, and all clean texts stay
    copies = len(texts) - len(set(owner))
    half = [*(f"p{i}" for i in range(90)), *(f"q{i}" for i in range(10))]
    below = [" ".join(half), " ".join([*half[:90], *(f"r{i}" for i in range(12))]), " ".join([*half[:94], *(f"s{i}" for i in range(6))])]  # 0.80 and 0.88 to the first
    assert len(shingles(below[0]) & shingles(below[1])) < 0.8 * len(shingles(below[0]) | shingles(below[1]))
    assert {r.doc_id for r in simhash.deduplicate(documents(spark, below[:2])).collect()} == {0, 1}
    assert copies > 80 and (len(texts) - len(kept)) / copies >= 0.9


def test_near_dedup_links_are_within_their_budgets(spark):
    rng = np.random.default_rng(10)
    rows = [bytes(rng.integers(0, 256, 40, dtype=np.uint8)) for _ in range(20)]
    for base in list(rows):
        for _ in range(20):  # more than PAIRS members for a key
            x = int.from_bytes(base, "little")
            for at, n, size in ((0, 64, 5), (64, 64, 8), (128, 64, 20), (192, 128, 40)):
                for b in rng.choice(n, int(rng.integers(0, size)), replace=False):
                    x ^= 1 << int(at + b)
            rows.append(x.to_bytes(40, "little"))
    rows = sorted({r[24:]: r for r in rows}.values())
    check = simhash.allowed()
    apart = lambda a, b, at, n: ((int.from_bytes(a, "little") ^ int.from_bytes(b, "little")) >> at & (1 << n) - 1).bit_count()
    near = lambda a, b: min(apart(a, b, at, 64) for at in (0, 64, 128)) <= 4 and apart(a, b, 192, 128) <= check
    frame = spark.createDataFrame([(bytearray(r[:24]), bytearray(r[24:])) for r in rows], "words binary, bits binary")
    of = {r[24:]: r for r in rows}
    found = {(bytes(r.a), bytes(r.b)) for r in simhash.links(frame, check).collect()}
    assert found and all(near(of[a], of[b]) for a, b in found)
    roots = {bytes(r.node): bytes(r.root) for r in simhash.components(simhash.links(frame, check)).collect()}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            assert not near(a, b) or roots[a[24:]] == roots[b[24:]]


def test_simhash_keeps_one_row_of_each_component(spark):
    rng = np.random.default_rng(4)
    a, b, c, d, e = (" ".join(rng.choice([f"v{i}" for i in range(500)], 120)) for _ in range(5))
    rows = [(3, a), (7, a), (7, b), (None, c), (None, d), (None, a), (None, None), (9, e), (None, e), (9, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    more = simhash.deduplicate(docs.withColumns({c: F.lit(c) for c in CLASHES})).collect()
    assert sorted(map(str, (r[:6] for r in more))) == sorted(map(str, map(tuple, got.collect()))) and {r[6:] for r in more} == {tuple(CLASHES)}
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(3, a), (7, b), (9, e), (None, c), (None, d), (None, None)]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)


def test_links_of_random_and_crowded_fingerprints(spark):
    rng = np.random.default_rng(3)
    bits = set(rng.integers(0, 1 << 63, 300).tolist())
    for centre in list(bits)[:6]:  # crowds about a centre, chains of near fingerprints, and edges at 4 and 5 bits
        x = centre
        for _ in range(60):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            bits.add(x if x < 1 << 63 else x - (1 << 64))
            x = centre if rng.random() < 0.6 else x
    for b in range(64):
        bits.add((1 << b) if b < 63 else -(1 << 63))
    bits = sorted(bits)
    frame = spark.createDataFrame([(b,) for b in bits], "bits bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = plain_components(bits, [b & (2**64 - 1) for b in bits])
    groups = {}
    for b, w in zip(bits, want):
        groups.setdefault(w, set()).add(roots.get(b, b))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = EDGES + ["It's ÉTÉ. x<|endoftext|>Y <|ENDOFTEXT|>", "don't, stop.. ok?! a.", "é. ̈. ß, 12,5", "ΟΔΟΣ. Σ", "a" * 5000] * 2
    docs = documents(spark, texts).repartition(3)
    rows = packing.pack(docs, path, window=64, with_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert sum((r["ids"] for r in by_doc[i]), []) == ids and {r.doc_tokens for r in by_doc[i]} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r.length == len(r["ids"]) for r in by_doc[i])
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at))) and all(n == 64 for s, n in at.items() if s < len(at) - 1)
    padded = {r.sequence_id: r["ids"] for r in packing.sequences(packing.pack(docs, path, window=64, with_ids=True), 64).collect()}
    assert all(len(x) == 64 or len(x) & (len(x) - 1) == 0 for x in padded.values())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_looks_each_word_up_once(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    words = packing._WordIds(path)
    letters = [chr(c) for c in range(0x61, 0x100) if chr(c).isalpha() and chr(c) == chr(c).lower() and chr(c) not in "\xaa\xb5\xba"]
    texts = ["Straße naïve, garçon. ñandú! the THE the", "".join(letters) + " " + " ".join(letters), "a\x0bb\x0cc\x1cd\x85e\xa0f", " \t lead  and trail \n", "", None]
    texts += ["x <|endoftext|>Y", "e\u0301t\u00e9, \u0130, \u0308. ÷x µ ª. a.. !. x| | ’s don't, 12.", "é" * 60 + ", " + "b" * 400, "漢字. 𝒳, 👍! nä,̈"]
    asked, encode = [], packing._WordIds._encode
    monkeypatch.setattr(packing._WordIds, "_encode", lambda self, x: asked.extend(x) or encode(self, x))
    end = np.array([2], words.dtype).tobytes()
    for chunk in (8, 100, 1 << 20):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        got = [np.frombuffer(x, words.dtype).tolist() for x in packing._ids_of([None if t is None else t.encode() for t in texts], words, end)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts], chunk
    assert not {"the", "naïve", "garçon", "straße", "lead"} & set(asked) and "’s" in asked
    short = [w for w in asked if len(w.encode()) <= packing.CACHE_BYTES]
    assert len(short) == len(set(short))
    assert list(packing._ids_of([], words, end)) == [] and list(packing._ids_of([None, b""], words, end)) == [end, end]
