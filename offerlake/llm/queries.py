"""Queries of this subpackage: one opN_<name> for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, classifier, decontaminate, divergence, license_scan, line_dedup, nearest, packing, quality_rules, simhash, substring_dedup, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(*cols)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select("doc_id", classifier.held_out().alias("held_out"), "score", "predicted")


#: (host, path, verdict)
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return chat.rotate(_table(spark, sf_dir, "conversations")).withColumn("spans", spans)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_quality_classifier, op4_url_filter, op5_decontamination,
        op6_simhash, op7_chat_rotation, op8_substring_dedup, op9_line_dedup, op10_packing,
        op11_nearest_neighbours, op12_embedding_whitening, op13_source_divergence,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS stops
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.10 AND stops / n_words >= 0.04
    AND n_dup_lines / n_lines <= 0.50 AND n_words / n_lines >= 3 AS kept
FROM m""",
    "op4_url_filter": rf"""
WITH r(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_UPPER}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY len(r.host || r.path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op5_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM b),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)),
h AS (SELECT dg.doc_id, dg.i, dg.k, bg.item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.k = bg.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN m ON dw.doc_id = m.doc_id""",
    "op7_chat_rotation": f"""
WITH c AS (SELECT conv_id, turn, replace(coalesce(nullif(trim(replace(role, chr(10), ' ')), ''), 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS txt FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, txt) - 1 AS i FROM c),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.conv_id, perspective, i, (i // {chat.PART})::INT AS part, txt, speaker = perspective AS own,
    '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || '|>' || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (
  SELECT *, head || txt || chr(10) || '<|end|>' || chr(10) AS piece,
    sum(len(head) + len(txt) + 9) OVER (PARTITION BY conv_id, perspective, part ORDER BY i) - len(txt) - 9 AS first FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY i) AS rendered,
  coalesce(string_agg(first || '-' || first + len(txt), ',' ORDER BY i) FILTER (own), '') AS spans, coalesce(sum(len(txt)) FILTER (own), 0)::BIGINT AS n_target_chars
FROM r GROUP BY conv_id, perspective, part""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY win) > 1),
c AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM t)),
n AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
e AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT e.r, string_agg(e.x, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN c ON e.r = c.r AND e.p = c.p GROUP BY e.r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN k ON d.r = k.r""",
    # Like lines of 5 words or more share their first or last half of (m - 1) / 2 words, m being the longer's words.
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM d),
p AS (SELECT r, doc_id, line, line_no, lower(trim(regexp_replace(line, '[ \x09-\x0D]+', ' ', 'g'))) AS plain FROM l),
k AS (SELECT plain, min((doc_id, line_no)) AS first, string_split(plain, ' ') AS w FROM p WHERE plain <> '' GROUP BY plain),
s AS (SELECT plain, first, w, len(w) AS n FROM k WHERE len(w) >= 5),
h AS (
  SELECT DISTINCT plain, first, w, n, c, side, CASE WHEN side = 0 THEN w[1 : c] ELSE w[n - c + 1 : n] END AS half
  FROM (SELECT *, unnest([(n - 1) // 2, n // 2]) AS c FROM s), (VALUES (0), (1)) t(side)),
y AS (
  SELECT DISTINCT a.plain AS plain, a.w AS aw, b.w AS bw FROM h a JOIN h b
  ON a.c = b.c AND a.side = b.side AND a.half = b.half AND abs(a.n - b.n) <= 1 AND b.first < a.first),
z AS (
  SELECT plain, greatest(len(aw), len(bw)) AS m,
    coalesce(list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[i] <> bw[i]), true) - 1, least(len(aw), len(bw))) AS head,
    coalesce(list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[-i] <> bw[-i]), true) - 1, least(len(aw), len(bw))) AS tail FROM y),
x AS (SELECT DISTINCT plain FROM z WHERE head + tail >= m - 1),
m AS (
  SELECT p.r, p.line, p.line_no, p.plain <> '' AND (x.plain IS NOT NULL OR k.first <> (p.doc_id, p.line_no)) AS gone
  FROM p LEFT JOIN k ON p.plain = k.plain LEFT JOIN x ON p.plain = x.plain),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.r = o.r""",
    "op13_source_divergence": rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '{divergence.TERM}') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o SEMI JOIN v ON o.lang = v.lang AND o.term = v.term GROUP BY ALL),
z AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
t AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, term) AS ln, count(*) OVER (PARTITION BY lang, source) AS vs,
    sum(n) OVER (PARTITION BY lang, source) AS gn, sum(n) OVER (PARTITION BY lang) AS tn FROM z),
s AS (
  SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + {divergence.SMOOTH})::HUGEINT) // (gn + {divergence.SMOOTH} * vs)::HUGEINT AS p,
    1 + ({divergence.SCALE}::HUGEINT * (ln + {divergence.SMOOTH})::HUGEINT) // (tn + {divergence.SMOOTH} * vs)::HUGEINT AS q FROM t),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT i.lang, i.source, j.source AS item, sum(abs(i.p - j.p)) AS value FROM s i JOIN s j ON i.lang = j.lang AND i.term = j.term GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= {divergence.TOP_TERMS}""",
}
