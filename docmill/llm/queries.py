"""Queries of the operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, near_dup, packing, quality_classifier, quality_rules, substring_dedup, toxicity, url_rules
from .sampling import held_out
from .textkit import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    # held-out rows are not even among the unlabelled texts
    model = quality_classifier.fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = quality_classifier.score(docs, model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    templates = F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m["template"])))
    return found.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size("license_matches").cast("long").alias("n_matches"),
        F.array_join(templates, ",").alias("templates"),
        F.aggregate("license_matches", F.lit(0).cast("long"), lambda a, m: a + m["to_word"] - m["from_word"]).alias("n_license_words"),
        F.coalesce(F.array_max(F.transform("license_matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.array_join(F.transform("license_matches", lambda m: F.concat_ws(":", m["template"], m["from_word"].cast("string"), m["to_word"].cast("string"))), ",").alias("spans"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES_SCHEMA)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_occurrences(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return marked.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = near_dup.classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(entries, "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask_of("v1")).cast("long")) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_by_lang")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = substring_dedup.repeated_substrings(docs)
    removed = F.aggregate(F.zip_with("span_from", "span_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    digests = texts.select("text_key", "n_bytes", removed.alias("n_removed"), F.size("span_from").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", substring_dedup.key_of(F.col("text")).alias("text_key")).join(digests, "text_key").drop("text_key")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license_scan": op2_license_scan,
    "op3_url_rules": op3_url_rules,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dup": op6_near_dup,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_substrings": op9_substrings,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_url_rules"] = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.h || r.q) DESC, length(r.h) DESC, r.verdict DESC, r.h || r.q DESC) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.q))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path AND m.k = 1
"""

ORACLE_SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS k
  FROM d),
g AS (
  SELECT k, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g),
cov AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY k),
m AS (
  SELECT doc_id, t, len(ws) AS n_words,
         length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
         length(t) - length(translate(t, '!?', '')) AS n_shouts,
         length(t) - length(translate(t, '0123456789', '')) AS n_digits,
         length(t) - length(translate(t, '|', '')) AS n_pipes
  FROM w LEFT JOIN cov USING (k)),
f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END AS base,
         CASE WHEN 100 * n_symbols > 10 * greatest(word_chars, 1) THEN 4 ELSE 0 END
         + CASE WHEN 100 * n_upper > 40 * greatest(word_chars, 1) THEN 8 ELSE 0 END
         + CASE WHEN 100 * n_shouts > 30 * greatest(n_words, 1) THEN 16 ELSE 0 END
         + CASE WHEN 100 * n_pipes > 20 * greatest(n_words, 1) THEN 32 ELSE 0 END
         + CASE WHEN 100 * n_dup_lines > 50 * greatest(n_lines, 1) THEN 64 ELSE 0 END
         + CASE WHEN 100 * n_digits > 50 * greatest(word_chars, 1) THEN 128 ELSE 0 END
         + CASE WHEN word_chars > 25 * greatest(n_words, 1) OR word_chars < 2 * n_words THEN 256 ELSE 0 END AS more,
         CASE WHEN n_words > 10000000 THEN 512 ELSE 0 END AS unused
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base > 0 AS base_failed, base + more = 0 AS kept, CAST(base + more + unused AS BIGINT) AS fail_bits
FROM f
"""

ORACLE_SQL["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT k, dw.n, i, item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, n, i FROM h)) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""

ORACLE_SQL["op6_near_dup"] = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, row_number() OVER () AS k FROM documents GROUP BY ALL),
w AS (SELECT k, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS shingle FROM (SELECT k, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT k, shingle, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT k, sum(n) AS total FROM c GROUP BY k),
o AS (SELECT a.k AS a, b.k AS b, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON b.shingle = a.shingle AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT o.a, o.b FROM o JOIN z x ON x.k = o.a JOIN z y ON y.k = o.b WHERE common >= 0.8 * (x.total + y.total - common)),
near AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT k, k AS m FROM t UNION SELECT reach.k, near.b FROM reach JOIN near ON near.a = reach.m),
class AS (SELECT reach.k, min(t.first_id) AS class_id FROM reach JOIN t ON t.k = reach.m GROUP BY reach.k)
SELECT d.doc_id, class.class_id FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN class ON class.k = t.k
"""

ORACLE_SQL["op10_line_dedup"] = r"""
WITH tx AS (SELECT DISTINCT text AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT row_number() OVER () AS k, t, string_split(t, chr(10)) AS ls FROM tx),
l AS (SELECT k, i - 1 AS n, ls[i] AS line, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ts FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM k) WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
m AS (SELECT *, list_transform(ts, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ms FROM l),
f AS (SELECT *, [CAST(len(ms) AS VARCHAR)] || ms[1:4] AS leaf FROM m),
reached AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT k) >= 10),
held AS (SELECT f.* FROM f JOIN reached ON reached.leaf = f.leaf),
tok AS (SELECT leaf, unnest(range(1, len(ms) + 1)) AS p, unnest(ms) AS tok FROM held),
sup AS (SELECT leaf, p, tok FROM tok WHERE tok <> '<*>' GROUP BY ALL HAVING count(*) >= 10),
u AS (SELECT leaf, line, len(ms) AS size, unnest(range(1, len(ms) + 1)) AS p, unnest(ms) AS tok FROM (SELECT DISTINCT leaf, line, ms FROM held)),
pat AS (SELECT u.leaf, u.line, list(coalesce(sup.tok, '<*>') ORDER BY u.p) AS pattern FROM u LEFT JOIN sup ON sup.leaf = u.leaf AND sup.p = u.p AND sup.tok = u.tok GROUP BY u.leaf, u.line HAVING count(sup.tok) >= 0.5 * max(size)),
lp AS (SELECT h.k, h.n, h.leaf, pat.pattern FROM held h JOIN pat ON pat.leaf = h.leaf AND pat.line = h.line),
rec AS (SELECT leaf, pattern FROM lp GROUP BY leaf, pattern HAVING count(DISTINCT k) >= 10),
same AS (SELECT line FROM held GROUP BY line HAVING count(DISTINCT k) >= 10),
long AS (SELECT line FROM l WHERE len(ts) >= 20 GROUP BY line HAVING count(DISTINCT k) >= 2),
lost AS (SELECT lp.k, lp.n FROM lp JOIN rec ON rec.leaf = lp.leaf AND rec.pattern = lp.pattern UNION SELECT h.k, h.n FROM held h JOIN same ON same.line = h.line UNION SELECT l.k, l.n FROM l JOIN long ON long.line = l.line),
d AS (SELECT k, list(n) AS ns FROM lost GROUP BY k),
o AS (SELECT k.t, len(k.ls) AS n_lines, coalesce(len(d.ns), 0) AS n_dropped, array_to_string(list_filter(k.ls, lambda x, i: NOT coalesce(list_contains(d.ns, i - 1), FALSE)), chr(10)) AS kept FROM k LEFT JOIN d ON d.k = k.k)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o ON o.t = documents.text
"""

ORACLE_SQL["op9_substrings"] = """
WITH t AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, md5(h[2 * i + 1:2 * i + 400]) AS x FROM (SELECT k, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t WHERE length(h) >= 400)),
r AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT k, i FROM w JOIN r ON r.x = w.x),
m AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM g),
s AS (SELECT k, min(i) AS s, max(i) + 200 AS e FROM (SELECT k, i, sum(opens) OVER (PARTITION BY k ORDER BY i) AS j FROM m) GROUP BY k, j),
p AS (SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS before FROM s),
c AS (SELECT p.k, string_agg(h[2 * before + 1:2 * s], '' ORDER BY s) AS head, max(e) AS last, count(*) AS n, sum(e - s) AS removed FROM p JOIN t ON t.k = p.k GROUP BY p.k)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM t LEFT JOIN c ON c.k = t.k
"""
