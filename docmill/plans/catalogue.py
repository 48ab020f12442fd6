"""Queries of the operators over the driver's tables, each with the SQL that gives the same rows.

The tables hold no legal corpus, so what the operators need is derived from them by plain
expressions, written alike in both languages: a law's type, number and year from doc_id, headings
between a document's lines, answers that cite, and so on. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import metrics as m
from ..functions import quality as q
from ..functions import rules
from ..functions import text as tx
from ..operators import answer as an
from ..operators import evaluate as ev
from ..operators import finalize as fin
from ..operators import index as ix
from ..operators import retrieval as rt
from ..operators import structure as st
from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r6_scaled(c: Column) -> Column:
    """r6 as DuckDB rounds a double: its millionfold to a whole number. F.round takes the decimal form, so the two part at a half."""
    return F.round(c * 1e6) / 1e6


# ---------------------------------------------------------------- derived tables


def chunks_view(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of laws."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % n + 1).cast("int"))
    return docs.select(
        i.alias("id"),
        i.alias("ord"),
        "text",
        "lang",
        F.col("source").alias("source_file"),
        F.concat(F.lit("Pasal "), (i % 40 + 1).cast("string")).alias("pasal_id"),
        F.col("lang").alias("chunk_kind"),
        (i % 7).cast("int").alias("chunk_index"),
        (i % 35 + 1990).cast("int").alias("publication_year"),
        (i % 35 + 1990).cast("int").alias("year"),
        (i % 5 + 1).cast("int").alias("regulation_hierarchy"),
        F.when(i % 4 == 0, "Tidak Berlaku").otherwise("Berlaku").alias("active_status"),
        F.when(F.col("quality") == 0, "needs_review").otherwise("ok").alias("quality_status"),
        pick(4, "Undang-Undang", "Peraturan Pemerintah", "Peraturan Presiden", "Peraturan Menteri").alias("regulation_type"),
        (i % 50).cast("string").alias("nomor"),
        pick(3, "ketenagakerjaan dan upah", "perizinan berusaha", "").alias("tentang"),
        F.lit("").alias("bab_title"),
        F.lit("").alias("bagian_title"),
    )


CHUNKS = """
c AS (
  SELECT d.doc_id AS id, d.doc_id AS ord, d.text, d.lang, d.source AS source_file, 'Pasal ' || (d.doc_id % 40 + 1) AS pasal_id, d.lang AS chunk_kind,
         CAST(d.doc_id % 7 AS INTEGER) AS chunk_index, CAST(1990 + d.doc_id % 35 AS INTEGER) AS publication_year, CAST(1 + d.doc_id % 5 AS INTEGER) AS regulation_hierarchy,
         CASE WHEN d.doc_id % 4 = 0 THEN 'Tidak Berlaku' ELSE 'Berlaku' END AS active_status,
         CASE WHEN l.quality = 0 THEN 'needs_review' ELSE 'ok' END AS quality_status,
         ['Undang-Undang', 'Peraturan Pemerintah', 'Peraturan Presiden', 'Peraturan Menteri'][d.doc_id % 4 + 1] AS regulation_type,
         ['uu', 'pp', 'perpres', 'permen'][d.doc_id % 4 + 1] AS kind,
         CAST(d.doc_id % 50 AS VARCHAR) AS nomor, ['ketenagakerjaan dan upah', 'perizinan berusaha', ''][d.doc_id % 3 + 1] AS tentang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
s AS (
  SELECT *, CASE WHEN doc_id_mod = 1 THEN FALSE ELSE TRUE END AS domain
  FROM (SELECT *, id % 3 AS doc_id_mod FROM c))
"""

def meta() -> Column:
    return F.struct("regulation_type", "regulation_hierarchy", "nomor", "tentang", "publication_year", "year", "active_status", "source_file", "pasal_id", "quality_status")


def in_domain() -> Column:
    return q.in_domain(F.col("tentang"), F.col("bab_title"), F.col("bagian_title"), F.col("regulation_type"), F.col("nomor"))

#: The batch of questions that lexical queries ask.
QUESTIONS = (("q1", "the and that on"), ("q2", "der die und in"), ("q3", "de la que el the the"), ("q4", "le les des est"), ("q5", "nothing matches zzzz"))
QUESTIONS_SQL = "asked(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ")"

BM25_SQL = """
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS dl FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(max(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""


def lexical(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = questions.select(F.explode(ix.tokens(F.col("query"))).alias("term"))
    posted, lengths = ix.postings(docs, terms=terms), ix.doc_lengths(docs)
    n, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    return rt.bm25(questions, posted, lengths, ix.term_stats(ix.document_frequencies(docs), n), avgdl=avgdl)


# ---------------------------------------------------------------- index and retrieval


@query(f"""
WITH {QUESTIONS_SQL}, {BM25_SQL},
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, post.id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
       FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (id), n GROUP BY query_id, post.id)
SELECT query_id, id, CAST(k AS INTEGER) AS rank, round(s, 6) AS bm25_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS k FROM sc WHERE s > 0) WHERE k <= 10
""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(QUESTIONS, "query_id string, query string")
    return rt.bm25_top(lexical(spark, d, asked), 10).select("query_id", "id", "rank", r6(F.col("bm25_score")).alias("bm25_score"))


@query(f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return ix.term_stats(ix.document_frequencies(docs), docs.count()).select("term", "df", r6(F.col("idf")).alias("idf"))


@query(f"WITH {BM25_SQL} SELECT id, CAST(dl AS BIGINT) AS dl FROM dl")
def bm25_doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return ix.doc_lengths(table(spark, d, "documents"), id_col="doc_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(rows: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


DENSE_SQL = """
dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, 1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dist
       FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS k FROM dn)
"""


@query(f"WITH {DENSE_SQL} SELECT query_id, id, round(dist, 6) + 0 AS dense_distance, CAST(k AS INTEGER) AS rank FROM dr WHERE k <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rt.dense(vector_queries(rows), rows, 10).select("query_id", "id", r6(F.col("dense_distance")).alias("dense_distance"), "rank")


@query("""
WITH dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, 1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dist
            FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.label = 1)
SELECT query_id, id, round(dist, 6) + 0 AS dense_distance, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS k FROM dn) WHERE k <= 5
""")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rt.dense(vector_queries(rows), rows, 5, where=F.col("label") == 1).select("query_id", "id", r6(F.col("dense_distance")).alias("dense_distance"), "rank")


def hybrid_hits(spark: SparkSession, d: str, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical hits of the query vectors; the words asked are the first five of the document with the vector's id."""
    rows = vectors(spark, d)
    words = F.array_join(F.slice(ix.tokens(F.col("text")), 1, 5), " ")
    asked = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("query")).join(rows.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.dense(vector_queries(rows), rows, k), rt.bm25_search(asked, docs, k)


HYBRID_SQL = f"""
{DENSE_SQL}, {BM25_SQL},
hq AS (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:5]) AS term FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
qt AS (SELECT query_id, term, count(*) AS qf FROM hq GROUP BY ALL),
sc AS (SELECT query_id, post.id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
       FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (id), n GROUP BY query_id, post.id),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS k FROM sc WHERE s > 0),
hits AS (
  SELECT query_id, id, 0 AS src, k, 1.0 / (60 + k) AS w, dist, NULL AS s FROM dr WHERE k <= 40
  UNION ALL SELECT query_id, id, 1, k, 0.7 / (60 + k), NULL, s FROM sr WHERE k <= 40),
fused AS (SELECT query_id, id, sum(w) AS rrf, arg_min(src, src) AS src, arg_min(k, src) AS k, max(dist) AS dist, max(s) AS s FROM hits GROUP BY query_id, id)
"""


@query(f"WITH {HYBRID_SQL} SELECT query_id, id, round(rrf, 9) AS rrf_score, src AS first_source, CAST(k AS INTEGER) AS first_rank, round(dist, 6) + 0 AS dense_distance, round(s, 6) AS bm25_score FROM fused")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    dense, sparse = hybrid_hits(spark, d)
    fused = rt.fuse((dense, "dense_distance", rules.DENSE_WEIGHT), (sparse, "bm25_score", rules.SPARSE_WEIGHT))
    return fused.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "first_source", "first_rank", r6(F.col("dense_distance")).alias("dense_distance"), r6(F.col("bm25_score")).alias("bm25_score"))


BOOST = "0.030 * CAST(active_status = 'Berlaku' AS INTEGER) + {years} + greatest(0, 6 - regulation_hierarchy) * 0.003 - {review}"
YEARS = "least(greatest(publication_year - 2000, 0), 40) * 0.001"
REVIEW = "CASE WHEN quality_status = 'needs_review' THEN 0.010 ELSE 0 END"
DOMAIN_BOOST = BOOST.format(years=f"CASE WHEN domain THEN {YEARS} ELSE -0.1 END", review=REVIEW)


@query(f"""
WITH {HYBRID_SQL}, {CHUNKS},
f2 AS (SELECT fused.query_id, fused.id, s.domain, rrf + {DOMAIN_BOOST} AS score, src, fused.k, s.source_file, s.pasal_id, s.chunk_kind, s.chunk_index FROM fused JOIN s ON s.id = fused.id),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, pasal_id, chunk_kind, chunk_index ORDER BY round(score, 9) DESC, src, k, id) AS o FROM f2 WHERE domain)
SELECT query_id, id, round(score, 6) AS final_score, CAST(p AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, src, k, id) AS p FROM u WHERE o = 1) WHERE p <= 8
""")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    dense, sparse = hybrid_hits(spark, d)
    return rt.hybrid(dense, chunks_view(spark, d), 8, meta=meta(), sparse=sparse, domain=in_domain()).select("query_id", "id", r6_scaled(F.col("final_score")).alias("final_score"), "rank")


@query(f"""
WITH {DENSE_SQL}, {CHUNKS},
f2 AS (SELECT dr.query_id, s.id, {DOMAIN_BOOST} AS score, dr.k FROM dr JOIN s ON s.id = dr.id WHERE dr.k <= 40 AND domain)
SELECT query_id, id, round(score, 6) AS final_score, CAST(p AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, k) AS p FROM f2) WHERE p <= 8
""")
def dense_only_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    hits = rt.dense_only(rt.dense(vector_queries(rows), rows, 40)).join(chunks_view(spark, d), "id").where(in_domain())
    scored = hits.withColumn("final_score", rt.boost("domain", meta(), F.col("rrf_score"), in_domain()))
    return rt.top(scored, 8, [F.round("final_score", rt.TIE_DIGITS).desc(), F.col("first_rank")]).select("query_id", "id", r6_scaled(F.col("final_score")).alias("final_score"), "rank")


@query(f"""
WITH {DENSE_SQL}, {HYBRID_SQL.split('fused AS')[0].split(DENSE_SQL)[1].lstrip().removeprefix(',').rstrip().removesuffix(',')},
fused AS (SELECT query_id, id, sum(w) AS rrf FROM hits GROUP BY query_id, id),
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS k FROM fused),
b AS (SELECT query_id, id, k FROM dr WHERE k <= 8)
SELECT a2.query_id, CAST(count(b.id) AS BIGINT) AS shared, CAST(count(*) AS BIGINT) AS proposed
FROM (SELECT * FROM a WHERE k <= 8) a2 LEFT JOIN b ON b.query_id = a2.query_id AND b.id = a2.id GROUP BY a2.query_id
""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Dense alone against dense and lexical: how much of the top 8 they share."""
    dense, sparse = hybrid_hits(spark, d)
    fused = rt.fuse((dense, "dense_distance", rules.DENSE_WEIGHT), (sparse, "bm25_score", rules.SPARSE_WEIGHT)).withColumn("score", F.round("rrf_score", 12))
    proposed = rt.top(fused, 8, [F.desc("score"), F.col("id")]).select("query_id", "id")
    plain = dense.where("rank <= 8").select("query_id", "id", F.lit(1).alias("there"))
    return proposed.join(plain, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("there").alias("shared"), F.count(F.lit(1)).alias("proposed"))


def boost_query(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = chunks_view(spark, d)
        return rows.select("id", r6(rt.boost(kind, meta(), F.lit(0.01), in_domain())).alias("score"))

    return run


for _kind, _sql in {
    "domain": DOMAIN_BOOST,
    "plain": BOOST.format(years=YEARS, review=REVIEW),
    "spec": BOOST.format(years=YEARS, review="0"),
    "service": "least(greatest(publication_year - 1945, 0), 100) / 10000.0",
}.items():
    QUERIES[f"lex_posterior_{_kind}"] = boost_query(_kind)
    ORACLE_SQL[f"lex_posterior_{_kind}"] = f"WITH {CHUNKS} SELECT id, round(0.01 + {_sql}, 6) AS score FROM s"


@query(f"""
WITH {CHUNKS}
SELECT id, round(greatest(0.1, 1.0 + CASE WHEN active_status <> 'Berlaku' THEN 5.0 ELSE 0 END - CASE WHEN contains('apa isi pasal 12 ini', lower(pasal_id)) THEN 0.5 ELSE 0 END
       - CASE WHEN publication_year > 2020 THEN 0.2 WHEN publication_year > 2010 THEN 0.1 ELSE 0 END - CASE WHEN regulation_hierarchy <= 2 THEN 0.3 ELSE 0 END), 6) AS penalty
FROM s
""")
def legal_pre_score(spark: SparkSession, d: str) -> DataFrame:
    return chunks_view(spark, d).select("id", r6(rt.pre_score(F.lit("Apa isi Pasal 12 ini"), meta())).alias("penalty"))


@query(f"""
WITH {CHUNKS}, u AS (SELECT *, {DOMAIN_BOOST} AS score FROM s WHERE domain),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source_file, pasal_id, chunk_kind, chunk_index ORDER BY round(score, 9) DESC, ord) AS k FROM u)
SELECT lang AS query_id, id, round(score, 6) AS final_score, CAST(p AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, ord) AS p FROM o WHERE k = 1) WHERE p <= 8
""")
def dedupe_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_view(spark, d).where(in_domain()).withColumn("query_id", F.col("lang")).withColumn("final_score", F.round(rt.boost("domain", meta(), F.lit(None), in_domain()), 9))
    return rt.dedupe_top(rows, 8).select("query_id", "id", r6(F.col("final_score")).alias("final_score"), "rank")


TRIGGERS = ("mendesak", "surat peringatan", "PHK", "pkwt kontrak", "outsourcing upah", "lain")
TRIGGER_SQL = "(" + str(list(TRIGGERS)) + ")[conv_id % 6 + 1]"


def turns_view(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(t) for t in TRIGGERS]), (F.col("conv_id") % 6 + 1).cast("int"))
    return table(spark, d, "conversations").withColumn("query", tx.squeeze(F.concat_ws(" ", word, F.coalesce("text", F.lit("")))))


def _sql_cases(expansions=rules.EXPANSIONS) -> str:
    return ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(query), '{t}')" for t in ts) + f" THEN '{e}' END" for ts, e in expansions)


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"""
WITH t AS (SELECT conv_id, turn, {SQUEEZE.format(TRIGGER_SQL + " || ' ' || coalesce(text, '')")} AS query FROM conversations)
SELECT conv_id, turn, sha256({SQUEEZE.format("concat_ws(' ', query, " + _sql_cases() + ")")}) AS expanded_sha256 FROM t
""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return turns_view(spark, d).select("conv_id", "turn", F.sha2(rt.expanded(F.col("query")).cast("binary"), 256).alias("expanded_sha256"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {SQUEEZE.format(TRIGGER_SQL + " || ' ' || coalesce(text, '')")} AS query FROM conversations),
w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda x: length(x) > 2 AND NOT list_contains({list(rules.STOPWORDS)}, x)) AS ts FROM t)
SELECT conv_id, turn, CAST(len(ts) AS BIGINT) AS n_terms, array_to_string(list_sort(ts), ' ') AS terms FROM w
""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    ts = rt.query_terms(F.col("query"))
    return turns_view(spark, d).select("conv_id", "turn", F.size(ts).cast("long").alias("n_terms"), F.array_join(F.array_sort(ts), " ").alias("terms"))


RELEVANT = (("en", "apakah the of pesangon"), ("de", "upah der heit"), ("fr", "phk que"), ("es", "los de la kontrak"))
RELEVANT_SQL = "rq(lang, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in RELEVANT) + ")"


def _terms_sql(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: length(t) > 2 AND NOT list_contains({list(rules.STOPWORDS)}, t))"


@query(f"""
WITH {CHUNKS}, {RELEVANT_SQL},
e AS (SELECT lang, query, {_terms_sql("concat_ws(' ', query, " + _sql_cases() + ")")} AS wide, list_filter({_terms_sql('query')}, lambda t: NOT list_contains({list(rules.GENERIC_TERMS)}, t)) AS special FROM rq),
j AS (SELECT s.*, e.query, e.wide, e.special, lower(s.text || ' ' || s.regulation_type || ' ' || s.pasal_id) AS hay, lower(s.text) AS narrow, least({DOMAIN_BOOST}, 1.0) AS fs
      FROM s JOIN e ON e.lang = s.lang),
v AS (SELECT *, len(list_filter(wide, lambda t: contains(hay, t))) / CAST(greatest(len(wide), 1) AS DOUBLE)
        - CASE WHEN len(special) > 0 AND len(list_filter(special, lambda t: contains(hay, t))) = 0 THEN 0.25 ELSE 0 END + fs * 0.05 AS value FROM j),
z AS (SELECT *, (len(special) = 0 OR len(list_filter(special, lambda t: contains(narrow, t))) > 0) AND round_even(greatest(value, 0) * greatest(len(wide), 1), 0) >= 1 AND value > 0 AS fits FROM v),
k AS (SELECT *, bool_or(fits) OVER (PARTITION BY lang) AS any_fits, row_number() OVER (PARTITION BY lang ORDER BY id) AS nth FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN fits THEN round(value, 9) END DESC NULLS LAST, id) AS p FROM k WHERE fits OR (NOT any_fits AND nth = 1))
SELECT lang AS query_id, id, round(CASE WHEN fits THEN value END, 6) AS context_relevance_score, CAST(p AS INTEGER) AS context_rank FROM o WHERE p <= 10
""")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(RELEVANT, "lang string, query string")
    docs = chunks_view(spark, d).join(F.broadcast(asked), "lang").withColumn("query_id", F.col("lang"))
    docs = docs.withColumn("final_score", rt.boost("domain", meta(), F.lit(0.0), in_domain()))
    hay = F.concat_ws(" ", "text", "regulation_type", "pasal_id")
    found = rt.relevant(docs, 10, haystack=hay, narrow=F.col("text"), order="id")
    return found.select("query_id", "id", r6(F.col("context_relevance_score")).alias("context_relevance_score"), "context_rank")


@query(f"""
WITH {CHUNKS},
p AS (SELECT * FROM (SELECT lang AS query_id, id, kind AS reg, source_file, pasal_id,
             row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank, list_distinct(['Pasal ' || (id % 13 + 1), 'Pasal ' || (id % 17 + 1)]) AS refs FROM c) WHERE rank <= 10),
l AS (SELECT kind AS reg, lower(pasal_id) AS t, pasal_id, source_file, id, row_number() OVER (PARTITION BY kind, lower(pasal_id) ORDER BY ord) AS n FROM c),
a AS (SELECT query_id, rank, reg, pasal_id, unnest(refs) AS target, unnest(range(len(refs))) AS pos FROM p),
g AS (SELECT a.* FROM a WHERE lower(target) <> lower(pasal_id)),
f AS (SELECT g.query_id, g.rank, g.pos, l.id, l.source_file, l.pasal_id FROM g JOIN l ON l.reg = g.reg AND l.t = lower(g.target) AND l.n = 1),
x AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = f.query_id AND p.source_file = f.source_file AND p.pasal_id = f.pasal_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, pasal_id ORDER BY rank, pos) AS n FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS xr FROM o WHERE n = 1)
SELECT query_id, id, source_file, pasal_id, CAST(rank AS INTEGER) AS from_rank, CAST(xr AS INTEGER) AS xref_rank FROM r WHERE xr <= 20
""")
def xref_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_view(spark, d).withColumn("reg", q.regulation_kind(F.col("regulation_type"))).withColumn("query_id", F.col("lang"))
    refs = F.concat(F.lit("lihat Pasal "), (F.col("id") % 13 + 1).cast("string"), F.lit(" dan pasal "), (F.col("id") % 17 + 1).cast("string"), F.lit("."))
    primary = rt.top(rows, 10, [F.col("ord")]).withColumn("referring", st.referenced_articles(refs))
    found = rt.cross_references(primary.select("query_id", "rank", "reg", "source_file", "pasal_id", "referring"), rows, F.col("referring"), limit=20, topic_guard=False)
    return found.select("query_id", "id", "source_file", "pasal_id", "from_rank", "xref_rank")


@query(f"""
WITH {CHUNKS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank FROM c) WHERE rank <= 10)
SELECT a.lang AS query_id, a.id, sha256(string_agg(CASE WHEN b.id = a.id THEN '>>> ' || b.text || ' <<<' ELSE b.text END, chr(10) ORDER BY b.chunk_index, b.ord)) AS text_sha256
FROM h a JOIN c b ON a.source_file = b.source_file AND a.pasal_id = b.pasal_id GROUP BY a.lang, a.id
""")
def sibling_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The articles around the first ten hits of each query."""
    rows = chunks_view(spark, d)
    both = rt.siblings(rt.top(rows.withColumn("query_id", F.col("lang")), 10, [F.col("ord")]), rows)
    return both.select("query_id", "id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"""
WITH {CHUNKS}, t AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY id) AS k FROM c),
b AS (SELECT source_file, k, 'SUMBER HUKUM ' || k || ': ' || regulation_type || ' No. ' || nomor || ' Tahun ' || publication_year || ', ' || pasal_id || chr(10) || trim(text, ' ')[1:2500] AS block FROM t WHERE k <= 6)
SELECT source_file AS query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY k)) AS context_sha256 FROM b GROUP BY source_file
""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_view(spark, d).withColumn("query_id", F.col("source_file"))
    docs = rt.top(rows, 6, [F.col("id")])
    joined = rt.context_text(docs, citation=md.compact_citation(meta()), text=F.col("text"), longest=2500)
    return joined.select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


@query(f"""
WITH {CHUNKS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS k FROM c) WHERE k <= 200),
t AS (SELECT lang, regulation_type || ' No. ' || nomor || ' Tahun ' || publication_year || ', ' || pasal_id AS citation, min(id) AS rank FROM h GROUP BY ALL)
SELECT lang AS query_id, citation, CAST(row_number() OVER (PARTITION BY lang ORDER BY rank, citation) AS INTEGER) AS place FROM t
""")
def reference_listing(spark: SparkSession, d: str) -> DataFrame:
    """The citations of each query's first 200 documents."""
    rows = chunks_view(spark, d).withColumn("query_id", F.col("lang"))
    return rt.reference_list(rt.top(rows, 200, [F.col("id")]), md.compact_citation(meta()))


MERGE_SQL = """
WITH h AS (SELECT user_id AS query_id, event_type AS id, CAST(event_id % 2 + 1 AS INTEGER) AS variant, event_id AS rank, round(value, 3) AS final_score FROM events WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY {}) AS k FROM h)
SELECT query_id, id, variant, rank, final_score FROM o WHERE k = 1
"""


def candidate_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("id"), (F.col("event_id") % 2 + 1).cast("int").alias("variant"), F.col("event_id").alias("rank"), F.round("value", 3).alias("final_score"))


@query(MERGE_SQL.format("final_score DESC, variant, rank"))
def merge_best(spark: SparkSession, d: str) -> DataFrame:
    return rt.merge_candidates(candidate_hits(spark, d), "best")


@query(MERGE_SQL.format("variant, rank"))
def merge_first(spark: SparkSession, d: str) -> DataFrame:
    return rt.merge_candidates(candidate_hits(spark, d), "first")


# ---------------------------------------------------------------- finalisation, joins, caches


@query("""
WITH n AS (SELECT doc_id + 1000000 AS doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2'))
SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT doc_id, source, lang FROM n
""")
def replace_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return fin.replace_sources(docs, docs.where(F.col("source").isin("src1", "src2")).withColumn("doc_id", F.col("doc_id") + 1000000), "source")


@query("""
WITH b AS (SELECT doc_id, source, lang, text, md5(text) AS id FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS k FROM b)
SELECT doc_id, CASE WHEN k > 1 THEN sha1(id || '::' || doc_id || '::' || source || '::' || lang || '::' || text[1:200]) ELSE id END AS id, CASE WHEN k > 1 THEN id END AS original_id FROM n
""")
def duplicate_id_repair(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("id", F.md5(F.col("text").cast("binary")))
    return fin.repair_duplicate_ids(docs, order_col="doc_id", source=F.col("source"), pasal=F.col("lang")).select("doc_id", "id", "original_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def cache_last_write(spark: SparkSession, d: str) -> DataFrame:
    return fin.last_writes(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""
WITH p AS (
  SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS page_number, 'pdfplumber' AS extractor, CAST(length(text) % 50 AS DOUBLE) AS score FROM documents
  UNION ALL SELECT source, CAST(doc_id AS INTEGER), 'pymupdf', CAST((length(text) + doc_id) % 50 AS DOUBLE) FROM documents WHERE doc_id % 5 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, CASE extractor WHEN 'pymupdf' THEN 0 ELSE 1 END) AS k FROM p)
SELECT doc_id, extractor, count(*) AS pages, sum(score) AS score FROM o WHERE k = 1 GROUP BY doc_id, extractor
""")
def best_extractor(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    page = lambda name, score: docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), F.lit(name).alias("extractor"), score.cast("double").alias("score"), F.col("doc_id").alias("_i"))
    pages = page("pdfplumber", F.length("text") % 50).unionByName(page("pymupdf", (F.length("text") + F.col("doc_id")) % 50).where("_i % 5 <> 0"))
    return fin.best_page(pages.drop("_i")).groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("score"))


@query("""
WITH p AS (SELECT doc_id // 8 AS doc, doc_id, text, 'e' || doc_id % 3 AS e FROM documents),
x AS (SELECT doc, '{' || string_agg('"' || e || '":' || n, ',' ORDER BY e) || '}' AS extractor_counts FROM (SELECT doc, e, count(*) AS n FROM p GROUP BY ALL) GROUP BY doc)
SELECT p.doc AS doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (trim(text, ' ') <> '')) AS text_sha256, count(*) AS page_count, min(extractor_counts) AS extractor_counts FROM p JOIN x ON x.doc = p.doc GROUP BY p.doc
""")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    """Eight pages a document."""
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select(F.floor(i / 8).cast("long").alias("doc_id"), i.alias("page_number"), "text", F.concat(F.lit("e"), (i % 3).cast("string")).alias("extractor"))
    return fin.document_text(pages).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "page_count", "extractor_counts")


@query(f"""
WITH {CHUNKS}, x AS (SELECT id, text, pasal_id, CASE WHEN id % 6 = 0 THEN 'Unknown' ELSE nomor END AS nomor, CASE WHEN id % 7 = 0 THEN 0 ELSE publication_year END AS year, tentang FROM c)
SELECT id, concat_ws(',', CASE WHEN nomor = 'Unknown' OR year = 0 THEN 'unknown_nomor_or_year' END, CASE WHEN tentang = '' THEN 'unknown_tentang' END, CASE WHEN length(text) > 12000 THEN 'very_long_chunk' END) AS reasons FROM x
""")
def suspicious_reasons(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    nomor, year = F.when(i % 6 == 0, "Unknown").otherwise(F.col("nomor")), F.when(i % 7 == 0, 0).otherwise(F.col("publication_year"))
    return chunks_view(spark, d).select("id", F.array_join(q.suspicious_reasons(F.col("text"), nomor, year, F.col("tentang"), F.col("pasal_id")), ",").alias("reasons"))


@query(f"WITH {CHUNKS} SELECT id, domain, kind FROM s")
def domain_predicate(spark: SparkSession, d: str) -> DataFrame:
    return chunks_view(spark, d).select("id", in_domain().alias("domain"), q.regulation_kind(F.col("regulation_type")).alias("kind"))


# ---------------------------------------------------------------- text


NOISY_SQL = "'- ' || doc_id % 50 || ' -' || chr(10) || 'PRESIDEN' || chr(10) || text || chr(10) || 'www.example.go.id' || chr(10) || chr(10) || chr(10) || 'SK NO 123 A' || chr(10) || 'akhir   baris'"


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split({NOISY_SQL}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) AS ls FROM documents),
k AS (SELECT doc_id, list_filter(ls, lambda x: x = '' OR NOT (regexp_full_match(x, '-\s*[0-9]+\s*-') OR regexp_full_match(upper(x), 'PRES\s*I?DEN|REPUBLIK\s+INDONESIA')
        OR regexp_matches(upper(x), '\bJDIH\b|WWW\.') OR regexp_full_match(upper(x), '(SK|SL|S1|SI)[(<]?\s*NO\s+[A-Z0-9\s./|''-]+'))) AS ls FROM l)
SELECT doc_id, sha256(trim(regexp_replace(array_to_string(ls, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_sha256, CAST(len(ls) AS BIGINT) AS n_lines FROM k
""")
def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("- "), (F.col("doc_id") % 50).cast("string"), F.lit(" -\nPRESIDEN\n"), F.col("text"), F.lit("\nwww.example.go.id\n\n\nSK NO 123 A\nakhir   baris"))
    docs = table(spark, d, "documents").select("doc_id", tx.without_noise_lines(noisy).alias("t"), F.regexp_count(noisy, F.lit("\n")).alias("_n"))
    return docs.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), (F.col("_n") + 1 - 4).cast("long").alias("n_lines"))


@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, sha256(t) AS folded_sha256, sha256(regexp_replace(t, '[^0-9a-z]+', '', 'g')) AS compact_sha256, regexp_replace(t, '[^0-9]', '', 'g') AS digits FROM f
""")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", digest(tx.folded(t)).alias("folded_sha256"), digest(tx.alnum_only(t)).alias("compact_sha256"), tx.digits_only(tx.folded(t)).alias("digits"))


@query(r"""
WITH w AS (SELECT doc_id, text, greatest(len(regexp_extract_all(text, '\S+')), 1) AS nw, len(regexp_extract_all(text, '\S+')) AS words,
       len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}_\s.,;:!?()\[\]{}''"/\-+%=<>@#&*]')) AS odd, len(regexp_extract_all(text, 'Â|â|\x{FFFD}|\\x[0-9a-fA-F]{2}')) AS moj,
       len(list_filter(regexp_extract_all(text, '\S+'), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 5 AND NOT regexp_matches(x, '[aeiouAEIOU]'))) AS nov
  FROM documents)
SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(odd AS BIGINT) AS odd, CAST(moj AS BIGINT) AS mojibake, CAST(nov AS BIGINT) AS without_vowel, CAST(greatest(1, floor(words * 1.35)) AS BIGINT) AS tokens FROM w
""")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", q.n_words(t).cast("long").alias("words"), q.n_odd(t).cast("long").alias("odd"), q.n_mojibake(t).cast("long").alias("mojibake"), q.n_without_vowel(t, 5).cast("long").alias("without_vowel"), q.token_estimate(t).cast("long").alias("tokens")
    )


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Pasal 1' || chr(10) || text END AS t FROM documents),
w AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '(?im)^\s*Pasal\s+(?:[0-9]+[A-Z]?|[IVXLCDM]+)\b')) AS pasal,
       round_even((len(regexp_extract_all(t, '[^\p{L}\p{N}\p{M}_\s.,;:!?()\[\]{}''"/\-+%=<>@#&*]')) + 3 * len(regexp_extract_all(t, 'Â|â|\x{FFFD}|\\x[0-9a-fA-F]{2}'))) / CAST(greatest(len(regexp_extract_all(t, '\S+')), 1) AS DOUBLE), 4) AS noise FROM t)
SELECT doc_id, CASE WHEN n < 300 THEN 'teks terlalu pendek (' || n || ' char)' WHEN pasal < 1 THEN 'Pasal terdeteksi kurang dari 1' WHEN noise > 0.18 THEN 'noise' ELSE 'ok' END AS verdict FROM w
""")
def usable_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Pasal 1\n"), "text"))
    verdict = q.usable(q.extraction_quality(t))
    return table(spark, d, "documents").select("doc_id", F.when(verdict.startswith("noise"), "noise").otherwise(verdict).alias("verdict"))


@query("""
SELECT doc_id, length(text) >= 80 AND (length(text) - length(replace(text, chr(10), ''))) / CAST(greatest(length(text), 1) AS DOUBLE) <= 0.35 AS native_ok FROM documents
""")
def native_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", q.native_text_ok(F.col("text")).alias("native_ok"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(0, CAST(greatest(ceil((len(ws) - 500) / 440.0), 0) AS BIGINT) + 1)) AS k FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(k + 1 AS INTEGER) AS part, md5(array_to_string(ws[k * 440 + 1:k * 440 + 500], ' ')) AS part_md5 FROM k
""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    parts = table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.posexplode(st.token_windows(F.col("w"))).alias("k", "t"))
    return parts.select("doc_id", (F.col("k") + 1).alias("part"), F.md5(F.col("t").cast("binary")).alias("part_md5"))


@query(r"""
WITH RECURSIVE src AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS ws FROM documents),
units AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda u: regexp_matches(u, '\S')) AS us FROM src WHERE len(ws) > 450),
sizes AS (SELECT doc_id, list_transform(us, lambda u: len(regexp_extract_all(u, '\S+'))) AS ns FROM units),
fold AS (
  SELECT doc_id, ns, 1 AS k, 0 AS seen, 0 AS size, 0 AS start, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS cuts FROM sizes
  UNION ALL
  SELECT doc_id, ns, k + 1, seen + n, CASE WHEN n > 450 THEN 0 WHEN size > 0 AND size + n > 450 THEN least(60, seen - start) + n ELSE size + n END,
         CASE WHEN n > 450 THEN seen + n WHEN size > 0 AND size + n > 450 THEN seen - least(60, seen - start) WHEN size = 0 THEN seen ELSE start END,
         CASE WHEN (n > 450 AND size > 0) OR (size > 0 AND size + n > 450) THEN [{'s': start, 'e': seen}] ELSE [] END
           || CASE WHEN n > 450 THEN list_transform(range(0, n, 390), lambda i: {'s': seen + i, 'e': seen + least(i + 450, n)}) ELSE [] END
  FROM (SELECT *, ns[k] AS n FROM fold WHERE k <= len(ns))),
ends AS (SELECT doc_id, k, unnest(cuts) AS c, generate_subscripts(cuts, 1) AS j FROM fold WHERE len(cuts) > 0
         UNION ALL SELECT doc_id, k + 1, {'s': start, 'e': seen}, 1 FROM fold WHERE k > len(ns) AND size > 0),
parts AS (SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY k, j) - 1 AS pos, array_to_string(ws[c.s + 1:c.e], ' ') AS part, c.e - c.s AS n FROM ends e JOIN src ON src.doc_id = e.doc_id
          UNION ALL SELECT doc_id, 0, array_to_string(ws, ' '), len(ws) FROM src WHERE len(ws) <= 450)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(part) AS part_md5, CAST(n AS INTEGER) AS n_words FROM parts
""")
def long_split(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(st.long_parts(F.col("text"))).alias("pos", "part"))
    return parts.select("doc_id", "pos", F.md5(tx.squeeze(F.col("part")).cast("binary")).alias("part_md5"), q.n_words(F.col("part")).alias("n_words"))


# ---------------------------------------------------------------- structure


@query("""
SELECT p.user_id, p.ts, p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON v.user_id = p.user_id AND v.ts <= p.ts
""")
def section_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return st.asof(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, by="user_id", on="ts", values=["view_id"], ties=("view_id",)).select("user_id", "ts", "event_id", "view_id")


def legal_text(i: Column, text: Column) -> Column:
    """A heading before every line: chapters, divisions, paragraphs and articles by the line's number."""
    heads = lambda n: F.when(n % 9 == 0, F.concat(F.lit("BAB "), (n + 1).cast("string"), F.lit("\nKETENTUAN UMUM\n"))).when(n % 9 == 3, "Bagian Kesatu\n\nRuang Lingkup\n").when(n % 9 == 6, "Paragraf 2\nBAB\n").otherwise("")
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, n: F.concat(heads(n), F.lit("Pasal "), (n + 1).cast("string"), F.lit("\n"), x)), "\n")


LEGAL_SQL = """
src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls[i] AS body, i - 1 AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src)),
sec AS (SELECT doc_id, n, body, n // 9 AS chapter, 'BAB ' || (n // 9 * 9 + 1) AS bab, CASE WHEN n % 9 >= 3 THEN 'Bagian Kesatu' ELSE '' END AS bagian, CASE WHEN n % 9 >= 6 THEN 'Paragraf 2' ELSE '' END AS paragraf FROM n)
"""


@query(f"WITH {LEGAL_SQL} SELECT doc_id, CAST(n + 1 AS BIGINT) AS article_no, 'Pasal ' || (n + 1) AS pasal_id, bab, 'Ketentuan Umum' AS bab_title, bagian, CASE WHEN bagian = '' THEN '' ELSE 'Ruang Lingkup' END AS bagian_title, paragraf FROM sec")
def section_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", legal_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = st.articles(st.section_context(st.numbered_lines(docs, "doc_id", "text")), ("bab", "bab_title", "bagian", "bagian_title", "paragraf"))
    return found.select(F.col("doc").alias("doc_id"), "article_no", "pasal_id", "bab", "bab_title", "bagian", "bagian_title", "paragraf")


@query(r"""
WITH src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, CAST(i AS BIGINT) AS article_no, 'Pasal ' || i AS pasal_id, trim(ls[i], ' ' || chr(9)) AS content FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src))
SELECT doc_id, article_no, pasal_id, md5(content) AS content_md5 FROM n
""")
def article_split(spark: SparkSession, d: str) -> DataFrame:
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, n: F.concat(F.lit("Pasal "), (n + 1).cast("string"), F.lit(" .\n"), x)), "\n")
    docs = table(spark, d, "documents").select("doc_id", marked.alias("text"))
    found = st.articles(st.numbered_lines(docs, "doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "article_no", "pasal_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(r"""
WITH src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, i, regexp_replace(regexp_replace(ls[i], '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content, 'PP_' || (doc_id % 90 + 1) || '_Tahun_2015.pdf' AS file FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src))
SELECT 'pdf/' || doc_id || '/' || file AS doc, sha1(file || '::Pasal ' || i) AS id, 'Pasal ' || i AS pasal_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_index,
       'Peraturan Pemerintah No. ' || (doc_id % 90 + 1) || ' Tahun 2015, Pasal ' || i AS citation_text, md5(content) AS text_md5, CASE WHEN (i - 1) % 9 >= 3 THEN 'Bagian Kesatu' ELSE '' END AS bagian
FROM n WHERE content <> ''
""")
def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.lit("pdf/"), i.cast("string"), F.lit("/PP_"), (i % 90 + 1).cast("string"), F.lit("_Tahun_2015.pdf"))
    docs = table(spark, d, "documents").select(path.alias("path"), legal_text(i, F.col("text")).alias("text"))
    found = st.chunk_documents(docs.withColumn("meta", md.regulation(F.col("path"), F.col("text"))))
    return found.select("doc", "id", F.col("metadata.pasal_id").alias("pasal_id"), F.col("metadata.chunk_index").alias("chunk_index"), "citation_text", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("metadata.bagian").alias("bagian"))


@query("""
WITH h AS (SELECT page_id, html || '<a href="/katalog/' || page_id % 9 || '">k</a><a href=''/peraturan/x?sort=1''>s</a><a href="/peraturan/' || page_id || '">p</a><a href="/katalog/' || page_id % 9 || '">k</a>' AS html FROM pages),
f AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda u: (contains(u, '/katalog/') OR contains(u, '/peraturan/')) AND NOT contains(u, 'sort=')) AS us FROM h)
SELECT page_id, array_to_string(list_filter(us, lambda u, i: list_position(us, u) = i), ' ') AS links FROM f
""".replace("\\\\", "\\"))
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    more = F.concat(F.col("html"), F.lit('<a href="/katalog/'), (i % 9).cast("string"), F.lit("\">k</a><a href='/peraturan/x?sort=1'>s</a><a href=\"/peraturan/"), i.cast("string"), F.lit('">p</a><a href="/katalog/'), (i % 9).cast("string"), F.lit('">k</a>'))
    return table(spark, d, "pages").select("page_id", F.array_join(st.links(more), " ").alias("links"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'https://example.org/files/' || page_id || '.pdf' END AS url, CASE WHEN page_id % 3 = 2 THEN NULL ELSE page_id || '.pdf' END AS filename FROM pages
""")
def pdf_link(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    embed = F.concat(F.lit('<embed class="a" type="application/pdf" src="/files/'), i, F.lit('.pdf">'))
    viewer = F.concat(F.lit('<div id="pdf-viewer" data-pdf-url="https://example.org/files/'), i, F.lit('.pdf"></div>'))
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", embed)).when(F.col("page_id") % 3 == 1, F.concat("html", viewer)).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", st.pdf_link(html, "https://example.org").alias("x")).select("page_id", "x.url", "x.filename")


# ---------------------------------------------------------------- metadata


@query("""
SELECT doc_id, CAST(doc_id % 90 + 1 AS VARCHAR) AS nomor, CAST(1995 + doc_id % 28 AS INTEGER) AS year FROM documents
""")
def filename_number_year(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n, y = (i % 90 + 1).cast("string"), (i % 28 + 1995).cast("string")
    name = F.when(i % 3 == 0, F.concat(F.lit("UU_Nomor_"), n, F.lit("_Tahun_"), y, F.lit(".pdf"))).when(i % 3 == 1, F.concat(F.lit("PP"), F.lpad(n, 3, "0"), y, F.lit(".pdf"))).otherwise(F.concat(F.lit("Perpres No "), n, F.lit(" Th "), y, F.lit(".pdf")))
    return table(spark, d, "documents").select("doc_id", md.number_and_year_of_filename(name).alias("x")).select("doc_id", "x.nomor", "x.year")


@query("""
SELECT doc_id, ['Undang-Undang', 'Peraturan Pemerintah', 'Peraturan Presiden', 'Peraturan Menteri Ketenagakerjaan', 'Keputusan Menteri'][doc_id % 5 + 1] AS regulation_type, CAST([1, 2, 3, 4, 5][doc_id % 5 + 1] AS INTEGER) AS regulation_hierarchy,
       CAST(doc_id % 60 + 1 AS VARCHAR) AS nomor, CAST(2000 + doc_id % 20 AS INTEGER) AS year, 'UPAH MINIMUM ' || doc_id AS tentang FROM documents
""")
def metadata_extract(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("UNDANG-UNDANG", "PERATURAN PEMERINTAH", "PERATURAN PRESIDEN", "PERATURAN MENTERI KETENAGAKERJAAN", "KEPUTUSAN MENTERI")]), (i % 5 + 1).cast("int"))
    head = F.concat(kind, F.lit(" REPUBLIK INDONESIA\nNOMOR "), (i % 60 + 1).cast("string"), F.lit(" TAHUN "), (i % 20 + 2000).cast("string"), F.lit("\nTENTANG\nUPAH MINIMUM "), i.cast("string"), F.lit("\nDENGAN RAHMAT TUHAN YANG MAHA ESA\nMenimbang: "), F.col("text"))
    x = md.regulation(F.concat(F.lit("pdf/"), i.cast("string"), F.lit(".pdf")), head)
    return table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.regulation_type", "x.regulation_hierarchy", "x.nomor", "x.year", "x.tentang")


@query("""
SELECT doc_id, ['undang-undang', 'peraturan pemerintah', 'peraturan presiden', 'peraturan menteri'][doc_id % 4 + 1] AS doc_type, ['UU', 'PP', 'PERPRES', 'PERMEN'][doc_id % 4 + 1] || '_Nomor_' || (doc_id % 70 + 1) || '_M_Tahun_2011.pdf' AS filename,
       CASE doc_id % 4 WHEN 3 THEN NULL ELSE ['data/pdf/undang-undang', 'data/pdf/peraturan-pemerintah', 'data/pdf/peraturan-presiden', ''][doc_id % 4 + 1] END AS folder FROM documents
""")
def rename_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Undang-Undang Republik\nIndonesia", "Peraturan  Pemerintah", "PERATURAN PRESIDEN", "Keputusan Menteri")]), (i % 4 + 1).cast("int"))
    page = F.concat(kind, F.lit(" Nomor "), (i % 70 + 1).cast("string"), F.lit("/M TAHUN 2011 "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", md.renamed(page).alias("x"), md.folder(tx.squeeze(page)).alias("folder")).select("doc_id", "x.doc_type", "x.filename", "folder")


@query("SELECT doc_id, doc_id % 3 = 0 AS excluded FROM documents")
def title_filter(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.when(F.col("doc_id") % 3 == 0, "Perubahan Kedua Undang-Undang ").otherwise("Undang-Undang "), F.col("source"))
    return table(spark, d, "documents").select("doc_id", q.title_excluded(title).alias("excluded"))


# ---------------------------------------------------------------- answers


@query("""
WITH a AS (
  SELECT doc_id AS query_id, 'Peraturan Pemerintah No. ' || doc_id % 50 || ' Tahun ' || (1990 + doc_id % 35) AS l1, 'UU Nomor ' || doc_id % 7 || ' Tahun 2003' AS l2, doc_id FROM documents),
j AS (SELECT query_id, 'Peraturan Pemerintah No. ' || doc_id % 50 || ' Tahun ' || (1990 + doc_id % 35) AS c1, CASE WHEN doc_id % 2 = 0 THEN 'UU No. ' || doc_id % 7 || ' Tahun 2003' END AS c2, doc_id % 4 <> 1 AS bad1, TRUE AS bad2, doc_id FROM a)
SELECT query_id, array_to_string(list_sort(list_filter([c1, c2], lambda x: x IS NOT NULL)), '; ') AS cited,
       array_to_string(list_sort(list_filter([CASE WHEN bad1 THEN c1 END, c2], lambda x: x IS NOT NULL)), '; ') AS invalid, NOT bad1 AND c2 IS NULL AS ok FROM j
""")
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    one = F.concat(F.lit("Menurut Peraturan Pemerintah No. "), (i % 50).cast("string"), F.lit(" Tahun "), (i % 35 + 1990).cast("string"), F.lit(", Pasal 2."))
    two = F.when(i % 2 == 0, F.concat(F.lit(" Lihat UU Nomor "), (i % 7).cast("string"), F.lit(" Tahun 2003."))).otherwise("")
    answers = table(spark, d, "documents").select(i.alias("query_id"), F.concat(one, two).alias("answer"))
    docs = chunks_view(spark, d).select(F.col("id").alias("query_id"), "regulation_type", "nomor", "publication_year")
    found = an.validated(answers, docs)
    return found.select("query_id", F.array_join("cited", "; ").alias("cited"), F.array_join("invalid", "; ").alias("invalid"), "ok")


@query("SELECT doc_id, array_to_string(list_filter([doc_id % 9 + 1, doc_id % 5 + 1], lambda x, i: x > 4 AND (i = 1 OR x <> doc_id % 9 + 1)).list_sort(), ',') AS unknown_codes FROM documents")
def bracket_check(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat(F.lit("Lihat [R"), (i % 9 + 1).cast("string"), F.lit("] dan [R"), (i % 5 + 1).cast("string"), F.lit("]."))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(an.bracket_errors(text, F.lit(4)), lambda x: x.cast("string")), ",").alias("unknown_codes"))


@query(rf"""
WITH t AS (SELECT doc_id, {SQUEEZE.format('text')} AS t FROM documents),
w AS (SELECT doc_id, t, {_terms_sql("array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+')[1:6], ' ')")} AS terms FROM t),
p AS (SELECT doc_id, t, terms, list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '(\([0-9]+\)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)) AS ss FROM w),
s AS (SELECT doc_id, terms, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM (SELECT doc_id, terms, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM p) WHERE length(sentence) >= 25),
h AS (SELECT doc_id, sentence, pos, len(list_filter(terms, lambda x: contains(lower(sentence), x))) AS hits FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS k FROM h WHERE hits > 0),
c AS (SELECT doc_id, string_agg('D' || doc_id || ' menyatakan bahwa ' || sentence, chr(10) || chr(10) ORDER BY k) AS a FROM o WHERE k <= 2 GROUP BY doc_id)
SELECT t.doc_id AS query_id, md5(coalesce(c.a, 'D' || t.doc_id || ' memuat ketentuan berikut: ' || t.t[1:900])) AS answer_md5 FROM t LEFT JOIN c ON c.doc_id = t.doc_id
""")
def extractive_fallback(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(F.slice(ix.tokens(F.col("text")), 1, 6), " ")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), words.alias("query"), F.lit(1).alias("rank"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("citation"), "text")
    return an.extractive(docs).select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query("""
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
w AS (SELECT *, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS past FROM u)
SELECT conv_id, turn, md5(right(trim(concat_ws(' ', past, text)), 1400)) AS query_md5 FROM w
""")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    return an.memory(table(spark, d, "conversations")).select("conv_id", "turn", F.md5(F.col("retrieval_query").cast("binary")).alias("query_md5"))


# ---------------------------------------------------------------- evaluation


@query(r"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
SELECT doc_id, round(CASE WHEN n < 25 THEN n / 25.0 WHEN n <= 220 THEN 1.0 ELSE greatest(0.3, 1.0 - (n - 220) / 300.0) END, 6) AS score FROM w
""")
def length_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", r6(m.length_score(F.col("text"))).alias("score"))


@query(rf"""
WITH k AS (SELECT doc_id, {SQUEEZE.format('lower(text)')} AS a, [' The ', 'Der die', 'de la', 'zz-9', 'nan', ''] AS ks FROM documents),
t AS (SELECT doc_id, a, regexp_replace(a, '[^0-9a-z]+', '', 'g') AS ac, regexp_replace(a, '[^0-9]', '', 'g') AS ad, list_transform(list_filter(ks, lambda x: trim(x) <> '' AND lower(trim(x)) <> 'nan'), lambda x: trim(x)) AS ks FROM k),
h AS (SELECT doc_id, ks, list_filter(ks, lambda x: contains(a, lower(x)) OR contains(ac, regexp_replace(lower(x), '[^0-9a-z]+', '', 'g')) OR (regexp_replace(x, '[^0-9]', '', 'g') <> '' AND contains(ad, regexp_replace(x, '[^0-9]', '', 'g')))) AS hs FROM t)
SELECT doc_id, array_to_string(hs, '; ') AS hits, round(len(hs) / CAST(len(ks) AS DOUBLE), 6) AS coverage FROM h
""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    keywords = F.lit(" The ;Der die;de la;zz-9;nan;")
    hits = m.keyword_hits(F.col("text"), keywords)
    return table(spark, d, "documents").select("doc_id", F.array_join(hits, "; ").alias("hits"), r6(m.share(hits, m.targets(keywords))).alias("coverage"))


@query("""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN 999 ELSE o_orderkey % 5 + 1 END AS INTEGER) AS rank, round(CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE 1.0 / (o_orderkey % 5 + 1) END, 6) AS rr,
       round(CASE WHEN o_orderkey % 5 < 3 THEN 1 / 3.0 ELSE 0 END, 6) AS precision_at_3 FROM orders
""")
def target_ranks(spark: SparkSession, d: str) -> DataFrame:
    """References of which one names the expected law, in its long form, at a known rank."""
    at = (F.col("o_orderkey") % 5).cast("int")
    ref = lambda i: F.struct((i + 1).alias("rank"), F.when((i == at) & (at < 4), "Peraturan Pemerintah No. 35 Tahun 2021, Pasal 2").otherwise("Keputusan lain").alias("reference"), F.lit("a.pdf").alias("source_file"), F.lit("").alias("pasal_id"), F.lit("").alias("text_preview"))
    refs, wanted = F.transform(F.sequence(F.lit(0), F.lit(7)), ref), F.array(F.lit("PP 35/2021"))
    found = table(spark, d, "orders").select("o_orderkey", m.target_hits(refs, wanted).alias("hits"))
    ranked = found.select("o_orderkey", m.first_rank(F.col("hits")).alias("rank"), r6(m.hits_at(F.col("hits"), 3)).alias("precision_at_3"))
    return ranked.select("o_orderkey", "rank", r6(m.reciprocal_rank(F.col("rank"))).alias("rr"), "precision_at_3")


SCORED = "SELECT o_orderkey AS id, o_orderpriority AS topic, (o_totalprice % 1000) / 1000.0 AS overall_score, CAST(o_custkey AS DOUBLE) AS other FROM orders"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), (F.col("o_totalprice") % 1000 / 1000.0).alias("overall_score"), F.col("o_custkey").cast("double").alias("other"))


@query(f"""
WITH s AS ({SCORED}), u AS (SELECT 'overall_score' AS metric, overall_score AS v FROM s UNION ALL SELECT 'other', other FROM s)
SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_samp(v), 6) AS std FROM u GROUP BY metric
""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    out = ev.summary(scored(spark, d), ("overall_score", "other"), spread=True)
    return out.select("metric", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "min", "max", "std")])


@query(f"WITH s AS ({SCORED}) SELECT topic, count(id) AS question_count, round(avg(overall_score), 6) AS overall_score, round(avg(other), 6) AS other FROM s GROUP BY topic")
def by_topic(spark: SparkSession, d: str) -> DataFrame:
    out = ev.by_group(scored(spark, d), "topic", ("overall_score", "other"))
    return out.select("topic", "question_count", r6(F.col("overall_score")).alias("overall_score"), r6(F.col("other")).alias("other"))


@query(f"WITH s AS ({SCORED}) SELECT id, round(overall_score, 6) AS overall_score FROM s ORDER BY s.overall_score, id LIMIT 5")
def failure_review(spark: SparkSession, d: str) -> DataFrame:
    return ev.worst(scored(spark, d)).select("id", r6(F.col("overall_score")).alias("overall_score"))


@query(f"""
WITH s AS ({SCORED}), l AS (SELECT CASE WHEN overall_score <= 0.5 THEN 'poor' WHEN overall_score <= 0.7 THEN 'fair' WHEN overall_score <= 0.85 THEN 'good' ELSE 'excellent' END AS label FROM s),
n(label, place) AS (VALUES ('poor', 0), ('fair', 1), ('good', 2), ('excellent', 3))
SELECT n.label, n.place, count(l.label) AS n FROM n LEFT JOIN l ON l.label = n.label GROUP BY n.label, n.place
""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.label_counts(scored(spark, d).withColumn("quality_label", m.quality_label(F.col("overall_score"))))


@query(f"WITH s AS ({SCORED}) SELECT CAST(least(floor(overall_score * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ALL")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ev.histogram(scored(spark, d), "overall_score")


@query(f"""
WITH s AS ({SCORED}), a AS (SELECT id, id % 11 / 10.0 AS s1 FROM s WHERE id % 4 <> 0 AND id % 11 <= 10), b AS (SELECT id, id % 9 / 10.0 AS s2 FROM s WHERE id % 6 <> 0),
j AS (SELECT s.id, s.overall_score, a.s1, b.s2 FROM s LEFT JOIN a ON a.id = s.id LEFT JOIN b ON b.id = s.id),
k AS (SELECT *, CASE WHEN s1 IS NULL AND s2 IS NULL THEN NULL ELSE (coalesce(s1, 0) + coalesce(s2, 0)) / (CAST(s1 IS NOT NULL AS INTEGER) + CAST(s2 IS NOT NULL AS INTEGER)) END AS m FROM j)
SELECT id, round(m, 6) AS judge_mean, round(least(s1, s2), 6) AS judge_min, round(greatest(s1, s2), 6) AS judge_max, round(coalesce(greatest(s1, s2) - least(s1, s2), 0), 6) AS judge_disagreement,
       s1 IS NULL OR s2 IS NULL AS judge_missing, round(m - overall_score, 6) AS judge_gap, round(0.5 * coalesce(m, overall_score) + 0.5 * overall_score, 6) AS blended_score FROM k
""")
def judge_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("_key", F.col("id")).withColumn("id", F.concat(F.lit("q "), F.col("id").cast("string")))
    judge = lambda n, skip: rows.where(F.col("_key") % skip != 0).select(F.concat(F.lit("No. "), F.col("_key").cast("string")).alias("id"), (F.col("_key") % n).cast("string").alias("score_raw"))
    out = ev.with_judges(rows, {"first": judge(11, 4), "second": judge(9, 6)})
    return out.select(F.col("_key").alias("id"), *[r6(F.col(c)).alias(c) for c in ("judge_mean", "judge_min", "judge_max", "judge_disagreement")], "judge_missing", r6(F.col("judge_gap")).alias("judge_gap"), r6(F.col("blended_score")).alias("blended_score"))


@query("SELECT lang, min(source) AS common_source FROM (SELECT lang, source, count(*) AS n, max(count(*)) OVER (PARTITION BY lang) AS top FROM documents GROUP BY lang, source) WHERE n = top GROUP BY lang")
def common_source(spark: SparkSession, d: str) -> DataFrame:
    return ev.most_frequent(table(spark, d, "documents"), "lang", "source").withColumnRenamed("source", "common_source")


@query("SELECT e.vec_id AS id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e JOIN embeddings o ON o.vec_id = e.vec_id + 1")
def semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("_other"))
    return rows.join(other, "id").select("id", r6(m.dot(F.col("embedding"), F.col("_other"))).alias("similarity"))
