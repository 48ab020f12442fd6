"""Structure, finalisation, ranking, answers and evaluation on small frames."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import metadata as md
from docmill.operators import answer as an
from docmill.operators import evaluate as ev
from docmill.operators import finalize as fin
from docmill.operators import index as ix
from docmill.operators import retrieval as rt
from docmill.operators import structure as st

LAW = """kop
BAB I
KETENTUAN UMUM
Bagian Kesatu

Umum
Paragraf 1
Ruang
Pasal 1
isi satu
lanjut
Bagian Kedua
Lain
Pasal 1 2
isi dua
BAB II
PENUTUP
Pasal 3
isi tiga
"""


def test_sections_and_articles(spark):
    docs = spark.createDataFrame([("a", LAW)], "path string, text string")
    found = st.articles(st.section_context(st.numbered_lines(docs, "path", "text")), ("bab", "bagian", "paragraf", "bab_title"))
    rows = [(r.pasal_id, r.bab, r.bagian, r.paragraf, r.bab_title) for r in found.orderBy("article_no").collect()]
    # a new division keeps the stale paragraph; a new chapter clears both
    assert rows == [("Pasal 1", "BAB I", "Bagian Kesatu", "Paragraf 1", "Ketentuan Umum"), ("Pasal 12", "BAB I", "Bagian Kedua", "Paragraf 1", "Ketentuan Umum"), ("Pasal 3", "BAB II", "", "", "Penutup")]


def test_dictum_and_whole_documents(spark):
    docs = spark.createDataFrame([("a", "MENETAPKAN\nKESATU : isi\nKEDUA BELAS: lagi"), ("b", "hanya teks"), ("c", "")], "path string, text string")
    rows = {(r.doc, r.pasal_id, r.content) for r in st.articles(st.numbered_lines(docs, "path", "text")).collect()}
    assert rows == {("a", "Kesatu", "isi"), ("a", "Kedua Belas", "lagi"), ("b", "Isi Dokumen", "hanya teks")}


def test_chunks(spark):
    docs = spark.createDataFrame([("pdf/PP_Nomor_35_Tahun_2021.pdf", LAW)], "path string, text string")
    rows = st.chunk_documents(docs.withColumn("meta", md.regulation(F.col("path"), F.col("text")))).orderBy("metadata.chunk_index").collect()
    assert [r.metadata.pasal_id for r in rows] == ["Pasal 1", "Pasal 12", "Pasal 3"]
    assert rows[0].text == "isi satu lanjut" and rows[0].citation_text == "Peraturan Pemerintah No. 35 Tahun 2021, Pasal 1"
    assert rows[0].display_text.split("\n")[1] == "BAB I - Ketentuan Umum"


def test_long_split_equals_a_plain_reading(spark):
    """A part is filled unit by unit and leads the next with its last words; a unit beyond a part is windows of its own."""
    rng = random.Random(1)
    texts = ["a b", "a  b", "", " ", None] + [" ".join(rng.choice(["kata", "akhir.", "butir;", "x", "x", "b\nc"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += ["x " * 100, "a. " + "y " * 95 + "z. w"]

    def plain(text, most=40, overlap=6):
        if text is None:
            return None
        if len(text.split()) <= most:
            return [text]
        out, now = [], []
        for unit in filter(None, map(str.strip, re.split(r"(?<=[.;:])\s+|\n+", text))):
            n = unit.split()
            if len(n) > most:
                out += [" ".join(now)] if now else []
                out += [" ".join(n[i : i + most]) for i in range(0, len(n), most - overlap)]
                now = []
                continue
            if now and sum(len(x.split()) for x in now) + len(n) > most:
                out.append(" ".join(now))
                now = [" ".join(out[-1].split()[-overlap:])]
            now.append(unit)
        return out + ([" ".join(now)] if now else [])

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", st.long_parts(F.col("t"), 40, 6).alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_asof_and_referenced(spark):
    left = spark.createDataFrame([("u", 5, "x"), ("u", 1, "y")], "k string, t int, v string")
    right = spark.createDataFrame([("u", 2, 10), ("u", 5, 11)], "k string, t int, w int")
    assert {(r.v, r.w) for r in st.asof(left, right, by="k", on="t", values=["w"]).collect()} == {("x", 11), ("y", None)}
    got = spark.createDataFrame([("Pasal 5, pasal 7a dan Pasal 5",)], "t string").select(st.referenced_articles(F.col("t"))).first()[0]
    assert got == ["Pasal 5", "Pasal 7a"]


def test_clauses(spark):
    rows = spark.createDataFrame([("d", 1, "Pasal 1", "(1) pendek\n(2) " + "panjang sekali. " * 120)], "doc string, article_no long, pasal_id string, content string")
    out = st.clauses(rows).orderBy("clause_no").collect()
    assert out[0].clause.startswith("(1) pendek (2)") and all(len(r.clause) <= 1500 for r in out) and len(out) == 2


def test_finalize(spark):
    meta = "struct<source_file:string,pasal_id:string,chunk_kind:string,chunk_index:int,regulation_type:string,regulation_hierarchy:int,nomor:string,tentang:string,year:int,publication_year:int,active_status:string,extraction_noise_ratio:double,extraction_ocr_artifact_count:int,bab:string,bab_title:string,bagian:string,bagian_title:string,paragraf:string,paragraf_title:string>"
    row = lambda i, text, noise: (f"id{i}", text, ("PP_Nomor_35_Tahun_2021.pdf", f"Pasal {i}", "pasal", i, "Peraturan Pemerintah", 2, "Unknown", "X", 0, 0, "Berlaku", noise, 0, "BAB I", "Umum", "", "", "", ""), i)
    chunks = spark.createDataFrame([row(1, "isi pendek", 0.0), row(2, "kata lain. " * 400, 0.5), row(3, "", 0.0)], f"id string, text string, metadata {meta}, ord long")
    sources = fin.repaired_metadata(chunks, spark.createDataFrame([], "stem string, text string"))
    out = fin.finalize(chunks, sources).orderBy("ord", "metadata.part_index").collect()
    assert out[0].metadata.nomor == "35" and out[0].metadata.year == 2021 and out[0].metadata.quality_status == "ok"
    assert [r.metadata.part_index for r in out[1:]] == [1, 2] and out[1].citation_text.endswith("Pasal 2 bagian 1") and out[1].metadata.quality_status == "needs_review"
    assert len({r.id for r in out}) == len(out)
    assert fin.report(chunks, fin.finalize(chunks, sources)).first()["output_chunks"] == 3


def test_corrections(spark):
    chunks = spark.createDataFrame([("a", "naik 12 olo"), ("b", "baik"), ("c", "tahun 2o14")], "id string, text string").withColumn("metadata", F.struct(F.lit("ok").alias("quality_status")))
    cache = chunks.where("id = 'a'").select(fin.cache_key(F.col("id"), F.col("text"), provider="p", model="m").alias("cache_key"), F.lit("naik 12%").alias("corrected_text"))
    rows = {r.id: (r.text, r.llm_typo_corrected, r.missing) for r in fin.corrected(chunks, cache, provider="p", model="m").collect()}
    assert rows == {"a": ("naik 12%", True, False), "b": ("baik", False, False), "c": ("tahun 2o14", False, True)}
    assert fin.corrected(chunks, cache, provider="p", model="other").where("llm_typo_corrected").count() == 0
    left = fin.corrected(chunks, cache, provider="p", model="m")
    made = fin.corrections(left, lambda texts: [t.upper() for t in texts], provider="p", model="m").collect()
    assert [(r.chunk_id, r.corrected_text, r.error) for r in made] == [("c", "TAHUN 2O14", None)]
    failed = fin.corrections(left, lambda texts: 1 / 0, provider="p", model="m").first()
    assert failed.corrected_text is None and "zero" in failed.error


def test_rrf_is_symmetric_and_dedupe_is_unique(spark):
    a = spark.createDataFrame([("q", i, i) for i in range(1, 6)], "query_id string, id int, rank int").withColumn("s1", F.lit(1.0))
    b = spark.createDataFrame([("q", 7 - i, i) for i in range(1, 6)], "query_id string, id int, rank int").withColumn("s2", F.lit(1.0))
    x = {r.id: round(r.rrf_score, 12) for r in rt.fuse((a, "s1", 1.0), (b, "s2", 0.7)).collect()}
    y = {r.id: round(r.rrf_score, 12) for r in rt.fuse((b, "s2", 0.7), (a, "s1", 1.0)).collect()}
    assert x == y
    hits = spark.createDataFrame([("q", i, float(i % 3), i, f"s{i % 2}", "p", "k", 0) for i in range(20)], "query_id string, id int, final_score double, ord int, source_file string, pasal_id string, chunk_kind string, chunk_index int")
    for n in (1, 7):
        assert [r.id for r in rt.dedupe_top(hits.repartition(n), 5).orderBy("rank").collect()] == [2, 5]


def test_relevance_falls_back_to_first(spark):
    docs = spark.createDataFrame([("q", "apakah pkwt", 1, "tidak ada", 0.1), ("q", "apakah pkwt", 2, "lain", 0.2)], "query_id string, query string, rank int, text string, final_score double")
    rows = rt.relevant(docs, 3, haystack=F.col("text"), narrow=F.col("text")).collect()
    assert [(r.rank, r.context_relevance_score) for r in rows] == [(1, None)]


def test_merges_differ(spark):
    hits = spark.createDataFrame([("q", 1, 1, 3, 0.2), ("q", 1, 2, 1, 0.9)], "query_id string, id int, variant int, rank int, final_score double")
    assert rt.merge_candidates(hits, "best").first().variant == 2 and rt.merge_candidates(hits, "first").first().variant == 1


def test_answers(spark):
    docs = spark.createDataFrame([("q1", "apakah upah naik", 1, "PP No. 1 Tahun 2020, Pasal 1", "Kalimat pertama tanpa isi sama sekali. Besaran upah naik setiap tahun sesuai aturan.", "Peraturan Pemerintah", "1", 2020)], "query_id string, query string, rank int, citation string, text string, regulation_type string, nomor string, publication_year int")
    questions = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    bad = spark.createDataFrame([("q1", "Menurut UU No. 9 Tahun 1999.")], "query_id string, answer string")
    rows = {r.query_id: (r.source, r.answer) for r in an.answered(questions, bad, docs).collect()}
    assert rows["q1"][0] == "extractive" and "Besaran upah" in rows["q1"][1] and rows["q2"][0] == "none"
    good = spark.createDataFrame([("q1", "Menurut PP No. 1 Tahun 2020, upah naik.")], "query_id string, answer string")
    assert an.answered(questions, good, docs).where("query_id = 'q1'").first().source == "generated"
    assert an.cited_documents(good, docs).count() == 1


def test_memory(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(14)], "conv_id long, turn long, role string, text string")
    rows = {r.turn: r for r in an.memory(turns).collect()}
    assert rows[0].retrieval_query == "t0" and rows[12].retrieval_query == "t4 t6 t8 t10 t12"
    assert rows[2].remembered == "Turn 1 - Pengguna: t0\nTurn 1 - Asisten: t1"


def test_evaluation(spark):
    refs = '[{"rank": 1, "reference": "Lain"}, {"rank": 2, "reference": "Peraturan Pemerintah No. 35 Tahun 2021, Pasal 2", "pasal_id": "Pasal 2"}]'
    row = ("Q01", "PHK", "q", "e", "PP 35/2021, Pasal 2", "PP 35/2021", "Pasal 2", "upah;lembur", "Upah menurut Pasal 2. " + "kata " * 30, refs, "Peraturan Pemerintah No. 35 Tahun 2021, Pasal 2", 0.5, 0.5, 1.0)
    names = "id topic question expected_answer expected_citations expected_law_numbers expected_articles expected_keywords answer retrieved_references_json retrieved_references_text semantic_similarity llm_judge_score latency_seconds".split()
    out = ev.measured(spark.createDataFrame([row, (*row[:9], "rusak", *row[10:])], names)).collect()
    assert (out[0].expected_article_rank, out[0].expected_law_rank, out[0].article_mrr, out[0].precision_at_3, out[0].keyword_coverage, out[0].keyword_missing) == (2, 2, 0.5, 0.5, 0.5, "lembur")
    assert out[1].expected_article_rank == 999 and out[1].precision_at_3 == 0.0
    assert out[0].quality_label in {"fair", "good"}


def test_index_is_rebuilt_on_change(spark, tmp_path):
    from docmill.sources import writers

    rows = spark.createDataFrame([("a", "satu dua"), ("b", "dua dua")], "id string, text string")
    path = str(tmp_path / "index")
    assert writers.index(spark, rows, path) and not writers.index(spark, rows, path)
    assert writers.index(spark, rows.withColumn("text", F.upper("text")), path)
    assert {(r.id, r.term, r.tf) for r in spark.read.parquet(f"{path}/postings").collect()} == {("a", "satu", 1), ("a", "dua", 1), ("b", "dua", 2)}


def test_embed_hook(spark):
    rows = spark.createDataFrame([("a", "x")], "id string, text string")
    assert ix.embed(rows, lambda texts: [[3.0, 4.0] for _ in texts]).first().embedding == [0.6000000238418579, 0.800000011920929]


def test_cross_references_with_guard(spark):
    primary = spark.createDataFrame([("q", 1, "r", "s", "Pasal 1", ["Pasal 2", "Pasal 3", "Pasal 1"]), ("q", 2, "other", "o", "Pasal 2", [])], "query_id string, rank int, reg string, source_file string, pasal_id string, refs array<string>")
    chunks = spark.createDataFrame([("r", f"Pasal {i}", "s", f"id{i}-{n}", 10 * i + n) for i in (1, 2, 3) for n in (0, 1)], "reg string, pasal_id string, source_file string, id string, ord int")
    ids = lambda guard: [r.id for r in rt.cross_references(primary, chunks, F.col("refs"), limit=5, topic_guard=guard).orderBy("xref_rank").collect()]
    assert ids(True) == ["id2-0"] and ids(False) == ["id2-0", "id3-0"]


@pytest.mark.parametrize("rows", [3, 7, 8192])
def test_dense_in_blocks_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(rt, "BATCH_ROWS", rows)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(120, 6))
    points[7] = points[8] = points[99]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    kept = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    vectors = spark.createDataFrame([*kept, (500, None), (501, [1.0])], "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in kept[:50]] + [("none", None)], "query_id string, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.id for r in rt.dense(queries, vectors, 4).collect()}
    exact = np.float32(points).astype(float)
    wanted = {}
    for i in range(50):
        order = sorted(range(120), key=lambda j: (round(1 - float(exact[i] @ exact[j]), 9), j))
        wanted |= {(f"q{i}", k + 1): order[k] for k in range(4)}
    assert got == wanted
    assert rt.dense(queries.limit(0), vectors, 4).count() == 0 and rt.dense(queries, vectors.limit(0), 4).count() == 0


def test_links_are_resolved_against_their_page(spark):
    from urllib.parse import urljoin

    pages = ["https://a.org", "https://a.org/", "https://a.org/x/y.html", "https://a.org/x/y/?q=1#f"]
    found = ["/f/1.pdf", "f.pdf", "../f.pdf", "./g/../f.pdf", "//b.org/z.pdf", "HTTP://c.org/k.pdf", "?d=2", "#top", "../../..//f.pdf", "a/./b/", "a/.."]
    rows = spark.createDataFrame([(p, f) for p in pages for f in found], "p string, f string")
    got = {(r.p, r.f): r.u for r in rows.select("p", "f", st.absolute(F.col("f"), F.col("p")).alias("u")).collect()}
    wanted = {(p, f): urljoin(p, f) for p in pages for f in found}
    assert {k: v for k, v in got.items() if v != wanted[k]} == {}
    html = ['<div data-pdf-url="x.pdf" class="k" id="pdf-viewer">', "<DIV ID='pdf-viewer' data-pdf-url='x.pdf'>", '<embed src="x.pdf?a=1" type="application/pdf">', "<p>"]
    docs = spark.createDataFrame([(h,) for h in html], "h string").select(st.pdf_link(F.col("h"), "https://a.org/d/").alias("x")).select("x.*").collect()
    assert [(r.url, r.filename) for r in docs] == [("https://a.org/d/x.pdf", "x.pdf")] * 2 + [("https://a.org/d/x.pdf?a=1", "x.pdf"), (None, "")] or docs[3].url is None


def test_corrections_by_rule_and_in_batches(spark):
    law = F.struct(*[F.lit(v).alias(k) for k, v in (("regulation_type", "PP"), ("nomor", "1"), ("year", 2020), ("publication_year", 2020), ("pasal_id", "Pasal 1"), ("bab", ""), ("bab_title", ""), ("bagian", ""), ("bagian_title", ""), ("paragraf", ""), ("paragraf_title", ""))])
    rows = spark.createDataFrame([(1, "KNRJA tetap"), (2, "baik")], "i int, text string").select("i", "text", *[F.lit("old").alias(c) for c in ("display_text", "embedding_text", "citation_text")], law.alias("metadata"))
    out = {r.i: r for r in fin.deterministic(rows).collect()}
    assert (out[1].text, out[1].display_text, out[1].citation_text) == ("KERJA tetap", "PP No. 1 Tahun 2020\nPasal 1\nKERJA tetap", "PP No. 1 Tahun 2020, Pasal 1")
    assert (out[2].deterministic_typo_corrected, out[2].display_text) == (False, "old")
    pages = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "i int, text string").coalesce(1)
    ask = lambda texts: "broken" if "t3" in texts else str([t.upper() for t in texts]).replace("'", '"')
    got = {r.i: r.corrected_text for r in fin.batch_corrections(pages, ask).collect()}
    assert got == {i: (f"T{i}" if i not in (3, 4, 5) else f"t{i}") for i in range(7)}


def test_failures_are_routed_with_a_reason(spark):
    docs = spark.createDataFrame([("a", "Pasal 1\n" + "kata baik " * 60), ("b", ""), ("c", "pendek"), ("d", None)], "source_file string, text string")
    good, bad = fin.routed(docs)
    assert [r.source_file for r in good.collect()] == ["a"] and good.columns == docs.columns
    assert {(r.source_file, r.status, r.moved_to) for r in bad.collect()} == {("b", "no_text", "failed/no_text/b"), ("c", "low_quality", "failed/low_quality/c"), ("d", "no_text", "failed/no_text/d")}


def test_modes_compared_and_search_words(spark):
    rows = lambda v: spark.createDataFrame([(i, v * i) for i in range(3)], "id int, score double")
    got = {(r["mode"], r["difference"]) for r in ev.compared({"vanilla": rows(1.0), "proposed": rows(2.0)}, "vanilla", ("score",)).collect()}
    assert got == {("vanilla", 0.0), ("proposed", 1.0)}
    asked = spark.createDataFrame([("q1", "apa itu upah"), ("q2", "x")], "query_id string, query string")
    assert [r.search for r in an.search_words(asked).orderBy("query_id").collect()] == ["apa itu upah", "x"]
    made = an.search_words(asked, lambda texts: ["upah" if "upah" in t else " " for t in texts]).orderBy("query_id").collect()
    assert [r.search for r in made] == ["upah", "x"]


def test_medians_are_exact(spark):
    rng = random.Random(6)
    rows = [(f"m{k}", v) for k, n in enumerate((1, 2, 3, 5000, 4999)) for v in (rng.choice([rng.random(), 0.5, 0.25]) for _ in range(n))] + [("m1", None), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = {r.m: r.median for r in ev.medians(spark.createDataFrame(rows, "m string, v double").repartition(5), "m", "v").collect()}
    wanted = {m: float(np.median([v for k, v in rows if k == m and v is not None])) for m, _ in rows if m != "none"}
    assert got == wanted


def test_bm25_search_is_bm25_top_of_bm25(spark):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 5))) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    asked = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "w0 w3"), ("c", "nothing"), ("d", "W5")], "query_id string, query string")
    stats = ix.term_stats(ix.document_frequencies(docs), docs.count())
    wanted = rt.bm25_top(rt.bm25(asked, ix.postings(docs), ix.doc_lengths(docs), stats), 10)
    shown = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["bm25_score"], 9)) for r in df.collect())
    assert shown(rt.bm25_search(asked, docs, 10)) == shown(wanted)


def test_a_task_gives_k_neighbours_a_query_however_many_batches(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = rt._nearest(vectors.where("id < 2").withColumnRenamed("id", "query_id"), vectors, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = [(q, i) for q in (0, 1) for i in [i for _, i in sorted((1 - sum(x * y for x, y in zip(rows[q][1], v, strict=True)), i) for i, v in rows)][:4]]
    assert sorted((r["query_id"], r["id"]) for r in found) == sorted(wanted)


def test_hybrid_rounds_scores_for_ties_alone(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0.5)], "query_id int, id int, rank int, dense_distance double")
    meta = F.struct(F.lit("Berlaku").alias("active_status"), F.lit(2001).alias("publication_year"), F.lit(2001).alias("year"), F.lit(1).alias("regulation_hierarchy"), F.lit("ok").alias("quality_status"))
    chunks = spark.createDataFrame([(1, "f", "p", "k", 0)], "id int, source_file string, pasal_id string, chunk_kind string, chunk_index int")
    score = rt.hybrid(hits, chunks, 1, kind="plain", meta=meta, sparse=hits.select("query_id", "id", "rank", F.lit(1.0).alias("bm25_score"))).first()["final_score"]
    assert score == 1 / 61 + 0.7 / 61 + 0.03 + 0.001 + 0.015
