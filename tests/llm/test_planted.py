"""Each stage of the pipeline on planted rows against what a brute-force reading gives, and the queries that have no SQL."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(21)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, item = make(25), make(20)
    texts = [make(40) + (" moron" if i % 4 == 0 else "") for i in range(240)]
    for i in (1, 2, 3):
        texts[i] = f"{make(12)}\n{shared}\n{make(12)}"
    texts[6] = texts[5]
    texts[9] = f"{make(10)} {item} {make(10)}"
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1 - int(i % 4 == 0), int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("a", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, shared


def after(spark, planted, name):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    return STAGES[name](spark, docs, planted[0])


def test_stages_do_what_brute_force_does(spark, planted):
    _, texts, shared = planted
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stay = ids(after(spark, planted, "toxicity"))
    assert sum((i in stay) == ("moron" not in t) for i, t in enumerate(texts)) >= 0.95 * len(texts)
    lines = {r.doc_id: (r.text, r.n_chars) for r in after(spark, planted, "line_dedup").collect()}
    wanted = [t.replace(shared + "\n", "") if i in (2, 3) else t for i, t in enumerate(texts)]
    assert lines == {i: (t, len(t)) for i, t in enumerate(wanted)}
    assert set(range(240)) - ids(after(spark, planted, "near_dup")) in ({5}, {6})
    assert ids(after(spark, planted, "decontaminate")) == set(range(240)) - {9}
    assert ids(after(spark, planted, "packing")) == set(range(240))


@pytest.mark.parametrize("name", ["op1_quality", "op2_license_scan", "op4_packing", "op6_near_dup", "op8_toxicity", "op9_substrings", "op10_line_dedup"])
def test_queries_give_every_document(spark, planted, name):
    from docmill.llm import queries

    rows = queries.QUERIES[name](spark, planted[0]).collect()
    assert {r.doc_id for r in rows} == set(range(240)) and (name == "op4_packing" or len(rows) == 240)
    if name == "op6_near_dup":
        by = {r.doc_id: r.class_id for r in rows}
        assert by[5] == by[6] and len(set(by.values())) == 239
    if name == "op10_line_dedup":
        assert {r.doc_id for r in rows if r.n_dropped} == {1, 2, 3}
    if name == "op8_toxicity":
        assert sum(bool(r.predicted) == (r.doc_id % 4 == 0) for r in rows) >= 0.9 * len(rows)


ODD = [(None, "same words here", "en", "s", 1), (None, "same words here", "en", "s", 1), (500, None, None, None, None), (501, "", "xx", "s", 0), (501, "", "xx", "s", 0)]
NAMES = ["score", "_score", "_toxic", "toxic", "n_lines", "n_dropped", "n_words", "hit_from", "hit_to", "items", "_key", "_first", "key", "first", "whole", "text_key", "lost", "_dropped", "class_id", "sketch"]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_with_odd_rows_and_clashing_names(spark, planted, name):
    from pyspark.sql import functions as F

    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").union(spark.createDataFrame(ODD, KIND))
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])
    out = STAGES[name](spark, wide, folder)
    if name == "packing":
        assert out.where("doc_id is null and start = 0").count() == 2 and out.where("doc_id = 500").first().doc_tokens == 1
    else:
        assert out.columns == wide.columns
        plain = sorted(map(tuple, STAGES[name](spark, docs, folder).collect()), key=repr)
        assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == plain
        assert all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for r in out.collect() for n in NAMES)
        odd = [r.doc_id for r in out.where("doc_id is null or doc_id >= 500").collect()]
        assert sorted(odd, key=str) == ([500, None] if name == "near_dup" else [500, 501, 501, None, None])
    assert STAGES[name](spark, wide.limit(0), folder).count() == 0


def test_near_dup_stage_equals_brute_force(spark, planted):
    from test_llm import classes_of

    _, texts, _ = planted
    stay = sorted(r.doc_id for r in after(spark, planted, "near_dup").collect())
    assert stay == sorted(set(classes_of(texts)))


def test_run_applies_the_stages_in_order(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    for name in list(STAGES)[:-1]:
        docs = STAGES[name](spark, docs, planted[0])
    pieces = STAGES["packing"](spark, docs, planted[0])
    cols = ["doc_id", "ids_crc32", "doc_tokens"]
    whole = lambda df: {(r.doc_id, r.doc_tokens) for r in df.select(*cols).collect()}
    assert whole(corpus_pipeline.run(spark, planted[0])) == whole(pieces)
