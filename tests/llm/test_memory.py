"""What workers hold: they outlive their tasks, so it stands beside the heap in all later stages."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark import SparkContext

from docmill.llm import near_dup, packing, textkit, toxicity

tok = pytest.importorskip("public_tokenizers")
JSON, RANKS = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken")


def test_workers_give_memory_back(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    runs, given = [], []
    kind = type(docs)
    before = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, *rest: (runs.append(run), before(df, run, *rest))[1])
    monkeypatch.setattr(textkit, "give_back", lambda: given.append(1), raising=False)
    bags = near_dup.bags_of(docs.selectExpr("doc_id as node", "array(doc_id) as buckets", "text"), 5)
    entries = docs.selectExpr("doc_id as bucket", "doc_id as node", "1L as size")
    near_dup.verified(docs.selectExpr("doc_id as a", "doc_id as b"), bags, 0.8)
    near_dup.led(entries, bags, 0.8, 10)
    near_dup.crossed(entries, docs.selectExpr("doc_id as node", "doc_id as label"), bags, 0.8, 10)
    near_dup.signed(docs, "text")
    packing.pack_documents(docs, JSON, RANKS)
    assert len(runs) == 6
    for n, run in enumerate(runs):
        list(run(iter([])))
        assert len(given) == n + 1


def test_rare_languages_need_no_python_rdd(spark, monkeypatch):
    docs = spark.range(1000).selectExpr("id as doc_id", "'de' as lang")
    known = spark.range(1000).selectExpr("id as _id", "cast(id % 2 as int) as _label")

    def refuse(*_, **__):
        raise AssertionError("rows of a Python RDD take workers of their own")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    rows = toxicity.reserved_of_langs(docs, known, "doc_id", "lang", {0: 0.01, 1: 0.01}, 200)
    assert rows is not None and 200 < rows.count() < 300 and {r._lang for r in rows.collect()} == {"de"}


def test_encoding_memory_follows_the_slice():
    encoder = packing.PieceEncoder(JSON, RANKS)
    texts = [" ".join(f"{chr(97 + (k * j) % 26)}b{'cdefg'[j % 5]}" for j in range(2500)) for k in range(400)]
    batch = pa.array(texts)
    list(encoder.encode(batch.slice(0, 1)))
    tracemalloc.start()
    for _ in encoder.encode(batch):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20, most >> 20
    few = [b for _, b in encoder.encode(batch.slice(397))]
    assert few == [b for _, b in encoder.encode(batch)][397:]
