"""Readers, writers and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from docmill.sources import readers, writers
from docmill.streaming import incremental


def test_chunk_json_and_duplicate_ids(spark, tmp_path):
    row = {"id": "x", "text": "t", "display_text": "d", "embedding_text": "d", "citation_text": "c", "metadata": {"source_file": "s", "pasal_id": "Pasal 1", "year": 2020}}
    (tmp_path / "chunks.json").write_text(json.dumps([row, row], indent=2))
    rows = readers.chunks(spark, str(tmp_path / "chunks.json")).orderBy("ord").collect()
    assert rows[0].id == "x" and rows[1].original_id == "x" and rows[1].id != "x" and rows[0].metadata.year == 2020


def test_corrections_last_wins(spark, tmp_path):
    lines = ['{"cache_key": "a", "chunk_id": "1", "corrected_text": "old"}', "", "broken", '{"cache_key": "a", "chunk_id": "1", "corrected_text": "new"}']
    (tmp_path / "cache.jsonl").write_text("\n".join(lines))
    assert [(r.cache_key, r.corrected_text) for r in readers.correction_cache(spark, str(tmp_path / "cache.jsonl")).collect()] == [("a", "new")]


def test_ground_truth_csv(spark, tmp_path):
    head = "id,topic,difficulty,question,expected_answer,expected_citations,expected_law_numbers,expected_articles,expected_keywords"
    (tmp_path / "gt.csv").write_text("﻿" + head + '\nQ01,PHK,easy,"a, b","x ""y""",c,l,p,k\n', encoding="utf-8")
    r = readers.ground_truth(spark, str(tmp_path / "gt.csv")).first()
    assert (r.id, r.question, r.expected_answer) == ("Q01", "a, b", 'x "y"')


def test_judge_columns(spark, tmp_path):
    (tmp_path / "j.csv").write_text("Nomor Pertanyaan,Nilai,Alasan ketat\n1,8,baik\n")
    r = readers.judges(spark, str(tmp_path / "j.csv")).first()
    assert (r.id, r.score_raw, r.reason) == ("1", "8", "baik")


def test_documents_and_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.PDF").write_bytes(b"two\fpages")
    (tmp_path / "in/a.pdf").write_bytes(b"\xff")
    (tmp_path / "in/c.txt").write_text("teks")
    files = readers.documents(spark, str(tmp_path))
    assert files.count() == 2 and readers.documents(spark, str(tmp_path), limit=1).first().path.endswith("a.pdf")
    pages = readers.extracted_pages(files, lambda b: b.decode("ascii").split("\f"), "plain").orderBy("page_number").collect()
    assert [(p.page_number, p.text) for p in pages] == [(1, "two"), (2, "pages")]
    assert readers.raw_texts(spark, str(tmp_path / "in")).first().stem == "c"


def test_nested_ocr(spark):
    rows = spark.createDataFrame([(1, '{"res": [{"rec_texts": ["a", " "], "rec_scores": [0.9]}, [["b", 0.5]], {"text": "c"}]}'), (2, "broken"), (3, None)], "doc_id long, result string")
    assert [(r.text, r.score) for r in readers.flatten_ocr(rows).orderBy("place").collect()] == [("a", 0.9), ("b", 0.5), ("c", None)]


def test_missing_index_is_empty(spark, tmp_path):
    assert readers.index_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0


def test_pagination():
    assert list(readers.paginated(lambda p: ["x"] if p < 3 else [], 9)) == [(1, "x"), (2, "x")]


def test_streamed_memory(spark, tmp_path):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(12)], "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    run = incremental.remembered(stream).writeStream.format("memory").queryName("remembered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {r.turn: r.retrieval_query for r in spark.table("remembered").collect()}
    assert got[0] == "t0" and got[10] == "t2 t4 t6 t8 t10"


def test_ingest_replaces_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "source_file string, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    start = lambda: incremental.ingest_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    start().awaitTermination()
    rows.where("source_file = 'a'").withColumn("v", F.lit(2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start().awaitTermination()
    assert {(r.source_file, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_upsert_by_id(spark, tmp_path):
    rows = lambda ids, v: spark.createDataFrame([(i, [float(v)]) for i in ids], "id long, embedding array<float>")
    path = str(tmp_path / "vectors")
    writers.vectors(rows(range(200), 1), path)
    for _ in range(2):  # again gives the same
        writers.vectors(rows([5, 199, 300], 2), path)
        got = {r.id: r.embedding[0] for r in spark.read.parquet(path).collect()}
        assert got == {**dict.fromkeys(range(200), 1.0), 5: 2.0, 199: 2.0, 300: 2.0}
    assert [p.name for p in tmp_path.iterdir()] == ["vectors"]


def test_promote_backs_up_once(spark, tmp_path):
    base, corrected, backup = (str(tmp_path / n) for n in ("base", "corrected", "backup"))
    write = lambda v, path: spark.createDataFrame([(v,)], "v int").write.mode("overwrite").parquet(path)
    read = lambda path: spark.read.parquet(path).first().v
    write(1, base)
    assert not writers.promote(spark, corrected, base, backup)
    write(2, corrected)
    assert writers.promote(spark, corrected, base, backup) and (read(base), read(backup)) == (2, 1)
    write(3, corrected)
    assert writers.promote(spark, corrected, base, backup) and (read(base), read(backup)) == (3, 1)


def test_json_array_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t\n{i}") for i in range(50)], "ord long, text string").repartition(7)
    writers.json_array(rows, str(tmp_path / "a"))
    part = next((tmp_path / "a").glob("part-*"))
    assert json.loads(part.read_text()) == [{"text": f"t\n{i}"} for i in range(50)]
    writers.json_array(rows.limit(0), str(tmp_path / "b"))
    assert json.loads(next((tmp_path / "b").glob("part-*")).read_text()) == []


def test_order_over_several_files(spark, tmp_path):
    for n, v in (("a", "old"), ("b", "new")):
        pad = "x" * (5000 if n == "a" else 10)  # Spark would take the larger file first
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"cache_key": "k", "chunk_id": pad, "corrected_text": v}))
        row = {"id": f"{n}1", "text": pad}
        (tmp_path / f"{n}.json").write_text(json.dumps([row, {"id": f"{n}2", "text": "y"}]))
    assert readers.correction_cache(spark, str(tmp_path / "*.jsonl")).first().corrected_text == "new"
    assert [r.id for r in readers.chunks(spark, str(tmp_path / "*.json"), repair_ids=False).orderBy("ord").collect()] == ["a1", "a2", "b1", "b2"]


def test_judge_workbook(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [[0, 1, "lain"], ["Q1", "8.5", "-"], ["", "", ""]]
    sheet = "".join(f'<row r="{i}">' + "".join(cell(f"{'ABC'[k]}{i}", v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "j.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Nomor Pertanyaan</t></si><si><r><t>Ni</t></r><r><t>lai</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    assert [tuple(r) for r in readers.judges(spark, str(tmp_path / "j.xlsx"), "xlsx").collect()] == [("Q1", "8.5", None)]


def test_readings_of_a_page(spark):
    flat = spark.createDataFrame([(1, 1, "b", 0.5), (1, 0, "a", 1.0)], "doc_id int, place int, text string, score double")
    assert tuple(readers.ocr_pages(flat).first()) == (1, "a\nb", 0.75)
    read = spark.createDataFrame([(1, 1, 6, "kata 12 ~~"), (1, 1, 4, "kata dua"), (1, 2, 6, "x y"), (1, 2, 4, "x y")], "doc_id int, page_number int, mode int, text string")
    assert {(r.page_number, r["mode"]) for r in readers.best_reading(read).collect()} == {(1, 4), (2, 4)}
    pages = spark.createDataFrame([("a", 1, " short "), ("b", 1, "y" * 60), ("c", 1, None)], "doc_id string, page_number int, text string")
    got = readers.first_page_text(pages, spark.createDataFrame([("a", "long " * 20), ("b", "no")], "doc_id string, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {"a": ("long " * 20).strip(), "b": "y" * 60, "c": ""}
    assert readers.random_row(pages, 3).count() == 1 and readers.random_row(pages.limit(0), 3).count() == 0
    assert readers.page_links(spark, lambda p: ["x"] if p < 3 else [], 9).count() == 2
