"""Scans: files, tables and pages as DataFrames."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.finalize import last_writes, repair_duplicate_ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, in a session whose Python workers find this package where it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    own = spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(x for x in (own.get("PYTHONPATH"), root) if x)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *, recursive: bool = True, pattern: str = "*.[pP][dD][fF]", start: int = 0, limit: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of the folder's files, in order of path where a start or limit asks for one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    files = files.orderBy("path").offset(start) if start else files
    return files if limit is None else files.orderBy("path").limit(limit)


def extracted_pages(files: DataFrame, extract: Callable[[bytes], list[str]], extractor: str) -> DataFrame:
    """PAGES rows of any extractor (bytes -> page texts); a file that it fails on gives no pages. The score is left to functions.quality."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = extract(content)
                except Exception:  # noqa: BLE001  an unreadable file is routed as a failure by the caller
                    continue
                rows += [(path, i, t, extractor) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "extractor"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_number int, text string, extractor string")


def flatten_ocr(raw: DataFrame, *, json_col: str = "result") -> DataFrame:
    """doc_id, place, text, score from nested OCR results of any shape (dicts with rec_texts / text, or [text, score] pairs)."""

    def found(node) -> Iterator[tuple[str, float | None]]:
        if isinstance(node, dict):
            texts, scores = node.get("rec_texts"), node.get("rec_scores") or []
            if isinstance(texts, list):
                yield from ((str(t), float(scores[i]) if i < len(scores) else None) for i, t in enumerate(texts) if str(t).strip())
                return
            if isinstance(node.get("text"), str) and node["text"].strip():
                yield node["text"], node.get("score")
                return
            for v in node.values():
                yield from found(v)
        elif isinstance(node, list):
            if len(node) == 2 and isinstance(node[0], str) and isinstance(node[1], (int, float)):
                yield node[0], float(node[1])
            else:
                for v in node:
                    yield from found(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf[json_col], strict=True):
                try:
                    node = json.loads(text)
                except (TypeError, ValueError):
                    continue
                rows += [(doc, i, t, s) for i, (t, s) in enumerate(found(node))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "text", "score"])

    kind = raw.schema["doc_id"].dataType.simpleString()
    return raw.select("doc_id", json_col).mapInPandas(run, f"doc_id {kind}, place int, text string, score double")


def ocr_pages(flat: DataFrame) -> DataFrame:
    """doc_id, text, score: the pieces of flatten_ocr in order, a line each, and their mean score."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return flat.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"), F.avg("score").alias("score"))


def latin_words(text: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)), lambda w: w.rlike("[A-Za-z]")))


def best_reading(readings: DataFrame) -> DataFrame:
    """doc_id, page_number, mode, text: of several readings of a page the one with the most words that hold a Latin letter, the first mode of equals."""
    by = F.struct(latin_words(F.col("text")), -F.col("mode"))
    return readings.groupBy("doc_id", "page_number").agg(F.max_by(F.struct("mode", "text"), by).alias("_best")).select("doc_id", "page_number", "_best.*")


def first_page_text(pages: DataFrame, read: DataFrame, *, least: int = 50) -> DataFrame:
    """doc_id, text: the first page's own text, or its reading (`read`: doc_id, text) where that has fewer than `least` characters."""
    own = pages.where("page_number = 1").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("_own"))
    joined = own.join(read.select("doc_id", F.trim("text").alias("_read")), "doc_id", "left")
    return joined.select("doc_id", F.when(F.length("_own") >= least, F.col("_own")).otherwise(F.coalesce("_read", "_own")).alias("text"))


def file_order() -> Column:
    """Sortable place of a row among all files: Spark packs and splits files by size, so the row number alone is no order."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def chunks(spark: SparkSession, path: str, *, repair_ids: bool = True) -> DataFrame:
    """CHUNKS of JSON array files, with `ord` as the order of files by name and within the file."""
    rows = spark.read.schema(schemas.CHUNKS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    names = spark.createDataFrame([(name, i) for i, name in enumerate(sorted(rows.inputFiles()))], "_file string, _nth long")
    in_file = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # a file is read by one task, in order
    placed = rows.withColumn("_file", F.regexp_replace(F.col("_metadata.file_path"), "^([a-z]+):/+", "$1:/")).withColumn("_in", in_file)
    names = names.withColumn("_file", F.regexp_replace("_file", "^([a-z]+):/+", "$1:/"))
    rows = placed.join(names, "_file").withColumn("ord", F.shiftleft("_nth", 33) + F.col("_in")).drop("_file", "_nth", "_in")
    return repair_duplicate_ids(rows) if repair_ids else rows


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, text of the folder's .txt files."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder).withColumn("path", F.col("_metadata.file_path"))
    return rows.select(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.txt$", "").alias("stem"), F.col("value").alias("text"))


def correction_cache(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, corrected_text: the last line of each key; blank and malformed lines are skipped."""
    lines = spark.read.text(path).withColumn("line_no", file_order()).where(F.trim("value") != "")
    rows = lines.select("line_no", F.from_json("value", schemas.CORRECTIONS).alias("r")).select("line_no", "r.*").where("cache_key is not null")
    return last_writes(rows, "cache_key", "corrected_text", "line_no")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation set: quoted commas, a byte-order mark before the first header, columns by name."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    missing = [f.name for f in schemas.GROUND_TRUTH if f.name not in rows.columns and f.name != "difficulty"]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return rows


JUDGE_COLUMNS = {"ID": "id", "Nomor Pertanyaan": "id", "Nilai": "score_raw", "score": "score_raw", "Alasan ketat": "reason", "Alasan Kuat": "reason"}


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet by the names in its first row."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{ns['m']}}}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(book.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    table = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells = {}
        for at, c in enumerate(row.findall("m:c", ns)):
            column = "".join(x for x in c.get("r", "") if x.isalpha()) or str(at)
            value = c.findtext("m:v", None, ns)
            cells[column] = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
        table.append(cells)
    head = table[0] if table else {}
    return [{str(head[c]).strip(): v for c, v in r.items() if head.get(c)} for r in table[1:] if any(v not in (None, "") for v in r.values())]


def workbook(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of workbooks (.xlsx), as text; what a sheet lacks is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[r.get(c) for c in columns] for content in pdf["content"] for r in sheet_rows(content)]
            yield pd.DataFrame(rows, columns=columns, dtype="object")

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def judges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """id, score_raw, reason of a judge's table (csv, xlsx or any format Spark reads) under any of its column names."""
    if fmt == "xlsx":
        rows = workbook(spark, path, list(JUDGE_COLUMNS))
        of = lambda name: F.coalesce(*[F.col(f"`{old}`") for old, new in JUDGE_COLUMNS.items() if new == name])
        return rows.select(*[of(c).alias(c) for c in ("id", "score_raw", "reason")])
    rows = spark.read.option("header", True).format(fmt).load(path)
    for old, new in JUDGE_COLUMNS.items():
        rows = rows.withColumnRenamed(old, new) if old in rows.columns and new not in rows.columns else rows
    for c in ("id", "score_raw", "reason"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select("id", "score_raw", "reason")


def index_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An index table, or no rows where it was never built: search then is dense only."""
    from .writers import exists

    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def paginated(fetch: Callable[[int], list[str]], last: int) -> Iterator[tuple[int, str]]:
    """(page, link) of pages 1..last until a request fails or a page has no links."""
    for page in range(1, last + 1):
        try:
            links = fetch(page)
        except OSError:
            return
        if not links:
            return
        yield from ((page, x) for x in links)


def page_links(spark: SparkSession, fetch: Callable[[int], list[str]], last: int) -> DataFrame:
    """page, link of a paginated catalogue. Pages end by their content, so they are asked for one after another."""
    return spark.createDataFrame(list(paginated(fetch, last)), "page int, link string")


def random_row(rows: DataFrame, seed: int) -> DataFrame:
    """One row at random: a least random number with partial results, no sort."""
    drawn = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.rand(seed).alias("_at"))
    one = drawn.agg(F.min_by("_row", "_at").alias("_row"))
    return one.where("_row is not null").select("_row.*")
