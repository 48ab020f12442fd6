"""Sinks: published tables, indexes, failures, caches and evaluation exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.index import doc_lengths, document_frequencies, postings, stale, term_stats


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of any store."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def chunks(rows: DataFrame, path: str, *, as_json: bool = False) -> None:
    (rows.write.mode("overwrite").json if as_json else rows.write.mode("overwrite").parquet)(path)


def json_array(rows: DataFrame, path: str, *, order: str = "ord") -> None:
    """The rows as one JSON array in order: a folder with a single file, streamed through one task for readers that want one."""
    first = rows.agg(F.min(order)).first()[0]
    one = F.to_json(F.struct(*[c for c in rows.columns if c != order]))
    lines = rows.select(F.lit(1).alias("_part"), F.col(order).alias("_at"), F.concat(F.when(F.col(order) == first, "").otherwise(","), one).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "_part int, value string").withColumn("_at", F.lit(None).cast(rows.schema[order].dataType))
    lines.unionByName(ends).orderBy("_part", "_at").select("value").coalesce(1).write.mode("overwrite").text(path)


def upsert(rows: DataFrame, path: str, key: str, *, buckets: int = 64) -> None:
    """Adds rows and replaces those of the same key. The table is laid out by a hash of the key, and only touched buckets are written again.

    What a bucket will hold is staged first, so a run that is cut short can be repeated; so can a finished one.
    """
    spark = rows.sparkSession
    mine = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if not exists(spark, path):
        mine.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # `buckets` values at most
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    old.join(mine.select(key).distinct(), key, "left_anti").select(*mine.columns).unionByName(mine).write.parquet(staged)
    spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    remove(spark, staged)


def promote(spark: SparkSession, corrected: str, base: str, backup: str) -> bool:
    """Puts a corrected table in the place of the base one, after a backup that is made once; False where there is none."""
    if not exists(spark, corrected):
        return False
    if not exists(spark, backup):
        spark.read.parquet(base).write.parquet(backup)
    spark.read.parquet(corrected).write.mode("overwrite").parquet(base)
    return True


def failures(rows: DataFrame, path: str) -> None:
    """Appends; moving the files is left to whoever owns them."""
    rows.write.mode("append").json(path)


def raw_texts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("source_file").parquet(path)


def corrections(rows: DataFrame, path: str) -> None:
    rows.select("cache_key", "chunk_id", "corrected_text").write.mode("append").json(path)


def index(spark: SparkSession, rows: DataFrame, path: str, *, id_col: str = "id", text_col: str = "text", force: bool = False) -> bool:
    """postings, doc_len, term_stats under `path`, unless the stored ones fit the rows; True if written."""
    from .readers import index_or_empty

    stored = index_or_empty(spark, f"{path}/source", f"id string, {text_col} string")
    own = rows.select(F.col(id_col).cast("string").alias("id"), text_col)
    if not force and not stale(own, stored, text_col=text_col):
        return False
    own.write.mode("overwrite").parquet(f"{path}/source")
    own = spark.read.parquet(f"{path}/source")
    postings(own, text_col=text_col).write.mode("overwrite").parquet(f"{path}/postings")
    lengths = doc_lengths(own, text_col=text_col)
    lengths.write.mode("overwrite").parquet(f"{path}/doc_len")
    term_stats(document_frequencies(own, text_col=text_col), lengths.count()).write.mode("overwrite").parquet(f"{path}/term_stats")
    return True


def vectors(rows: DataFrame, path: str) -> None:
    """Adds or replaces vectors by id."""
    upsert(rows.select("id", "embedding"), path, "id")


def evaluation(rows: DataFrame, path: str) -> None:
    """evaluation_table, summary, by_topic, failure_review as CSV folders, and a report of a few lines."""
    table = rows.drop("keyword_hits_array")
    for name, part in {
        "evaluation_table": table,
        "summary": evaluate.summary(rows),
        "by_topic": evaluate.by_group(rows, "topic", ("overall_score", "keyword_coverage", "retrieval_citation_coverage", "latency_seconds")),
        "failure_review": evaluate.worst(rows),
    }.items():
        part.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{path}/{name}")
    lines = [f"# {r['metric']}: mean {r['mean']:.3f}, median {r['median']:.3f}" for r in evaluate.summary(rows).orderBy("metric").collect()]
    rows.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
