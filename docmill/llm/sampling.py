"""Bounded, reproducible samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder` (null ids do not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, label: the largest label of each id; null ids and labels are left out."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    return own.where(F.col("_id").isNotNull() & F.col("_label").isNotNull()).groupBy("_id").agg(F.max("_label").alias("_label"))


def lowest_hashes(rows: DataFrame, id_col: str, most: int, seed: int = 42) -> DataFrame:
    """`most` rows at most, those with the lowest hash of their id: a uniform sample that does not depend on partitions."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(most)


def rows_of(docs: DataFrame, picked: DataFrame, id_col: str) -> DataFrame:
    """Rows of `docs` whose id is picked, with what `picked` has of them; `picked` is a bounded sample and is broadcast."""
    return docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id"), "inner").drop("_id")
