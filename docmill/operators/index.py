"""Lexical and vector indexes as plain tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def query_tokens(text: Column) -> Column:
    """The wider tokenizer of some query sides: also underscores, accented runs and other words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)([a-zA-Z0-9_]+|[À-ɏḀ-ỿ]+|\w+)"), F.lit(1))


#: Terms up to which a batch of questions is broadcast to the texts.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """id, term, tf; of `terms` (term) alone where given, so that nothing else is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    if terms is not None:
        asked = terms.select("term").distinct()
        rows = rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """term, df: terms are counted once a text where it lies, so partial sums are all that is shuffled."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, dl of all documents (those without terms have 0): a projection, no shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.regexp_count(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+")).cast("long").alias("dl"))


def term_stats(frequencies: DataFrame, n_docs: int, *, epsilon: float = rules.BM25_EPSILON, floor: bool = True) -> DataFrame:
    """term, df, idf; negative idf is replaced by epsilon times the mean idf, or kept with floor=False."""
    stats = frequencies.select("term", "df").withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    if not floor:
        return stats.select("term", "df", F.col("raw").alias("idf"))
    mean = stats.agg(F.avg("raw")).first()[0] or 0.0
    return stats.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * mean)).otherwise(F.col("raw")).alias("idf"))


def asked_idf(frequencies: DataFrame, terms: list[str], n_docs: int, *, epsilon: float = rules.BM25_EPSILON) -> dict[str, float]:
    """idf of those of the asked `terms` that occur, as `term_stats` has it: the texts are read once for it and the mean."""
    asked = frequencies.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    raw = (F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    rows = frequencies.select("term", raw).join(F.broadcast(asked.withColumn("_asked", F.lit(True))), "term", "left")
    found, mean = rows.agg(F.collect_list(F.when(F.col("_asked"), F.struct("term", "raw"))), F.avg("raw")).first()
    return {r["term"]: r["raw"] if r["raw"] >= 0 else epsilon * mean for r in found}


def embed(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], *, text_col: str = "text", prefix: str = "passage: ", out: str = "embedding") -> DataFrame:
    """Unit vectors of texts by any encoder of string lists; batches come in Arrow's size."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        vectors = encoder([prefix + (t or "") for t in column])
        return pd.Series([[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in vectors])

    return texts.withColumn(out, run(text_col))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))


def stale(current: DataFrame, stored: DataFrame, *, text_col: str = "text") -> bool:
    """Whether a stored index differs from the chunks: by count, then by an order-free content hash."""
    digest = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", text_col))).first()
    return tuple(digest(current)) != tuple(digest(stored))
