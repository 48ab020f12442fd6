"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before has written, and all but the last return the
columns of documents:

1. toxicity: documents over their language's threshold go.
2. line_dedup: recurring lines go, but for one document (and its copies) each; no document goes.
3. near_dup: one document of each near-duplicate class stays.
4. decontaminate: documents of which benchmark windows make up a twentieth or more go.
5. packing: what stays is packed into sequences (one row per piece).

SQL can express neither a trained network nor the packer, so there is no ORACLE_SQL;
tests/llm/test_planted.py holds each stage against a brute-force reading of planted rows (toxicity up to a few
errors, as its network is trained), and test_llm.py its operator against brute force.

Edge cases, in every stage: a null text counts as empty and stays null until packing, where it is
its end id alone; null ids are documents like others; repeated rows are alike, and near_dup keeps one
of them; an empty table gives an empty table of the same columns; further columns of any name, also one
that an operator uses for its own results, pass through all stages but packing unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from docmill.llm.textkit import fresh_name, shared_dir, table
from docmill.sources.writers import remove


def apart(docs: DataFrame, *names: str) -> DataFrame:
    """The same columns in order, those that an operator would replace under other names."""
    taken = {n.lower() for n in names}
    return docs.toDF(*[fresh_name(docs, f"{c}_") if c.lower() in taken else c for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, flag = fresh_name(docs, "score"), fresh_name(docs, "toxic")
    scored = toxicity.score(docs, model, out=score, out_flag=flag)
    return scored.where(~F.col(flag)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # copies stay alike, so that the next stage still takes them for copies
    safe = apart(docs, "n_lines", "n_dropped")
    kept = line_dedup.drop_recurring_lines(safe, keep_first=True, keep_copies=True)
    return kept.select(*[(F.length("text").cast("long") if c == "n_chars" else F.col(f"`{s}`")).alias(c) for c, s in zip(docs.columns, safe.columns, strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = apart(docs, *[f.name for f in decontaminate.RESULT])
    marked = decontaminate.mark_occurrences(safe, table(spark, sf_dir, "benchmark"))
    return marked.where(~decontaminate.contaminated()).select(*[F.col(f"`{s}`").alias(c) for c, s in zip(docs.columns, safe.columns, strict=True)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again.

    A stage's table goes once the next one's is written; the last, which the result is made from, stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        written = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            remove(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
