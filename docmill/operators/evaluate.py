"""The evaluation suite: per-question measures, summaries, reports and judge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import rules
from ..schemas import REFERENCES


def measured(rows: DataFrame) -> DataFrame:
    """Ground truth with answers and references -> one row a question with all measures.

    In: GROUND_TRUTH columns, answer, retrieved_references_json, retrieved_references_text, semantic_similarity,
    llm_judge_score, latency_seconds.
    """
    empty = F.array().cast(REFERENCES)
    out = rows.withColumn("_refs", F.coalesce(F.from_json("retrieved_references_json", REFERENCES), empty))
    articles, laws = m.targets(F.col("expected_articles")), m.targets(F.col("expected_law_numbers"))
    cites = m.targets(F.col("expected_citations"))
    keywords, answer = m.targets(F.col("expected_keywords")), F.coalesce("answer", F.lit(""))
    out = out.withColumn("_found", m.target_hits(F.col("_refs"), articles, laws))
    out = out.withColumns(
        {
            "_hits": m.keyword_hits(answer, F.col("expected_keywords")),
            "expected_article_rank": m.first_rank(F.col("_found"), 0),
            "expected_law_rank": m.first_rank(F.col("_found"), 1),
            "retrieval_citation_coverage": m.target_coverage(F.coalesce("retrieved_references_text", F.lit("")), cites),
            "precision_at_3": m.hits_at(F.col("_found"), 3, which=(0, 1)),
            "answer_citation_hit": m.contains_any(answer, F.concat(cites, articles, laws)).cast("int"),
            "answer_word_count": F.regexp_count(answer, F.lit(r"(?U)\S+")),
            "answer_length_score": m.length_score(F.col("answer")),
        }
    )
    out = out.withColumns(
        {
            "keyword_hits": F.array_join("_hits", "; "),
            "keyword_missing": F.array_join(F.filter(keywords, lambda k: ~F.array_contains("_hits", k)), "; "),
            "keyword_coverage": m.share(F.col("_hits"), keywords),
            "retrieval_citation_hit": (F.col("retrieval_citation_coverage") > 0).cast("int"),
            "retrieval_article_hit": (F.col("expected_article_rank") < m.NO_RANK).cast("int"),
            "retrieval_law_hit": (F.col("expected_law_rank") < m.NO_RANK).cast("int"),
            "article_hit_at_3": (F.col("expected_article_rank") <= 3).cast("int"),
            "article_hit_at_8": (F.col("expected_article_rank") <= 8).cast("int"),
            "article_mrr": m.reciprocal_rank(F.col("expected_article_rank")),
            "law_mrr": m.reciprocal_rank(F.col("expected_law_rank")),
        }
    )
    out = out.withColumn("overall_score", m.overall_score())
    return out.withColumn("quality_label", m.quality_label(F.col("overall_score"))).drop("_refs", "_found", "_hits")


METRICS = (*rules.SCORE_WEIGHTS, "article_hit_at_8", "law_mrr", "overall_score", "latency_seconds", "answer_word_count")


def summary(rows: DataFrame, names: tuple[str, ...] = METRICS, *, spread: bool = False) -> DataFrame:
    """metric, mean, median, min, max (and std): one row a measure."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*")
    aggs = [F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")]
    plain = long.groupBy("metric").agg(*aggs, *([F.stddev_samp("v").alias("std")] if spread else []))
    return plain.join(medians(long, "metric", "v"), "metric", "left").select("metric", "mean", "median", "min", "max", *(["std"] if spread else []))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`by`, median: exact, and no group's values meet in one task.

    Approximate quantiles just below and above the middle bracket it; values below the bracket are counted, and
    only the distinct values inside, some five hundredth of the group, are put in order. `by` has few values.
    """
    known = rows.where(F.col(value).isNotNull())
    bracket = known.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, [0.499, 0.501], 10_000).alias("_q"))
    inside = known.join(bracket, by).withColumn("_at", F.when(F.col(value) < F.col("_q")[0], None).otherwise(F.col(value))).where(F.col(value) <= F.col("_q")[1])
    counted = inside.groupBy(by, "_at", "_n").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(by).orderBy(F.col("_at").asc_nulls_first())
    placed = counted.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c") + 1)
    holds = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank <= F.col("_to")), F.col("_at")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return placed.groupBy(by).agg(((holds(low) + holds(high)) / 2).alias("median"))


def by_group(rows: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Count and means of each group; the null group stays."""
    return rows.groupBy(key).agg(F.count("id").alias("question_count"), *[F.avg(n).alias(n) for n in names])


def worst(rows: DataFrame, n: int = 5, *, score: str = "overall_score", best: bool = False) -> DataFrame:
    return rows.orderBy(F.desc(score) if best else F.asc(score), "id").limit(n)


def label_counts(rows: DataFrame, label: str = "quality_label") -> DataFrame:
    """Counts of the four labels, 0 where there are none."""
    names = [name for _, _, name in rules.QUALITY_BINS]
    one = rows.agg(*[F.coalesce(F.sum(F.when(F.col(label) == n, 1).otherwise(0)), F.lit(0)).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("place"), F.col(n).alias("n")) for i, n in enumerate(names)])).alias("x")).select("x.*")


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (1..bins), n over equal bins of [0, 1], the last closed."""
    b = F.least(F.width_bucket(F.col(value), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).cast("int")
    return rows.where(F.col(value).between(0, 1)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`by`, `value`: the commonest value of each group, the smallest of equals."""
    return rows.groupBy(by).agg(F.mode(value, deterministic=True).alias(value))


def compared(modes: dict[str, DataFrame], base: str, names: tuple[str, ...]) -> DataFrame:
    """metric, mode, mean, difference from the base mode: the same questions answered in several modes."""
    means = reduce(DataFrame.unionByName, [summary(rows, names).select(F.lit(mode).alias("mode"), "metric", "mean") for mode, rows in modes.items()])
    own = means.where(F.col("mode") == base).select("metric", F.col("mean").alias("_base"))
    return means.join(own, "metric").select("metric", "mode", "mean", (F.col("mean") - F.col("_base")).alias("difference"))


def question_id(raw: Column) -> Column:
    """Qnn from any text with digits, else the text in upper case."""
    digits = F.regexp_extract(raw, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("Q"), F.lpad(digits.try_cast("int").cast("string"), F.greatest(F.length(digits.try_cast("int").cast("string")), F.lit(2)), "0"))).otherwise(F.upper(F.trim(raw)))


def judge_columns(scores: list[str]) -> dict[str, Column]:
    """Mean, least, greatest and spread of several judges, whoever is missing."""
    cols = [F.col(c).cast("double") for c in scores]
    known = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return {
        "judge_mean": F.when(known > 0, total / known),
        "judge_min": F.least(*cols),
        "judge_max": F.greatest(*cols),
        "judge_disagreement": F.coalesce(F.greatest(*cols) - F.least(*cols), F.lit(0.0)),
        "judge_missing": known < len(cols),
    }


def with_judges(rows: DataFrame, judges: dict[str, DataFrame], *, weight: float = 0.5) -> DataFrame:
    """Left joins of judge tables (id, score 0..10) on the normalised id, with their aggregates and a blend with overall_score."""
    out = rows.withColumn("_id", question_id(F.col("id")))
    for name, table in judges.items():
        score = F.col("score_raw").cast("string").try_cast("double") / 10
        out = out.join(table.select(question_id(F.col("id")).alias("_id"), score.alias(name)), "_id", "left")
    out = out.withColumns(judge_columns(list(judges))).drop("_id")
    return out.withColumn("judge_gap", F.col("judge_mean") - F.col("overall_score")).withColumn("blended_score", weight * F.coalesce("judge_mean", "overall_score") + (1 - weight) * F.col("overall_score"))


def ragas(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """question, answer, contexts (in order of rank), ground_truth."""
    contexts = docs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    return rows.join(contexts, "id", "left").select("id", "question", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), F.col("expected_answer").alias("ground_truth"))
