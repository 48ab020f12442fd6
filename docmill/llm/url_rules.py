"""URL filters by expression digests.

Every URL is expanded into host-suffix and path-prefix expressions; an expression is looked up by
a 4-byte prefix of its SHA-256 (equi-join), confirmed by the full digest, and the longest
confirmed rule of a page wins.

Path prefixes are made only at lengths that rules have (a small set: at most the longest rule's
path), which loses no match: a rule fits exactly when the host suffix equals its host and the
path's prefix of its own path's length equals its path.

Edge cases: a null url or one without `://` has an empty host and path, and only a rule with an
empty host could fit; repeated pages give a row each; an empty table gives no rows; no other
column is read. Of rules of equal length the longer host wins, then block over allow, then the
first expression by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many bytes (all expressions together) are broadcast; larger sets are shuffled.
BROADCAST_BYTES = 8 << 20

RULES_SCHEMA = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each suffix of it after a dot."""
    labels = F.split(host, r"\.", -1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (the rule's, else `default`).

    `rules` has verdict, host, path. The set's size is measured: up to `broadcast_bytes` it is
    broadcast, a larger one is shuffled. Each distinct (host, path) is looked up once, so a page
    repeated without end is one row there; the join back to pages is a plain one that AQE splits.
    """
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    known = (
        rules.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
        .groupBy("h", "p")
        .agg(F.max("verdict").alias("rule_verdict"))  # block over allow
        .select(F.concat("h", "p").alias("rule"), F.length("h").alias("host_len"), F.length("p").alias("path_len"), "rule_verdict", digest(F.concat_ws("\x00", "h", "p")).alias("full"))
        .withColumn("short", F.left("full", F.lit(8)))
    )
    size, lengths = known.agg(F.coalesce(F.sum(F.length("rule") + 90), F.lit(0)), F.sort_array(F.collect_set("path_len"))).first()
    page = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    expressions = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.concat_ws("\x00", h, p))))
    looked = page.select("host", "path").distinct().select("host", "path", F.explode(expressions).alias("e")).withColumn("own", digest(F.col("e"))).withColumn("short", F.left("own", F.lit(8)))
    confirmed = looked.join(F.broadcast(known) if size <= broadcast_bytes else known, "short").where(F.col("own") == F.col("full"))
    best = confirmed.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")).alias("best"))
    return page.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
