"""Prompts, citation checks, the extractive answer and conversation memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import rules
from ..functions import text as tx
from .retrieval import query_terms, top
from .structure import sentences


def citations(answers: DataFrame, *, keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """query_id, label, kind, nomor, year of every regulation an answer names."""
    group = lambda n: F.regexp_extract_all(F.col("answer"), F.lit(rules.CITATION), F.lit(n))
    named = answers.select(*keep, F.explode(F.arrays_zip(group(1).alias("t"), group(2).alias("n"), group(3).alias("y"))).alias("c"))
    label = F.concat(F.col("c.t"), F.lit(" No. "), F.col("c.n"), F.lit(" Tahun "), F.col("c.y"))
    return named.select(*keep, label.alias("label"), q.regulation_kind(F.col("c.t")).alias("kind"), F.trim("c.n").alias("nomor"), F.col("c.y").alias("year"))


def published(docs: DataFrame) -> Column:
    """Year of publication as text, else the year where `docs` has one."""
    year = F.col("year") if "year" in docs.columns else F.lit(None)
    return F.coalesce(F.nullif(F.col("publication_year").cast("string"), F.lit("0")), year.cast("string"))


def validated(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, cited, invalid (sorted sets), ok. docs: query_id, regulation_type, nomor, publication_year.

    An answer holds if all it cites is among its documents and it cites something or says that the
    matter is out of scope.
    """
    known = docs.select("query_id", q.regulation_kind(F.col("regulation_type")).alias("kind"), F.trim("nomor").alias("nomor"), published(docs).alias("year"), F.lit(True).alias("known")).distinct()
    judged = citations(answers).join(known, ["query_id", "kind", "nomor", "year"], "left")
    sets = judged.groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("cited"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("label")))).alias("invalid"))
    none = F.array().cast("array<string>")
    out = answers.select("query_id", "answer").join(sets, "query_id", "left").select("query_id", F.coalesce("cited", none).alias("cited"), F.coalesce("invalid", none).alias("invalid"), "answer")
    ok = (F.size("invalid") == 0) & ((F.size("cited") > 0) | F.contains(F.lower("answer"), F.lit(rules.OUT_OF_SCOPE)))
    return out.select("query_id", "cited", "invalid", ok.alias("ok"))


def search_words(queries: DataFrame, extract: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """queries with `search`: the question itself, or what an `extract` of question lists makes of it; a failed or empty extraction gives the question."""
    if extract is None:
        return queries.withColumn("search", F.col("query"))
    made = generate(queries.withColumn("prompt", F.col("query")), extract, out="search").drop("prompt")
    return made.withColumn("search", F.coalesce(F.nullif(F.trim("search"), F.lit("")), F.col("query")))


def bracket_errors(answer: Column, n_docs: Column) -> Column:
    """Numbers of [R#] codes beyond the documents given."""
    used = F.transform(F.regexp_extract_all(answer, F.lit(r"\[R(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_except(used, F.sequence(F.lit(1), F.greatest(n_docs, F.lit(1)))))


def cited_documents(answers: DataFrame, docs: DataFrame, pasal_col: str = "pasal_id") -> DataFrame:
    """Documents an answer cites, the first of each article."""
    keys = citations(answers).select("query_id", "kind", "nomor", "year").distinct()
    own = docs.withColumn("kind", q.regulation_kind(F.col("regulation_type"))).withColumn("nomor", F.trim("nomor")).withColumn("year", published(docs))
    found = own.join(keys, ["query_id", "kind", "nomor", "year"], "left_semi")
    return top(found, 1, [F.col("rank")], ("query_id", "kind", "nomor", "year", *([pasal_col] if pasal_col in docs.columns else [])), "_n").drop("_n", "kind", "year")


def extractive(docs: DataFrame, *, per_doc: int = 2, most: int = 6, excerpt: int = 900) -> DataFrame:
    """query_id, answer: the best sentences of each document by query terms, else an excerpt of the first.

    docs: query_id, query, rank, citation, text.
    """
    terms = query_terms(F.col("query"))
    rows = docs.select("query_id", "rank", "citation", terms.alias("terms"), F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.lower("sentence"), t)))
    scored = rows.withColumn("hits", hits).where("hits > 0")
    best = top(scored, per_doc, [F.desc("hits"), F.col("at")], ("query_id", "rank"), "of_doc")
    kept = top(best, most, [F.col("rank"), F.col("of_doc")], rank="place")
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("citation", F.lit(" menyatakan bahwa "), "sentence").alias("s")))), lambda x: x["s"]), "\n\n").alias("chosen"))
    first = top(docs, 1, [F.col("rank")], rank="_n").select("query_id", F.concat("citation", F.lit(" memuat ketentuan berikut: "), F.left(tx.squeeze(F.col("text")), F.lit(excerpt))).alias("excerpt"))
    return first.join(joined, "query_id", "left").select("query_id", F.coalesce("chosen", "excerpt").alias("answer"))


def answered(questions: DataFrame, generated: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, answer, ok, source: the generated answer if it holds, else the extractive one, else the apology.

    `ok` is the verdict on the answer that is returned, so the extractive one is checked again.
    """
    clean = generated.select("query_id", tx.sanitized(F.col("answer")).alias("answer"))
    checked = clean.join(validated(clean, docs).select("query_id", "ok"), "query_id").select("query_id", F.col("answer").alias("_gen"), F.col("ok").alias("_ok"))
    back = extractive(docs).select("query_id", F.col("answer").alias("_ext"))
    joined = questions.select("query_id").join(checked, "query_id", "left").join(back, "query_id", "left")
    holds = F.coalesce("_ok", F.lit(False))
    chosen = joined.select(
        "query_id",
        F.when(holds, F.col("_gen")).otherwise(F.coalesce("_ext", F.lit(rules.NO_CONTEXT_ANSWER))).alias("answer"),
        F.when(holds, "generated").when(F.col("_ext").isNotNull(), "extractive").otherwise("none").alias("source"),
    )
    return chosen.join(validated(chosen, docs).select("query_id", "ok"), "query_id").select("query_id", "answer", "ok", "source")


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], *, out: str = "answer") -> DataFrame:
    """Answers of any model over batches of prompts; a batch that fails gives nulls."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(column.tolist()), dtype="object")
        except Exception:  # noqa: BLE001  a failed call is a missing answer, which the fallback fills
            return pd.Series([None] * len(column), dtype="object")

    return prompts.withColumn(out, run("prompt"))


SYSTEM_PROMPT = (
    "Jawab hanya dari konteks hukum yang diberikan, sebutkan peraturan dan pasalnya, "
    "tanpa kode referensi dan tanpa daftar referensi; katakan jika informasi tidak tersedia dalam database hukum ketenagakerjaan yang dimiliki."
)


def messages(context: Column, query: Column, memory: Column | None = None) -> Column:
    """array of struct(role, content)."""
    remembered = F.lit("") if memory is None else F.when(F.coalesce(memory, F.lit("")) != "", F.concat(F.lit("MEMORI PERCAKAPAN SINGKAT:\n"), memory, F.lit("\n\n"))).otherwise("")
    user = F.concat(remembered, F.lit("KONTEKS REFERENSI HUKUM:\n"), context, F.lit("\n\nPERTANYAAN PENGGUNA:\n"), query)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user))


# ---------------------------------------------------------------- memory


def memory(turns: DataFrame, *, keep: int = 4, most: int = 1400, assistant: int = 900) -> DataFrame:
    """User turns with what is remembered before them.

    turns: conv_id, turn, role, text. Out: conv_id, turn, text, retrieval_query (previous user turns and
    this one, the last `most` characters), remembered (the prompt view of the last `keep` exchanges).
    A conversation is ordered by one window, which is bounded by its length.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(order)
    users = turns.withColumn("_reply", F.coalesce(reply, F.lit(""))).where("role = 'user'").withColumn("_text", F.coalesce("text", F.lit("")))
    before = order.rowsBetween(-keep, -1)
    history = F.concat_ws(" ", F.collect_list("_text").over(before))
    query = F.right(F.trim(F.concat_ws(" ", F.nullif(history, F.lit("")), F.col("_text"))), F.lit(most))
    pairs = F.collect_list(F.struct("_text", "_reply")).over(before)
    lines = F.transform(pairs, lambda p, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(" - Pengguna: "), p["_text"], F.lit("\nTurn "), (i + 1).cast("string"), F.lit(" - Asisten: "), F.left(p["_reply"], F.lit(assistant))))
    return users.select("conv_id", "turn", F.col("_text").alias("text"), query.alias("retrieval_query"), F.array_join(lines, "\n").alias("remembered"))
