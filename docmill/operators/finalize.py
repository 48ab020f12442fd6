"""From raw chunks to the published table: ids, quality flags, long-text split, corrections, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metadata as md
from ..functions import quality as q
from ..functions import rules
from ..functions import text as tx
from ..schemas import CONTEXT_FIELDS
from .structure import long_parts


def repair_duplicate_ids(chunks: DataFrame, *, order_col: str = "ord", source: Column | None = None, pasal: Column | None = None) -> DataFrame:
    """Second and later rows of an id get one derived from their content, and keep the old as original_id."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(order_col))
    source = F.col("metadata.source_file") if source is None else source
    pasal = F.col("metadata.pasal_id") if pasal is None else pasal
    seed = F.concat_ws("::", "id", F.col(order_col).cast("string"), F.coalesce(source, F.lit("")), F.coalesce(pasal, F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(200)))
    numbered = chunks.withColumn("_nth", nth).withColumn("_new", F.sha1(seed.cast("binary")))
    return (
        numbered.withColumn("original_id", F.when(F.col("_nth") > 1, F.col("id")))
        .withColumn("id", F.when(F.col("_nth") > 1, F.col("_new")).otherwise(F.col("id")))
        .drop("_nth", "_new")
    )


def normalized_metadata(meta: Column) -> Column:
    """Blank strings for nulls, whole years with the publication year filled from the year."""
    text = lambda c: F.coalesce(meta[c].cast("string"), F.lit(""))
    year = F.coalesce(meta["year"].cast("string").try_cast("int"), F.lit(0))
    published = F.coalesce(F.nullif(meta["publication_year"].cast("string").try_cast("int"), F.lit(0)), year)
    names = ("source_file", "pasal_id", "bab", "bab_title", "regulation_type", "nomor", "tentang")
    return F.struct(*[text(c).alias(c) for c in names], year.alias("year"), published.alias("publication_year"))


def repaired_metadata(chunks: DataFrame, raw_texts: DataFrame, *, order_col: str = "ord") -> DataFrame:
    """source_file, meta: re-extracted where the source's raw text is at hand, else its first chunk's, patched from the file name.

    `chunks` has metadata and the order; `raw_texts` has stem, text.
    """
    first = chunks.groupBy(F.col("metadata.source_file").alias("source_file")).agg(F.min_by("metadata", order_col).alias("old"))
    stem = F.regexp_replace("source_file", r"(?<=.)\.[^.]*$", "")
    both = first.withColumn("stem", stem).join(raw_texts.select("stem", F.col("text").alias("_raw")), "stem", "left")
    fresh, named = md.regulation(F.col("source_file"), F.col("_raw")), md.number_and_year_of_filename(F.col("source_file"))
    has_raw = F.coalesce(F.col("_raw"), F.lit("")) != ""
    old_nomor = F.when(~F.coalesce(F.col("old.nomor"), F.lit("")).isin("", "Unknown"), F.col("old.nomor"))
    old_year = F.nullif(F.col("old.year"), F.lit(0))
    pick = {
        "nomor": F.coalesce(old_nomor, named["nomor"], F.lit("Unknown")),
        "year": F.coalesce(old_year, named["year"], F.lit(0)),
        "publication_year": F.coalesce(F.nullif(F.col("old.publication_year"), F.lit(0)), old_year, named["year"], F.lit(0)),
    }
    fields = ["regulation_type", "regulation_hierarchy", "nomor", "tentang", "year", "publication_year", "active_status"]
    return both.select("source_file", F.struct(*[F.when(has_raw, fresh[f]).otherwise(pick.get(f, F.col(f"old.{f}"))).alias(f) for f in fields]).alias("meta"))


def finalize(chunks: DataFrame, sources: DataFrame, *, max_words: int = 450, overlap_words: int = 60, max_noise: float = rules.MAX_NOISE, max_artifacts: int = rules.MAX_ARTIFACTS, drop_quarantined: bool = False) -> DataFrame:
    """Published chunks. `chunks`: id, text, metadata, ord; `sources`: source_file, meta (repaired)."""
    noise, artifacts = F.coalesce("metadata.extraction_noise_ratio", F.lit(0.0)), F.coalesce("metadata.extraction_ocr_artifact_count", F.lit(0))
    rows = chunks.withColumn("source_file", F.col("metadata.source_file")).join(sources, "source_file")
    rows = rows.withColumn("reasons", q.quarantine_reasons(noise, artifacts, max_noise, max_artifacts)).withColumn("review", F.size("reasons") > 0)
    rows = rows.where(~F.col("review")) if drop_quarantined else rows
    rows = rows.withColumn("_body", tx.cleaned(tx.before_appendix(F.col("text")))).where("_body != ''")
    rows = rows.withColumn("_parts", long_parts(F.col("_body"), max_words, overlap_words))
    parts = rows.select("*", F.size("_parts").alias("part_count"), F.posexplode("_parts").alias("_at", "part")).withColumn("part_index", F.col("_at") + 1)
    pasal = F.coalesce("metadata.pasal_id", F.lit(""))
    split = F.col("part_count") > 1
    shown = F.when(split, F.concat(pasal, F.lit(" bagian "), F.col("part_index").cast("string"))).otherwise(pasal)
    ctx = F.struct(*[F.coalesce(F.col(f"metadata.{c}"), F.lit("")).alias(c) for c in CONTEXT_FIELDS])
    seed = F.concat_ws("::", "source_file", "id", F.coalesce(F.col("metadata.chunk_index").cast("string"), F.lit("")), pasal, F.col("part_index").cast("string"), F.left(F.sha1(F.col("part").cast("binary")), F.lit(16)))
    display = md.display_text(F.col("meta"), ctx, shown, F.col("part"))
    return parts.select(
        F.sha1(seed.cast("binary")).alias("id"),
        F.col("part").alias("text"),
        display.alias("display_text"),
        display.alias("embedding_text"),
        md.citation(F.col("meta.regulation_type"), F.col("meta.nomor"), F.col("meta.publication_year"), shown).alias("citation_text"),
        F.struct(
            "meta.*",
            "source_file",
            pasal.alias("pasal_id"),
            F.when(split, "pasal_split").otherwise(F.coalesce("metadata.chunk_kind", F.lit("pasal"))).alias("chunk_kind"),
            F.coalesce("metadata.chunk_index", F.lit(0)).alias("chunk_index"),
            q.token_estimate(F.col("part")).alias("token_count_estimate"),
            ctx.alias("section"),
            F.when(F.col("review"), "needs_review").otherwise("ok").alias("quality_status"),
            F.when(F.col("review"), F.to_json("reasons")).otherwise("").alias("quality_reasons"),
            F.when(split, F.col("part_index")).alias("part_index"),
            F.when(split, F.col("part_count")).alias("part_count"),
        ).alias("metadata"),
        "ord",
    )


def source_counts(final: DataFrame) -> DataFrame:
    """source_file, chunks, review_chunks of a run."""
    review = F.sum(F.when(F.col("metadata.quality_status") == "needs_review", 1).otherwise(0))
    return final.groupBy(F.col("metadata.source_file").alias("source_file")).agg(F.count(F.lit(1)).alias("chunks"), review.alias("review_chunks"))


def correction_report(corrected_chunks: DataFrame) -> DataFrame:
    """One row of counters of a correction run."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return corrected_chunks.agg(F.count(F.lit(1)).alias("chunks"), n(F.col("llm_typo_corrected")).alias("corrected"), n(F.col("missing")).alias("missing"), n(~F.col("llm_typo_corrected") & ~F.col("missing")).alias("skipped"))


def report(chunks: DataFrame, final: DataFrame) -> DataFrame:
    """One row of counters."""
    suspicious = q.suspicious_reasons(F.col("text"), F.col("metadata.nomor"), F.col("metadata.year"), F.col("metadata.tentang"), F.col("metadata.pasal_id"))
    a = chunks.agg(F.count(F.lit(1)).alias("input_chunks"), F.count_distinct("metadata.source_file").alias("input_sources"))
    b = final.agg(
        F.count(F.lit(1)).alias("output_chunks"),
        F.sum(F.when(F.col("metadata.quality_status") == "needs_review", 1).otherwise(0)).alias("review_chunks"),
        F.sum(F.when(F.size(suspicious) > 0, 1).otherwise(0)).alias("suspicious_chunks"),
    )
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def replace_sources(base: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows of `base` whose source does not come in `new`, and `new`."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


# ---------------------------------------------------------------- corrections


def cache_key(chunk_id: Column, text: Column, *, provider: str, model: str) -> Column:
    """Of a correction: who made it, and of which text of which chunk."""
    parts = F.struct(chunk_id.alias("id"), F.lit(model).alias("model"), F.lit(provider).alias("provider"), F.coalesce(text, F.lit("")).alias("text"))
    return F.sha1(F.to_json(parts, {"ignoreNullFields": "false"}).cast("binary"))


def with_display(chunks: DataFrame, changed: Column) -> DataFrame:
    """Chunks whose text has `changed` with their display, embedding and citation texts made again from it.

    chunks: text, display_text, embedding_text, citation_text, metadata with the law's fields, pasal_id and the section's.
    """
    meta = F.col("metadata")
    ctx = F.struct(*[F.coalesce(meta[c], F.lit("")).alias(c) for c in CONTEXT_FIELDS])
    shown = md.display_text(meta, ctx, F.coalesce(meta["pasal_id"], F.lit("")), F.col("text"))
    again = {"display_text": shown, "embedding_text": shown, "citation_text": md.compact_citation(meta)}
    return chunks.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in again.items()})


def deterministic(chunks: DataFrame) -> DataFrame:
    """Chunks cleaned by rule alone, marked where that changed the text, with their display texts made again."""
    clean = tx.cleaned(F.col("text"))
    marked = chunks.withColumn("deterministic_typo_corrected", ~F.col("text").eqNullSafe(clean)).withColumn("text", clean)
    return with_display(marked, F.col("deterministic_typo_corrected"))


def batch_corrections(pages: DataFrame, ask, *, size: int = 3, text_col: str = "text") -> DataFrame:
    """`pages` with corrected_text by an `ask` that is given `size` texts and replies with a JSON list; a malformed reply keeps the originals."""
    kept = pages.columns

    def corrected_of(texts: list[str]) -> list[str]:
        try:
            reply = json.loads(ask(texts))
        except Exception:  # noqa: BLE001  a failed or malformed reply changes nothing
            return texts
        return [str(x) for x in reply] if isinstance(reply, list) and len(reply) == len(texts) else texts

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].tolist()
            pdf["corrected_text"] = [c for i in range(0, len(texts), size) for c in corrected_of(texts[i : i + size])]
            yield pdf

    return pages.select(*kept).mapInPandas(run, T.StructType([*pages.schema.fields, T.StructField("corrected_text", T.StringType())]))


def routed(documents: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(usable documents, FAILURES rows of the others with the first reason against each and where it goes). documents: source_file, text."""
    judged = documents.withColumn("_verdict", q.usable(q.extraction_quality(F.coalesce(F.col(text_col), F.lit("")))))
    failed = judged.where("_verdict != 'ok'")
    status = F.when(F.coalesce(F.trim(text_col), F.lit("")) == "", "no_text").otherwise("low_quality")
    rows = failed.select("source_file", status.alias("status"), F.col("_verdict").alias("reason"), F.to_json(q.extraction_quality(F.coalesce(F.col(text_col), F.lit("")))).alias("quality"), F.concat(F.lit("failed/"), status, F.lit("/"), "source_file").alias("moved_to"))
    return judged.where("_verdict = 'ok'").drop("_verdict"), rows


def last_writes(cache: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key."""
    return cache.groupBy(key).agg(F.max_by(value, order).alias(value))


def corrected(chunks: DataFrame, cache: DataFrame, *, provider: str, model: str, only_review: bool = False, only_suspect: bool = True, min_words: int = 0) -> DataFrame:
    """Chunks with cached corrections applied to those that need one; `cache`: cache_key, corrected_text.

    What the cache lacks keeps its text and is marked `missing`, for a model to fill (`corrections`).
    """
    wanted = q.needs_correction(F.col("text"), F.col("metadata.quality_status"), only_review=only_review, only_suspect=only_suspect, min_words=min_words)
    keyed = chunks.withColumn("_wanted", wanted).withColumn("cache_key", cache_key(F.col("id"), F.col("text"), provider=provider, model=model))
    joined = keyed.join(cache.select("cache_key", "corrected_text"), "cache_key", "left")
    done = F.col("_wanted") & F.col("corrected_text").isNotNull()
    return (
        joined.withColumn("text", F.when(done, tx.model_output(F.col("corrected_text"))).otherwise(F.col("text")))
        .withColumn("llm_typo_corrected", done)
        .withColumn("missing", F.col("_wanted") & F.col("corrected_text").isNull())
        .drop("_wanted", "corrected_text")
    )


def corrections(chunks: DataFrame, ask, *, provider: str, model: str) -> DataFrame:
    """cache_key, chunk_id, corrected_text, error of the chunks marked `missing`, by any `ask` of text lists; a batch that fails keeps its error and gives no text."""
    keyed = chunks.where("missing").select(cache_key(F.col("id"), F.col("text"), provider=provider, model=model).alias("cache_key"), F.col("id").alias("chunk_id"), "text")

    def run(batches):
        for pdf in batches:
            try:
                pdf["corrected_text"], pdf["error"] = [None if t is None else str(t) for t in ask(pdf["text"].tolist())], None
            except Exception as error:  # noqa: BLE001  a failed call is recorded, the run goes on
                pdf["corrected_text"], pdf["error"] = None, str(error)
            yield pdf.drop(columns="text")

    return keyed.mapInPandas(run, "cache_key string, chunk_id string, corrected_text string, error string")


def best_page(pages: DataFrame, priority: tuple[str, ...] = ("pymupdf", "pdfplumber")) -> DataFrame:
    """Each page by the extractor with the best score; ties go by priority, then by name."""
    rank = F.coalesce(*[F.when(F.col("extractor") == e, F.lit(i)) for i, e in enumerate(priority)], F.lit(len(priority)))
    order = Window.partitionBy("doc_id", "page_number").orderBy(F.desc("score"), rank, "extractor")
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def document_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages with text in order, a blank line between them; page_count; extractor_counts where pages name their extractor."""
    counts = []
    if "extractor" in pages.columns:
        names = F.array_sort(F.collect_list("extractor"))
        counts = [F.to_json(F.map_from_entries(F.transform(F.array_distinct(names), lambda e: F.struct(e, F.size(F.filter(names, lambda x: x == e)))))).alias("extractor_counts")]
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page_number", "text")))), lambda p: p["text"]), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("page_count"),
        *counts,
    )


def valid_ocr_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache entries that still fit their file: equal name, size, time and page counts."""
    return cache.join(files, ["source_file", "source_size", "source_mtime", "pdf_page_count", "ocr_pages"], "left_semi")
