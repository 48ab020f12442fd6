"""Row types, in one place; readers use them with FAILFAST instead of guessing."""

from pyspark.sql import types as T

CONTEXT_FIELDS = ("bab", "bab_title", "bagian", "bagian_title", "paragraf", "paragraf_title")

_META = (
    "regulation_type string, regulation_hierarchy int, nomor string, tentang string, year int, publication_year int, active_status string, "
    "source_file string, source_path string, extractor string, chunk_level string, extraction_page_count int, extraction_counts string, "
    "extraction_char_count int, extraction_word_count int, extraction_pasal_count int, extraction_noise_ratio double, extraction_ocr_artifact_count int, "
    "pasal_id string, chunk_kind string, chunk_index int, token_count_estimate int, bab string, bab_title string, bagian string, bagian_title string, "
    "paragraf string, paragraf_title string, quality_status string, quality_reasons string, part_index int, part_count int, "
    "llm_typo_corrected boolean, deterministic_typo_corrected boolean, llm_typo_error string"
)


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _ddl(text: str) -> T.StructType:
    """Flat `name type` lists, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


METADATA = _ddl(_META)
CHUNKS = _ddl("id string, text string, display_text string, embedding_text string, citation_text string, original_id string").add("metadata", METADATA)
PAGES = _ddl("doc_id string, page_number int, text string, extractor string, score double")
HITS = _ddl("query_id string, id string, source string, rank int, dense_distance double, bm25_score double, rrf_score double, final_score double, rerank_score double, context_relevance_score double")
FAILURES = _ddl("source_file string, status string, reason string, quality string, moved_to string")
OCR_CACHE = _ddl("source_file string, source_size long, source_mtime long, pdf_page_count int, ocr_pages int, max_pages int, dpi int, det_model string, rec_model string")
CORRECTIONS = _ddl("cache_key string, chunk_id string, corrected_text string")
GROUND_TRUTH = _ddl("id string, topic string, difficulty string, question string, expected_answer string, expected_citations string, expected_law_numbers string, expected_articles string, expected_keywords string")
REFERENCES = T.ArrayType(_ddl("rank int, chunk_id string, reference string, source_file string, pasal_id string, rrf_score double, rerank_score double, context_relevance_score double, text_preview string"))
