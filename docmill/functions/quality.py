"""Scores and predicates of texts and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def n_words(text: Column) -> Column:
    return count(text, r"(?U)\S+")


def n_pasal(text: Column) -> Column:
    return count(text, "(?im)" + rules.PASAL_HEADING)


def n_odd(text: Column) -> Column:
    return count(text, "(?U)" + rules.ODD_CHARACTER)


def n_mojibake(text: Column) -> Column:
    return count(text, rules.MOJIBAKE)


def n_artifacts(text: Column) -> Column:
    return count(text, rf"(?iU)\b(?:{rules.OCR_ARTIFACTS})\b")


def n_without_vowel(text: Column, least: int) -> Column:
    """Words of at least `least` Latin letters, none a vowel."""
    letters = lambda w: F.regexp_replace(w, "[^A-Za-z]", "")
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)), lambda w: (F.length(letters(w)) >= least) & ~w.rlike("[aeiouAEIOU]")))


def page_score(text: Column) -> Column:
    """How well a page was read; empty pages lose to all others."""
    terms = count(text, rf"(?iU)\b(?:{'|'.join(rules.LEGAL_TERMS)})\b")
    score = F.least(F.length(text), F.lit(5000)) / 200 + n_pasal(text) * 30 + terms * 1.5 - n_odd(text) * 0.6 - n_mojibake(text) * 4
    score = score - n_without_vowel(text, 5) / F.greatest(n_words(text), F.lit(1)) * 80 - n_artifacts(text) * 2
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(-999.0)).otherwise(score)


def extraction_quality(text: Column) -> Column:
    """struct of char_count, word_count, pasal_count, noise_ratio, ocr_artifact_count."""
    noise = (n_odd(text) + n_mojibake(text) * 3 + n_artifacts(text) * 5) / F.greatest(n_words(text), F.lit(1))
    return F.struct(
        F.length(text).alias("char_count"),
        n_words(text).alias("word_count"),
        n_pasal(text).alias("pasal_count"),
        F.bround(noise, 4).alias("noise_ratio"),
        n_artifacts(text).alias("ocr_artifact_count"),
    )


def usable(q: Column, min_chars: int = rules.MIN_CHARS, min_pasal: int = rules.MIN_PASAL, max_noise: float = rules.MAX_NOISE, max_artifacts: int = rules.MAX_ARTIFACTS) -> Column:
    """'ok' or the first reason against a quality struct."""
    return (
        F.when(q["char_count"] < min_chars, F.concat(F.lit("teks terlalu pendek ("), q["char_count"].cast("string"), F.lit(" char)")))
        .when(q["pasal_count"] < min_pasal, F.lit(f"Pasal terdeteksi kurang dari {min_pasal}"))
        .when(q["noise_ratio"] > max_noise, F.concat(F.lit("noise terlalu tinggi ("), q["noise_ratio"].cast("string"), F.lit(")")))
        .when(q["ocr_artifact_count"] > max_artifacts, F.concat(F.lit("artefak OCR terlalu banyak ("), q["ocr_artifact_count"].cast("string"), F.lit(")")))
        .otherwise("ok")
    )


def markdown_noise(text: Column) -> Column:
    """Share of replacement signs, odd characters and words in other scripts."""
    foreign = count(text, r"[^\s\p{IsLatin}\p{IsCommon}]{4,}")
    return F.bround((count(text, r"\x{FFFD}") + n_odd(text) + foreign) / F.greatest(n_words(text), F.lit(1)), 4)


def native_text_ok(text: Column) -> Column:
    """Enough text that is not broken into single lines."""
    return (F.length(text) >= 80) & (count(text, "\n") / F.greatest(F.length(text), F.lit(1)) <= 0.35)


def ocr_noise_share(text: Column) -> Column:
    """Share of words with a noise character, or of more than three letters without a vowel."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))
    inner = lambda w: F.regexp_replace(w, r"^[.,;:!?()\"'\-]+|[.,;:!?()\"'\-]+$", "")
    letters = lambda w: F.regexp_replace(w, "[^a-zA-Z]", "")
    bad = lambda w: w.rlike(r"[·;\\~^`|{}\[\]<>\x80-\xFF]") | ((F.length(letters(w)) > 3) & ~letters(w).rlike("[aeiouAEIOU]"))
    return F.coalesce(F.size(F.filter(words, lambda w: bad(inner(w)))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words(text) * F.lit(1.35)).cast("int"))


def quarantine_reasons(noise: Column, artifacts: Column, max_noise: float = rules.MAX_NOISE, max_artifacts: int = rules.MAX_ARTIFACTS) -> Column:
    return F.array_compact(
        F.array(
            F.when(noise > max_noise, F.concat(F.lit(f"noise_ratio>{max_noise}: "), noise.cast("string"))),
            F.when(artifacts > max_artifacts, F.concat(F.lit(f"ocr_artifact_count>{max_artifacts}: "), artifacts.cast("string"))),
        )
    )


def suspicious_reasons(text: Column, nomor: Column, year: Column, tentang: Column, pasal_id: Column) -> Column:
    missing = lambda c: F.coalesce(c, F.lit("")).isin("", "Unknown")
    return F.array_compact(
        F.array(
            F.when(missing(nomor) | (F.coalesce(year, F.lit(0)) == 0), F.lit("unknown_nomor_or_year")),
            F.when(missing(tentang), F.lit("unknown_tentang")),
            F.when(F.coalesce(pasal_id, F.lit("")).rlike(r"\bPasal\s+[LI]\b"), F.lit("suspicious_pasal_id")),
            F.when(F.length(text) > 12000, F.lit("very_long_chunk")),
        )
    )


def needs_correction(text: Column, quality_status: Column, *, only_review: bool = False, only_suspect: bool = False, min_words: int = 0) -> Column:
    suspect = "(?i)" + "|".join(f"(?:{p})" for p in rules.SUSPECT_TEXT)
    out = n_words(text) >= min_words
    if only_review:
        out = out & (F.coalesce(quality_status, F.lit("")) == "needs_review")
    return out & text.rlike(suspect) if only_suspect else out


def any_of(text: Column, words, *, word_boundary: bool = False) -> Column:
    """Whether any of the words is contained (as a whole word with `word_boundary`)."""
    if word_boundary:
        return text.rlike(r"\b(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")\b")
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def regulation_kind(value: Column) -> Column:
    """uu, pp, perpres, permen, else the value in lower case; the order decides."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return (
        F.when(F.contains(v, F.lit("undang")) | (v == "uu"), "uu")
        .when(F.contains(v, F.lit("pemerintah")) | (v == "pp"), "pp")
        .when(any_of(v, ("presiden", "perpres")), "perpres")
        .when(any_of(v, ("menteri", "permen")), "permen")
        .otherwise(v)
    )


def in_domain(tentang: Column, bab_title: Column, bagian_title: Column, regulation_type: Column, nomor: Column, *, word_boundary: bool = False) -> Column:
    """Employment law: not by an excluding keyword; by a known regulation, a keyword, or no subject at all."""
    blank = lambda c: F.lower(F.coalesce(c, F.lit("")))
    about = F.concat_ws(" ", blank(tentang), blank(bab_title), blank(bagian_title))
    key = F.concat_ws("|", regulation_kind(regulation_type), F.trim(F.coalesce(nomor, F.lit(""))))
    known = key.isin(*["|".join(k) for k in rules.DOMAIN_REGULATIONS])
    return (
        F.when(any_of(about, rules.DOMAIN_NEGATIVE, word_boundary=word_boundary), False)
        .when(known | any_of(about, rules.DOMAIN_POSITIVE, word_boundary=word_boundary), True)
        .otherwise(F.trim(blank(tentang)) == "")
    )


def title_excluded(title: Column) -> Column:
    return any_of(F.lower(title), rules.EXCLUDED_TITLES)


def answer_issue(text: Column) -> Column:
    """Too short, or in Cyrillic or Arabic script."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 20) | F.coalesce(text, F.lit("")).rlike(r"[Ѐ-ӿ؀-ۿ]")


def chunk_errors(chunk: Column) -> Column:
    """Names of what a chunk lacks."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    meta = chunk["metadata"]
    checks = [(empty(chunk[c]), f"empty_{c}") for c in ("id", "text", "display_text", "citation_text")]
    checks += [(empty(meta[c]), f"missing_{c}") for c in ("regulation_type", "nomor", "source_file", "pasal_id")]
    checks.append((F.coalesce(meta["year"], F.lit(0)) == 0, "missing_year"))
    checks.append((~F.coalesce(meta["active_status"], F.lit("")).isin("Berlaku", "Tidak Berlaku", "Diubah"), "bad_active_status"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
