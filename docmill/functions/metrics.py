"""Evaluation measures of one answer or one retrieved list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import alnum_only, bind, digits_only, folded

NO_RANK = 999


def targets(value: Column) -> Column:
    """Parts of a `;`-separated field, trimmed, without empties and nan."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def keyword_hits(answer: Column, keywords: Column) -> Column:
    """Keywords in the answer: as text, as letters and digits alone, or by their digits among the answer's."""
    a, ac, ad = folded(answer), alnum_only(answer), digits_only(folded(answer))
    inside = lambda part, whole: (part != "") & F.contains(whole, part)
    return F.filter(targets(keywords), lambda k: F.contains(a, folded(k)) | inside(alnum_only(k), ac) | inside(digits_only(folded(k)), ad))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.size(part) / F.nullif(F.size(whole), F.lit(0)), F.lit(0.0))


def variants(target: Column) -> Column:
    """Ways to write a law's name: as given, and short forms, which hold a slash, spelt out."""
    return bind(folded(target), lambda t: F.when(F.contains(t, F.lit("/")), _variants(t)).otherwise(F.array_compact(F.array(F.nullif(t, F.lit(""))))))


def _variants(t: Column) -> Column:
    pick = lambda p, n: F.regexp_extract(t, p, n)
    short, ministry, old = r"\b(pp|uu)\s*(\d+)\s*/\s*(\d{4})\b", r"\bpermenaker\s*(?:nomor\s*)?(\d+)\s*/\s*(\d{4})\b", r"\bpermenaker\s+per\.?(\d+)\s*/\s*men\s*/\s*([ivxlcdm]+)\s*/\s*(\d{4})\b"
    name = F.when(pick(short, 1) == "pp", "peraturan pemerintah").otherwise("undang undang")
    out = [F.nullif(t, F.lit(""))]
    for word in (" no ", " nomor "):
        out.append(F.when(t.rlike(short), F.concat(name, F.lit(word), pick(short, 2), F.lit(" tahun "), pick(short, 3))))
        out.append(F.when(t.rlike(ministry), F.concat(F.lit("peraturan menteri ketenagakerjaan" + word), pick(ministry, 1), F.lit(" tahun "), pick(ministry, 2))))
    out.append(F.when(t.rlike(old), F.concat(F.lit("peraturan menteri ketenagakerjaan no per "), pick(old, 1), F.lit(" men "), pick(old, 2), F.lit(" "), pick(old, 3))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def contains_target(blob: Column, target: Column) -> Column:
    return contains_any(blob, F.array(target))


def forms(text: Column) -> Column:
    """struct of a text folded, as letters and digits alone, and as digits alone."""
    return bind(folded(text), lambda t: F.struct(t.alias("text"), F.regexp_replace(t, "[^0-9a-z]+", "").alias("compact"), digits_only(t).alias("digits")))


def target_forms(values: Column) -> Column:
    """For each target the forms of its variants: made once, however many texts are searched for them."""
    return F.transform(values, lambda v: F.transform(variants(v), forms))


def _contains(f: Column, target: Column) -> Column:
    """Whether a text with the forms `f` holds a target, one of `target_forms`."""
    found = lambda v: F.contains(f["text"], v["text"]) | ((v["compact"] != "") & F.contains(f["compact"], v["compact"])) | ((F.length(v["digits"]) >= 3) & F.contains(f["digits"], v["digits"]))
    return F.exists(target, found)


def contains_any(blob: Column, values: Column) -> Column:
    return bind(F.struct(forms(blob).alias("f"), target_forms(values).alias("t")), lambda x: F.exists(x["t"], lambda v: _contains(x["f"], v)))


def target_coverage(blob: Column, values: Column) -> Column:
    return bind(F.struct(forms(blob).alias("f"), target_forms(values).alias("t")), lambda x: share(F.filter(x["t"], lambda v: _contains(x["f"], v)), values))


def reference_blob(ref: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(ref[c], F.lit("")) for c in ("reference", "pasal_id", "source_file", "text_preview")])


def target_hits(refs: Column, *targets: Column) -> Column:
    """struct per reference: its rank and, for each array of targets, whether it holds one (h0, h1, ...).

    References and targets are brought to their forms once, for all measures that are read from the hits.
    """
    both = F.struct(F.transform(refs, lambda r: F.struct(r["rank"].alias("rank"), forms(reference_blob(r)).alias("f"))).alias("refs"), *[target_forms(t).alias(f"t{i}") for i, t in enumerate(targets)])
    holds = lambda r, t: F.exists(t, lambda v: _contains(r["f"], v))
    return bind(both, lambda b: F.transform(b["refs"], lambda r: F.struct(r["rank"].alias("rank"), *[holds(r, b[f"t{i}"]).alias(f"h{i}") for i in range(len(targets))])))


def first_rank(hits: Column, which: int = 0) -> Column:
    """Rank of the first of `target_hits` that holds one of those targets, else 999."""
    return F.coalesce(F.get(F.filter(hits, lambda h: h[f"h{which}"]), F.lit(0))["rank"], F.lit(NO_RANK))


def target_rank(refs: Column, values: Column) -> Column:
    """Rank of the first reference with a target, else 999."""
    return first_rank(target_hits(refs, values))


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank >= NO_RANK, 0.0).otherwise(1.0 / rank)


def precision_at(refs: Column, values: Column, k: int = 3, *, fixed: bool = False) -> Column:
    """Share of the first k references with a target; of those returned, or of k with `fixed`."""
    return hits_at(target_hits(F.slice(refs, 1, k), values), k, fixed=fixed)


def hits_at(hits: Column, k: int = 3, *, which: tuple[int, ...] = (0,), fixed: bool = False) -> Column:
    """`precision_at` of `target_hits`, of any of the arrays of targets in `which`."""
    top = F.slice(hits, 1, k)
    found = F.filter(top, lambda h: reduce(lambda a, b: a | b, [h[f"h{i}"] for i in which]))
    return F.size(found) / F.lit(k) if fixed else share(found, top)


def length_score(answer: Column) -> Column:
    n = F.regexp_count(F.coalesce(answer, F.lit("")), F.lit(r"(?U)\S+"))
    return F.when(n < 25, n / 25).when(n <= 220, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - (n - 220) / 300))


def dot(a: Column, b: Column) -> Column:
    """Of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def judge_score(raw: Column) -> Column:
    """First number of a judge's reply over 100, clamped; 0.5 without one."""
    n = F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("double")
    return F.when(n.isNull(), 0.5).otherwise(F.least(n / 100, F.lit(1.0)))


def overall_score(weights: dict[str, float] | None = None) -> Column:
    parts = [F.least(F.greatest(F.col(k).cast("double"), F.lit(0.0)), F.lit(1.0)) * w for k, w in (weights or rules.SCORE_WEIGHTS).items()]
    return sum(parts[1:], parts[0])


def quality_label(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in reversed(rules.QUALITY_BINS):
        out = F.when((score > low) & (score <= high), F.lit(name)).otherwise(out)
    return out
