"""Cleaning, scoring and metadata on small texts."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.functions import metadata as md
from docmill.functions import metrics as m
from docmill.functions import quality as q
from docmill.functions import rules
from docmill.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (tx.compact_spaces, "  a \t b\n", "a b"),
        (tx.squeeze, " a\n\n b  ", "a b"),
        (tx.number_token, "2O|l", "2011"),
        (tx.title_case, "BAB-i ketentuan umum", "Bab-I Ketentuan Umum"),
        (tx.fix_list_numbers, "2 2. a\n1 0. b", "2. a\n10. b"),
        (tx.fix_words, "Knrja KNRTU buruii", "Kerja KARTU buruh"),
        (tx.fix_years, "tahun 2o14 dan 20l1 dan 199O", "tahun 2014 dan 2011 dan 1990"),
        (tx.normalized, "P a s a l 3\nB A B II", "Pasal 3\nBAB II"),
        (tx.fix_common, "naik 12 olo menurut Pasal iv", "naik 12% menurut Pasal IV"),
        (tx.cleaned, "satu-\ndua\n- 12 -\nPRESIDEN\ntiga", "satudua\ntiga"),
        (tx.without_noise_lines, "a\nwww.x.id\n\n\n\nb", "a\n\nb"),
        (tx.without_table_garbage, "a\n| x | y |\n1111111111 2222222222 333\nb", "a\nb"),
        (tx.from_body, "kop\nBAB I\nisi", "BAB I\nisi"),
        (tx.from_body, "tanpa tanda", "tanpa tanda"),
        (tx.before_explanation, "isi\nPENJELASAN ATAS x", "isi"),
        (tx.before_appendix, "isi tercantum dalam Lampiran I ini\nLAMPIRAN PERATURAN x", "isi tercantum dalam Lampiran I ini"),
        (tx.before_appendix, "isi dalam Lampiran I saja", "isi dalam Lampiran I saja"),
        (tx.before_trailing_headers, "isi\nBAB II\nlain", "isi"),
        (tx.before_trailing_headers, "isi\nlain", "isi\nlain"),
        (tx.without_definition_preamble, "Dalam Peraturan Menteri ini yang dimaksud dengan:\n1. x", "1. x"),
        (tx.folded_lines, "a\nb\n\n\nc", "a b\nc"),
        (tx.sanitized, "## **Halo** [R1, R2]\n```x```\nReferensi: a", "Halo"),
        (tx.without_thinking, "<think>a\nb</think> c  d", "c d"),
        (tx.model_output, "```text\nHasil koreksi: isi\n```", "isi"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_rule_engine_names_what_changed(spark):
    rules = [("a", "x", "y", True), ("b", "q", "r", True), ("c", "y", "z", False)]
    got = one(spark, "xx", lambda t: tx.apply_rules(t, rules))
    assert (got["text"], got["applied"]) == ("yy", ["a"])


def test_nulls_stay_null(spark):
    for f in (tx.cleaned, tx.squeeze, tx.before_appendix, tx.folded_lines):
        assert one(spark, None, f) is None


def test_page_score_and_gate(spark):
    assert one(spark, "", q.page_score) == -999.0
    assert one(spark, "Pasal 1\nKerja", q.page_score) > one(spark, "Â krstvw", q.page_score)
    verdict = lambda t: q.usable(q.extraction_quality(t))
    assert one(spark, "pendek", verdict) == "teks terlalu pendek (6 char)"
    assert one(spark, "kata " * 100, verdict) == "Pasal terdeteksi kurang dari 1"
    assert one(spark, "Pasal 1\n" + "kata " * 100, verdict) == "ok"
    assert one(spark, "a", q.token_estimate) == 1
    assert one(spark, "kata krst ba~d x", q.ocr_noise_share) == 0.5


@pytest.mark.parametrize(
    ("name", "nomor", "year"),
    [
        ("PER.15-MEN-VI-2008.pdf", "PER.15/MEN/VI/2008", 2008),
        ("PP0352021.pdf", "35", 2021),
        ("UU_Nomor_13_Tahun_2003.pdf", "13", 2003),
        ("tanpa-angka.pdf", None, None),
    ],
)
def test_filenames(spark, name, nomor, year):
    got = one(spark, name, md.number_and_year_of_filename)
    assert (got["nomor"], got["year"]) == (nomor, year)


def test_regulation(spark):
    text = "PERATURAN PEMERINTAH REPUBLIK INDONESIA NOMOR 35 TAHUN 2021 TENTANG PERJANJIAN KERJA DENGAN RAHMAT TUHAN"
    got = one(spark, text, lambda t: md.regulation(F.lit("a/b/x.pdf"), t))
    assert (got["regulation_type"], got["nomor"], got["year"], got["tentang"], got["regulation_hierarchy"]) == ("Peraturan Pemerintah", "35", 2021, "PERJANJIAN KERJA", 2)
    blank = one(spark, "", lambda t: md.regulation(F.lit("x.pdf"), t))
    assert (blank["regulation_type"], blank["nomor"], blank["year"], blank["regulation_hierarchy"]) == ("Unknown", "Unknown", 0, 99)


def test_targets(spark):
    contains = lambda target: one(spark, "Menurut Peraturan Pemerintah No. 35 Tahun 2021, Pasal 2", lambda t: m.contains_target(t, F.lit(target)))
    assert contains("PP 35/2021") and contains("Pasal 2") and not contains("UU 13/2003")
    assert one(spark, "a; b ;nan;;", lambda t: F.array_join(m.targets(t), "|")) == "a|b"
    assert one(spark, "nilai 85 dari 100", m.judge_score) == 0.85 and one(spark, None, m.judge_score) == 0.5
    assert [one(spark, "", lambda t, v=v: m.quality_label(F.lit(v))) for v in (0.5, 0.7, 0.86, 2.0)] == ["poor", "fair", "excellent", None]


def test_domain(spark):
    says = lambda about, **k: one(spark, about, lambda t: q.in_domain(t, F.lit(""), F.lit(""), F.lit("PP"), F.lit("99"), **k))
    assert says("ketenagakerjaan") and says("") and not says("perizinan berusaha") and not says("peraturan terbaru")
    assert says("upah terbaru", word_boundary=True)


def test_words_are_fixed_piece_by_piece_as_in_the_whole(spark):
    """Pieces of words that meet over blanks and hyphens, in all cases, against the chain over the whole text."""
    random.seed(5)
    parts = ["RAT", "MAT", "rat{", "KNRJA", "Korja", "kEr'aan", "PRES", "IDEN", "MEWR", ":", "JUDKAN", "MEWU:", "KEHI1,", "ANGAN", "kehilangan", "MOR", "TAHUN", "tahunan", "LIMA", "lIMA", "IIMA", "l|MA", "a|IMA", "-", "-LIMA", "LIMA-", "nomor", "N0MOR,", "RAHMATTUHAN", "lain", "x", "perpros."]
    texts = ["".join(random.choice(parts) + random.choice([" ", " ", "\n", "  ", " \n", ""]) for _ in range(random.randint(1, 12))) for _ in range(1500)]
    steps = []
    for pattern, to in rules.WORD_FIXES:
        upper, lower, title = (tx._cased(pattern, how) for how in ("upper", "lower", "title"))
        steps += [(upper, to), (lower, to.lower()), (title, to.title()), (f"(?!{upper}|{lower}|{title})(?i:{pattern})", to)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fix_words(F.col("t")).alias("a"), tx.chain(F.col("t"), *steps).alias("b")).collect()
    assert [(r["t"], r["a"]) for r in rows] == [(r["t"], r["b"]) for r in rows] and any(r["t"] != r["b"] for r in rows)


def test_hits_of_several_targets_at_once(spark):
    refs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r).alias("reference"), F.lit("").alias("source_file"), F.lit(p).alias("pasal_id"), F.lit("").alias("text_preview")) for i, (r, p) in enumerate([("lain", "Pasal 2"), ("Peraturan Pemerintah No. 35 Tahun 2021", "Pasal 3"), ("lain", "Pasal 40")], 1)])
    hits = m.target_hits(refs, F.array(F.lit("PP 35/2021")), F.array(F.lit("Pasal 40"), F.lit("")))
    got = one(spark, "", lambda t: F.struct(m.first_rank(hits, 0).alias("a"), m.first_rank(hits, 1).alias("b"), m.hits_at(hits, 3, which=(0, 1)).alias("c"), m.hits_at(hits, 2).alias("d")))
    assert (got["a"], got["b"], got["c"], got["d"]) == (2, 3, 2 / 3, 0.5)


def test_a_title_is_looked_for_once(spark):
    """The candidates of a subject are not written out again for each bound and each check that they match."""
    assert str(md.subject(F.col("t"))).count("{0,160}") == 1
    assert str(md.regulation(F.lit("x.pdf"), F.col("t"))).count("{0,160}") == 1
