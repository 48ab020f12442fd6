"""What a regulation is called, numbered and about, from its head text and file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, text as tx
from .quality import any_of

YEAR = r"(19\d{2}|20\d{2})"
TITLE_END = r"(?i)\b(?:Menimbang|Mengingat|MEMUTUSKAN|Menetapkan|Pasal\s+1)\b"


def first_match(text: Column, named) -> Column:
    """Label of the first pattern that matches, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(named):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(label)).otherwise(out)
    return out


def group(text: Column, pattern: str, n: int) -> Column:
    """Group n of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def head_of(text: Column, size: int = 10_000) -> Column:
    return F.regexp_replace(tx.normalized(F.left(text, F.lit(size))), r"(?U)\s+", " ")


def title_zone(head: Column) -> Column:
    return F.split(head, TITLE_END, 2)[0]


def regulation_type(filename: Column, head: Column) -> Column:
    """Ministerial titles, else the formal title, else the file name, else the first type the head names."""
    formal = (
        r"(?i)\b(UNDANG[-\s]?UNDANG|PERATURAN\s+PEMERINTAH\s+PENGGANTI\s+UNDANG[-\s]?UNDANG|PERATURAN\s+PEMERINTAH|PERATURAN\s+PRESIDEN|"
        r"PERATURAN\s+MENTERI\s+KETENAGAKERJAAN|PERATURAN\s+MENTERI|KEPUTUSAN\s+MENTERI|KEPUTUSAN\s+PRESIDEN|INSTRUKSI\s+PRESIDEN|"
        r"PUTUSAN\s+MAHKAMAH\s+KONSTITUSI|PUTUSAN\s+MAHKAMAH\s+AGUNG)(?:\s+REPUBLIK\s+INDONESIA)?\s+(?:NOMOR|NO\.?)\b"
    )
    name = F.regexp_replace(F.translate(filename, "_-", "  "), r"(?i)\b(PERMEN)(?=\d)", "$1 ")
    return F.coalesce(
        F.when(head.rlike(r"(?i)\bPERATURAN\s*MENTERI\s*KETENAGAKERJAAN\b.*?\bNOMOR\b"), "Peraturan Menteri Ketenagakerjaan"),
        F.when(head.rlike(r"(?i)\bPERATURAN\s*MENTERI\b.*?\bNOMOR\b"), "Peraturan Menteri"),
        tx.bind(group(head, formal, 1), lambda g: first_match(g, rules.REGULATION_TYPES)),
        tx.bind(name, lambda n: first_match(n, rules.REGULATION_TYPES)),
        first_match(head, rules.REGULATION_TYPES),
        F.lit("Unknown"),
    )


def _plain(number: Column) -> Column:
    return number.try_cast("int").cast("string")


def number_and_year_of_filename(filename: Column) -> Column:
    """struct(nomor, year): ministerial form, slashed form, digits with the year attached, then looser forms."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    old = rf"(?i)\bPER[.\-\s]?(\d{{1,4}})[-_/.\s]+MEN[-_/.\s]+([IVX]{{1,5}})[-_/.\s]+{YEAR}\b"
    name = tx.number_token(F.regexp_replace(stem, r"[_\-\s]+", " "))
    slashed = rf"\b([A-Za-z0-9.-]+(?:/[A-Za-z0-9.-]+){{1,3}}/{YEAR})\b"
    tries = [
        (rf"(?i)\b(?:PERPRES|PERMEN|PP|UU)?\D*(\d{{1,3}}){YEAR}\b", 1, 2),
        (rf"(?i){YEAR}\D*(\d{{1,4}})\b", 2, 1),
        (rf"(?i)\b(?:NOMOR|NO)?\D*(\d{{1,4}})\D*(?:TAHUN|TH)\D*{YEAR}\b", 1, 2),
        (rf"(?i)\bNO(?:MOR)?\D*(\d{{1,4}})\D*{YEAR}\b", 1, 2),
    ]
    whole = F.concat(F.lit("PER."), _plain(group(stem, old, 1)), F.lit("/MEN/"), F.upper(group(stem, old, 2)), F.lit("/"), group(stem, old, 3))
    nomor = F.coalesce(whole, group(name, slashed, 1), *[_plain(group(name, p, n)) for p, n, _ in tries])
    year = F.coalesce(group(stem, old, 3), group(name, slashed, 2), *[group(name, p, y) for p, _, y in tries])
    return F.struct(nomor.alias("nomor"), year.try_cast("int").alias("year"))


def number_and_year_of_title(zone: Column) -> Column:
    """struct(nomor, year) from the title zone: slashed form, else `NOMOR n TAHUN y`."""
    slashed = rf"(?i)\b(?:NOMOR|NO\.?)\s*:?\s*([A-Za-z0-9.-]+(?:/[A-Za-z0-9.-]+){{1,3}}/{YEAR})\b"
    plain = rf"(?i)\b(?:NOMOR|NO\.?)\s*([0-9A-Za-z./-]+)\s*(?:TAHUN|TH\.?)\s*{YEAR}\b"
    trimmed = lambda c: tx.strip_chars(c, "./- ")
    return F.struct(
        F.coalesce(trimmed(group(zone, slashed, 1)), trimmed(group(zone, plain, 1))).alias("nomor"),
        F.coalesce(group(zone, slashed, 2), group(zone, plain, 2)).try_cast("int").alias("year"),
    )


def subject(head: Column, longest: int = 700) -> Column:
    """What the regulation is about, upper case: the title's TENTANG, the enacting clause's, else the longest candidate."""
    tidy = lambda c: tx.strip_chars(tx.compact_spaces(c), " .;:")
    # what does not match is empty, which is too short; a candidate is made once for both of its bounds
    fits = lambda c: tx.bind(c, lambda x: F.when(F.length(x).between(5, longest), x))
    title = r"(?i)\bNOMOR\b.{0,160}?\bTENTANG\s+(.*?)(?=\bDENGAN\s+RAH\s*MAT\b|\bPRESIDEN\s+REPUBLIK\b|$)"
    enacted = r"(?i)\bMenetap\w*\s*:\s*.*?\bTENTANG\s+(.*?)(?=\.?\s*\b(?:BAB\s+[IVXLCDM]+|Pasal\s+1)\b|\.|$)"
    anywhere = (
        r"(?i)\bTENTANG\s+(.*?)(?=\bDENGAN\s+RAH\s*MAT\b|\bPRESIDEN\s+REPUBLIK\b|\bMenimbang\b|\bMengingat\b|\bMEMUTUSKAN\b|\bBAB\s+[IVXLCDM]+\b|\bPasal\s+1\b)"
    )
    lead = r"(?i)^(?:PERATURAN|UNDANG-UNDANG|KEPUTUSAN|INSTRUKSI).*?\bTENTANG\s+"

    def of_flat(flat: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(anywhere), F.lit(1)), lambda c: tx.strip_chars(F.regexp_replace(tx.compact_spaces(c), lead, ""), " .;:")), lambda c: F.length(c).between(5, longest))
        longest_of = F.array_max(F.transform(found, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("at"), c.alias("c"))))["c"]
        return F.upper(F.coalesce(fits(tidy(F.regexp_extract(title_zone(flat), title, 1))), fits(tidy(F.regexp_extract(flat, enacted, 1))), longest_of))

    return tx.bind(F.regexp_replace(head, r"(?U)\s+", " "), of_flat)


def hierarchy(regulation_type_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in rules.HIERARCHY.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, regulation_type_), F.lit(rules.UNKNOWN_HIERARCHY))


def regulation(path: Column, text: Column) -> Column:
    """struct of the document's metadata; unknown parts get their sentinels."""
    filename = F.regexp_replace(path, r"^.*/", "")

    def of_head(head: Column) -> Column:
        parts = F.struct(tx.bind(title_zone(head), number_and_year_of_title).alias("titled"), number_and_year_of_filename(filename).alias("named"), regulation_type(filename, head).alias("kind"), head.alias("head"))
        return tx.bind(parts, of_parts)

    def of_parts(p: Column) -> Column:
        own = p["titled"]["nomor"]
        poor = own.isNull() | (own == "") | ~own.rlike(r"\d") | F.upper(own).isin("MOR", "NOR", "NOMOR", "NO", "UNKNOWN")
        nomor = F.when(poor, F.coalesce(p["named"]["nomor"], own)).otherwise(own)
        year = F.coalesce(F.nullif(p["titled"]["year"], F.lit(0)), p["named"]["year"], F.lit(0))
        kind = F.when(nomor.rlike(r"(?i)\bPER[.\-/]?\d{1,4}.*\bMEN\b"), "Peraturan Menteri").otherwise(p["kind"])
        ministry = p["head"].rlike(r"(?i)\bMENTERI\s+(?:TENAGA\s+KERJA|KETENAGAKERJAAN|TENAGA\s+KERJA\s+DAN\s+TRANSMIGRASI)\b")
        kind = F.when(ministry & kind.isin("Unknown", "Undang-Undang", "Peraturan Menteri"), "Peraturan Menteri Ketenagakerjaan").otherwise(kind)
        return tx.bind(F.struct(kind.alias("kind"), nomor.alias("nomor"), year.alias("year"), p["head"].alias("head")), of_known)

    def of_known(p: Column) -> Column:
        kind, nomor, year = p["kind"], p["nomor"], p["year"]
        return F.struct(
            kind.alias("regulation_type"),
            hierarchy(kind).alias("regulation_hierarchy"),
            F.coalesce(F.nullif(nomor, F.lit("")), F.lit("Unknown")).alias("nomor"),
            F.coalesce(subject(p["head"]), F.lit("Unknown")).alias("tentang"),
            year.alias("year"),
            year.alias("publication_year"),
            F.lit("Berlaku").alias("active_status"),
            filename.alias("source_file"),
            path.alias("source_path"),
            F.lit("pymupdf_pdfplumber").alias("extractor"),
            F.lit("pasal").alias("chunk_level"),
        )

    return tx.bind(head_of(text), of_head)


RENAMES = (("undang-undang", "UU"), ("peraturan pemerintah", "PP"), ("peraturan presiden", "PERPRES"), ("peraturan menteri", "PERMEN"))


def renamed(first_page: Column) -> Column:
    """struct(doc_type, filename) of a downloaded file, from its first page; null where it cannot be told."""
    t = F.lower(F.regexp_replace(first_page, r"(?U)\s+", " "))
    has = lambda w: F.contains(t, F.lit(w))
    tests = (has("undang-undang") & has("republik indonesia"), has("peraturan pemerintah"), has("peraturan presiden"), any_of(t, ("peraturan menteri", "keputusan menteri")))
    kind = prefix = F.lit(None).cast("string")
    for test, (name, short) in reversed(list(zip(tests, RENAMES, strict=True))):
        kind, prefix = F.when(test, F.lit(name)).otherwise(kind), F.when(test, F.lit(short)).otherwise(prefix)
    form = r"(?:nomor|no\.?)\s*([0-9a-z./-]+)\s*(?:tahun|thn|th\.?)\s*(\d{4})"
    nomor = F.translate(F.upper(tx.strip_chars(group(t, form, 1), "./-")), " /", "__")
    return F.struct(kind.alias("doc_type"), F.concat(prefix, F.lit("_Nomor_"), nomor, F.lit("_Tahun_"), group(t, form, 2), F.lit(".pdf")).alias("filename"))


def folder(page_text: Column) -> Column:
    """Target folder of a detail page, null where none of the types is named."""
    t = F.lower(page_text)
    return F.coalesce(*[F.when(F.contains(t, F.lit(k)), F.lit(v)) for k, v in rules.FOLDERS])


# ---------------------------------------------------------------- citations


def citation(regulation_type_: Column, nomor: Column, year: Column, pasal: Column) -> Column:
    return F.concat(regulation_type_, F.lit(" No. "), nomor, F.lit(" Tahun "), year.cast("string"), F.lit(", "), pasal)


def compact_citation(meta: Column, stored: Column | None = None) -> Column:
    """The stored citation, else one from what is known of type, number, year and article."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    nomor, year, pasal = text(meta["nomor"]), text(F.coalesce(F.nullif(meta["publication_year"], F.lit(0)), meta["year"])), text(meta["pasal_id"])
    head = F.concat_ws(" ", F.coalesce(text(meta["regulation_type"]), F.lit("Aturan")), F.when(F.lower(nomor) != "unknown", F.concat(F.lit("No. "), nomor)), F.when(year != "0", F.concat(F.lit("Tahun "), year)))
    made = F.concat_ws(", ", head, pasal)
    if stored is None:
        return made
    return F.coalesce(F.when(F.lower(text(stored)) != "unknown", text(stored)), made)


def display_text(meta: Column, ctx: Column, pasal: Column, content: Column) -> Column:
    """Heading, section lines that exist, article, content."""
    header = F.concat(meta["regulation_type"], F.lit(" No. "), meta["nomor"], F.lit(" Tahun "), meta["publication_year"].cast("string"))
    section = lambda name: F.when(ctx[name] != "", F.concat_ws(" - ", ctx[name], F.nullif(ctx[name + "_title"], F.lit(""))))
    return F.concat_ws("\n", header, section("bab"), section("bagian"), section("paragraf"), pasal, content)
