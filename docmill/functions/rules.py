"""Word lists, patterns, thresholds and weights that results must agree on.

They are data; the functions and operators build their expressions from them.
"""

# Thresholds of usable extractions.
MIN_CHARS, MIN_PASAL, MAX_NOISE, MAX_ARTIFACTS = 300, 1, 0.18, 500

# Rank of a regulation type in the legal hierarchy.
HIERARCHY = {
    "Undang-Undang": 1,
    "Peraturan Pemerintah Pengganti Undang-Undang": 1,
    "Peraturan Pemerintah": 2,
    "Peraturan Presiden": 3,
    "Peraturan Menteri Ketenagakerjaan": 4,
    "Peraturan Menteri": 4,
    "Keputusan Presiden": 4,
    "Keputusan Menteri": 5,
    "Instruksi Presiden": 5,
    "Putusan MK": 1,
    "Putusan MA": 3,
    "Putusan": 3,
    "Unknown": 99,
}
UNKNOWN_HIERARCHY = 99

# Misread words and what they stand for.
WORD_FIXES = (
    (r"\bRAT[\{\(]?\s*MAT\b", "RAHMAT"),
    (r"\bRAIIMAT\b", "RAHMAT"),
    (r"\bRAHMATTUHAN\b", "RAHMAT TUHAN"),
    (r"\bTUIIAN\b", "TUHAN"),
    (r"\bKNRTU\b", "KARTU"),
    (r"\bKNRJA\b", "KERJA"),
    (r"\bK[EO]RJA\b", "KERJA"),
    (r"\bK[EO]RJAAN\b", "KERJAAN"),
    (r"\bK[EO]R['`^]?AAN\b", "KERJAAN"),
    (r"\bP[EO]K[EO]RJA\b", "PEKERJA"),
    (r"\bP[EO]K[EO]RJAAN\b", "PEKERJAAN"),
    (r"\bP[EO]K[EO]R['`^]?AAN\b", "PEKERJAAN"),
    (r"\bP[EO]K[EO]DA\b", "PEKERJA"),
    (r"\bMEWR\s*:\s*JUDKAN\b", "MEWUJUDKAN"),
    (r"\bMEW[RU][:\s]*JUDKAN\b", "MEWUJUDKAN"),
    (r"\bBURUII\b", "BURUH"),
    (r"\bKEHI[1IIL][,\.]?\s*ANGAN\b", "KEHILANGAN"),
    (r"\bKEHI[1IIL]ANGAN\b", "KEHILANGAN"),
    (r"\bPR[AO]KERJA\b", "PRAKERJA"),
    (r"\bPERPR[EO]S\b", "PERPRES"),
    (r"\bN[O0]M[O0]R\b", "NOMOR"),
    (r"\bM[O0]R\b(?=\s+TAHUN)", "NOMOR"),
    (r"\bPRES\s+IDEN\b", "PRESIDEN"),
    (r"\bLIMA\s*-\s*LIMA\b", "LIMA"),
    (r"\b[1Il|]{2}MA\s*-\s*LIMA\b", "LIMA"),
    (r"\b[1Il|]IMA\s*-\s*LIMA\b", "LIMA"),
)

# Regulation types by what names them; the first that matches counts.
REGULATION_TYPES = (
    (r"\bUNDANG[-\s]?UNDANG\b|\bUU\b", "Undang-Undang"),
    (r"\bPERATURAN\s+PEMERINTAH\s+PENGGANTI\s+UNDANG[-\s]?UNDANG\b|\bPERPPU\b", "Peraturan Pemerintah Pengganti Undang-Undang"),
    (r"\bPERATURAN\s+PEMERINTAH\b|\bPP\b", "Peraturan Pemerintah"),
    (r"\bPERATURAN\s+PRESIDEN\b|\bPERPRES\b", "Peraturan Presiden"),
    (r"\bPERATURAN\s+MENTERI\s+KETENAGAKERJAAN\b|\bPERMENAKER\b|\bPMNAKER\b", "Peraturan Menteri Ketenagakerjaan"),
    (r"\bPER[.\-\s]?\d{1,4}[/.\-\s]+MEN\b", "Peraturan Menteri"),
    (r"\bPERATURAN\s+MENTERI\b|\bPERMEN\b", "Peraturan Menteri"),
    (r"\bKEPUTUSAN\s+MENTERI\b|\bKEPMEN\b", "Keputusan Menteri"),
    (r"\bKEPUTUSAN\s+PRESIDEN\b|\bKEPPRES\b", "Keputusan Presiden"),
    (r"\bINSTRUKSI\s+PRESIDEN\b|\bINPRES\b", "Instruksi Presiden"),
    (r"\bPUTUSAN\s+MAHKAMAH\s+KONSTITUSI\b|\bPUTUSAN\s+MK\b", "Putusan MK"),
    (r"\bPUTUSAN\s+MAHKAMAH\s+AGUNG\b|\bPUTUSAN\s+MA\b", "Putusan MA"),
    (r"\bPUTUSAN\b", "Putusan"),
)

# Terms of quality scores.
LEGAL_TERMS = ("Pasal", "ayat", "huruf", "BAB", "Bagian", "Paragraf", "Menimbang", "Mengingat", "MEMUTUSKAN", "TENTANG")
OCR_ARTIFACTS = r"scbagai|scbagaimana|dalarn|dimak\s*sud|avat|ava\s*t|liuruf|pcr|kcb|sctiap|tcr|dcn|clan|h\.?uus|udarn"
ODD_CHARACTER = r"[^\w\s.,;:!?()\[\]{}'\"/\-+%=<>@#&*]"
MOJIBAKE = r"Â|â|\x{FFFD}|\\x[0-9a-fA-F]{2}"
PASAL_HEADING = r"^\s*Pasal\s+(?:\d+[A-Z]?|[IVXLCDM]+)\b"

# Dictum words that take the place of articles, in the order in which they are tried. The compounds stand before
# their first words, so a line with KEDUA BELAS is read whole (the other order would read it as KEDUA).
DICTUM = (r"KETIGA\s*BELAS", r"KEDUA\s*BELAS", "KESEBELAS", "KESEPULUH", "KESEMBILAN", "KEDELAPAN", "KETUJUH", "KEENAM", "KELIMA", "KEEMPAT", "KETIGA", "KEDUA", "KESATU", "PERTAMA")

# Lines that are no text: page numbers, letterheads, web stamps (upper case), serial stamps (upper case).
PAGE_NUMBER_LINE = r"\A-\s*\d+\s*-\z"
LETTERHEAD_LINE = r"\A(?:PRES\s*I?DEN|REPUBLIK\s+INDONESIA)\z"
WEB_STAMP = r"\bJDIH\b|WWW\."
SERIAL_STAMP_LINE = r"\A(?:SK|SL|S1|SI)[(<]?\s*NO\s+[A-Z0-9\s./|'-]+\z"

# Where a body begins, its explanation and its appendix begin, and headings that only close it.
BODY_START = r"(?i)(?:\A|\n)(?:BAB\s+I\b|Pasal\s+1\b|PERTAMA\b|KESATU\b)"
EXPLANATION = r"(?i)\bPENJELASAN\s+ATAS\b"
APPENDIX = (
    r"(?im)^\s*LAMPIRAN\s+(?:PERATURAN|UNDANG[-\s]?UNDANG|KEPUTUSAN|INSTRUKSI)\b",
    r"(?is)\bL\s*A\s*M\s*P[^\n]{0,40}?\b(?:PERATURAN|UNDANG[-\s]?UNDANG|KEPUTUSAN|INSTRUKSI)\b.{0,300}?\b(?:NOMOR|TENTANG)\b",
    r"(?im)^\s*L\s*A\s*M\s*P[^\n]{0,20}(?:\b[IVXLCDM]+\b|\b\d+\b)?\s*$(?=[\s\S]{0,1200}?\b(?:PERATURAN|UNDANG[-\s]?UNDANG|KEPUTUSAN|INSTRUKSI)\b[\s\S]{0,250}\b(?:NOMOR|TENTANG)\b)",
)
STRUCTURAL = r"(?i)\A(?:BAB\s+(?:[IVXLCDM]+|\d+)|Bagian\s+Ke\w+|Paragraf\s+\w+)\z"
DEFINITIONS = r"(?is)\A\s*Dalam\s+(?:Peraturan|Undang-Undang|Keputusan|Instruksi|Peraturan\s+\w+)(?:\s+\w+){0,8}\s+ini\s+yang\s+dimaksud\s+dengan\s*:\s*"

# What an answer or a corrector's output is cleared of, in this order.
EMOJI = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]+"
ANSWER_STEPS = (
    (EMOJI, ""),
    (r"(?s)```.*?```", ""),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"(?m)^#{1,6}\s*", ""),
    (r"(?i)\s*\[(?:R\d+(?:\s*,\s*)?)+\]", ""),
    (r"(?i)(?:\n\s*Referensi\s*:\s*)[\s\S]*\z", ""),
    (r"\n\s*[-=*]{3,}\s*\n", "\n"),
)
OUTPUT_STEPS = ((r"(?i)\A```(?:text)?\s*", ""), (r"\s*```\z", ""), (r"(?i)\A\s*(?:Hasil koreksi|Teks hasil koreksi)\s*:\s*", ""))

# Keywords that scans space out.
SPACED_WORDS = ("Pasal", "BAB", "TENTANG", "MEMUTUSKAN")

# Query expansion: any trigger in the query adds the expansion.
EXPANSIONS = (
    (("pelanggaran berat", "mendesak", "bersifat mendesak"), "pelanggaran bersifat mendesak uang pisah uang penggantian hak tidak mendapat pesangon tidak mendapat uang penghargaan masa kerja"),
    (("surat peringatan", "sp pertama", "sp kedua", "sp ketiga"), "pelanggaran ketentuan surat peringatan pertama kedua ketiga pesangon nol koma lima uang penghargaan masa kerja uang penggantian hak"),
    (("pesangon", "phk", "pemutusan hubungan kerja"), "pemutusan hubungan kerja uang pesangon uang penghargaan masa kerja uang penggantian hak hak akibat pemutusan hubungan kerja"),
    (("pkwt", "kontrak"), "perjanjian kerja waktu tertentu kompensasi pkwt jangka waktu perpanjangan pembaruan"),
    (("alih daya", "outsourcing", "outsourced"), "alih daya perusahaan alih daya pekerja buruh hubungan kerja perlindungan upah kesejahteraan"),
    (("upah", "gaji", "tunjangan"), "upah gaji tunjangan tetap struktur skala upah upah minimum pembayaran upah"),
)
SERVICE_EXPANSIONS = (
    (("pelanggaran berat", "mendesak", "bersifat mendesak"), "pelanggaran bersifat mendesak uang pisah uang penggantian hak tidak mendapat pesangon"),
    (("pesangon", "phk", "pemutusan hubungan kerja"), "pemutusan hubungan kerja uang pesangon uang penghargaan masa kerja uang penggantian hak"),
    (("pkwt", "kontrak"), "perjanjian kerja waktu tertentu kompensasi pkwt jangka waktu"),
    (("alih daya", "outsourcing"), "alih daya perusahaan alih daya hubungan kerja perlindungan upah"),
    (("upah", "gaji", "tunjangan"), "upah gaji tunjangan tetap upah minimum pembayaran upah"),
)

# Employment domain.
DOMAIN_POSITIVE = (
    "ketenagakerjaan", "tenaga kerja", "pekerja", "buruh", "hubungan kerja",
    "perjanjian kerja", "pemutusan hubungan kerja", "phk", "pesangon",
    "upah", "pengupahan", "pensiun", "jaminan sosial", "jaminan kerja",
    "alih daya", "outsourcing", "pkwt", "pkwtt", "serikat pekerja",
    "pengusaha", "perusahaan alih daya", "perlindungan pekerja",
    "waktu kerja", "cuti", "k3", "keselamatan kerja", "cipta kerja",
)
DOMAIN_NEGATIVE = (
    "perizinan berusaha", "oss", "risiko usaha", "izin usaha", "nib",
    "investasi", "badan usaha", "penyelenggaraan usaha", "sistem perizinan",
    "rba", "risk based approach", "sektor usaha", "kbli",
    "penyelenggaraan pemerintahan", "administrasi pemerintahan",
    "sop administrasi", "pelayanan publik",
)
DOMAIN_REGULATIONS = (("pp", "35"), ("pp", "36"), ("pp", "34"), ("pp", "45"), ("uu", "13"), ("uu", "6"), ("uu", "24"), ("uu", "1"), ("uu", "21"), ("permen", "5"), ("permen", "6"))

STOPWORDS = (
    "yang", "dan", "atau", "karena", "dengan", "untuk", "pada", "dalam",
    "jika", "maka", "dari", "berapa", "apakah", "bagaimana", "dimana",
    "kapan", "siapa", "pekerja", "buruh", "pengusaha", "perusahaan", "hak",
    "nya", "itu", "ini", "ada", "dapat", "bisa", "oleh", "ke", "di", "atas",
)
GENERIC_TERMS = ("pesangon", "phk", "pemutusan", "hubungan", "kerja")

# Retrieval.
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 1.0, 0.7
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Citations in answers.
CITATION = r"(?i)(Undang-Undang|Peraturan Pemerintah|Peraturan Presiden|Peraturan Menteri(?:\s+Ketenagakerjaan)?|UU|PP|Perpres|Permen)\s+(?:No\.?|Nomor)?\s*([A-Za-z0-9./-]+)\s+Tahun\s+(\d{4})"
OUT_OF_SCOPE = "tidak tersedia dalam database"
NO_CONTEXT_ANSWER = "Maaf, informasi tersebut tidak tersedia dalam database hukum ketenagakerjaan yang saya miliki."

# Weights of the overall score, and its labels by upper bound.
SCORE_WEIGHTS = {
    "llm_judge_score": 0.20,
    "semantic_similarity": 0.15,
    "keyword_coverage": 0.15,
    "retrieval_citation_coverage": 0.15,
    "retrieval_article_hit": 0.10,
    "retrieval_law_hit": 0.05,
    "answer_citation_hit": 0.10,
    "article_hit_at_3": 0.05,
    "article_mrr": 0.03,
    "precision_at_3": 0.01,
    "answer_length_score": 0.01,
}
QUALITY_BINS = ((-0.01, 0.50, "poor"), (0.50, 0.70, "fair"), (0.70, 0.85, "good"), (0.85, 1.01, "excellent"))

# Titles that the download filter leaves out.
EXCLUDED_TITLES = ("perubahan atas", "perubahan undang", "perubahan pertama", "perubahan kedua", "penetapan peraturan pemerintah pengganti", "pembentukan provinsi", "pembentukan daerah")
FOLDERS = (("undang-undang", "data/pdf/undang-undang"), ("peraturan pemerintah", "data/pdf/peraturan-pemerintah"), ("peraturan presiden", "data/pdf/peraturan-presiden"))

# What makes a chunk a candidate for typo correction.
SUSPECT_TEXT = (
    r"o/o\b",
    r"olo\b",
    r"\b2[oO][0-9IlL|]{2}\b",
    r"\b(19|20)[0-9OoIlL|]{2}\b",
    r"\bPRES\s+IDEN\b",
    r"\bRAT[\{\(]?\s*MAT\b",
    r"\bMEWR\s*:\s*JUDKAN\b",
    r"\bKNRTU\b",
    r"\bKEHI[1IIL][,\.]?\s*ANGAN\b",
    r"\bP[EO]K[EO]R['`^]?AAN\b",
    r"\b[1Il|]{2}MA\s*-\s*LIMA\b",
    r"['`^](?=[A-Za-z])",
    r"[{}~]",
)
