"""Documents that hold what a rule looks for by chance give the rows of the SQL, as all others do."""

import duckdb
import pytest

import __spark_entry__

TEXTS = ["un dans pasai tion", "Pasai de korja nomor\nb a b bab ii", "\n\nsi no abc pasal iv", "", "Tentang Perpros kerjaan 12 olo"]


@pytest.mark.parametrize("name", ["misread_words", "common_fixes", "legal_normalized", "full_clean", "model_output", "finalized_chunks", "typo_suspects"])
def test_query(spark, tmp_path, name):
    # a stamp-like line, a spaced keyword of single letters and a break at the start are beyond what parted() and the lead-in of model_output keep
    left = {"finalized_chunks": (1, 2), "model_output": (2,)}.get(name, ())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'fr', 'src1', ?)", [(i, t, len(t)) for i, t in enumerate(TEXTS) if i not in left])
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    con.register("got", df.toPandas())
    con.execute(f"create table wanted as {__spark_entry__.oracle_sql()[name]}")
    columns = ", ".join(df.columns)
    assert con.execute(f"(select {columns} from got except all select {columns} from wanted) union all (select {columns} from wanted except all select {columns} from got)").fetchall() == []
