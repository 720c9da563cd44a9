"""Documents without lang, source or n_chars, of which some blocks have neither text nor place, against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import plain, rows_of

LINES = ["Heading one", "two lines.", "three", "four", "five", "six.", "seven", "eight."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("missing")
    rows = []
    for i in range(60):
        lines = (LINES * 2)[: 2 if i % 6 == 0 else 9 + i % 8]
        if len(lines) % 8 in (2, 6):  # a block that may be missing ends the page: what stands before it is finished
            lines[-2] = "it ends here."
        text = "\n".join(lines)
        rows.append((i, text, None if i % 4 == 1 else "en", None if i % 3 == 0 else "web", None if i % 5 == 0 else len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["cross_page_merge", "detected_boxes", "export_html"])
def test_missing_blocks_are_those_of_sql(spark, folder, name):
    names, got = rows_of(entry.queries()[name](spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    order = [cols.index(c) for c in sorted(cols)]
    assert names == sorted(cols) and got and got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_only_a_newline_ends_a_line(spark):
    from pyspark.sql import functions as F

    from quire.functions.classify import structure_kind

    rows = [("Key: value x\ry",), ("Key: value u v",), ("Key: value n\x85l",), ("Key: value",), ("Key: value\nmore text",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(structure_kind(F.col("t"))).collect()]
    assert got[:4] == ["key_value"] * 4 and got[4] != "key_value"
