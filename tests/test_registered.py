import importlib.util
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SLOW = {"graph_forward_closure"}


def test_every_statement_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_training_data_operators():
    from codeloom import catalog

    assert not any("llm" in f.__module__ for f in catalog.queries().values())
    if importlib.util.find_spec("codeloom.llm") is None:
        assert "pipeline" not in __spark_entry__.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


NAMES = sorted(n for n in __import__("codeloom.catalog", fromlist=["x"]).oracle_sql() if n not in SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_paragraphs_of_odd_texts_agree_with_their_sql(spark, tmp_path):
    texts = [None, "", "\n", "\n\n", "\n\n\n", "a\n\n\n\nb", "a\n\n\nb. ", "a. . b.  c", "a\r\n\r\nb", "a\n \nb", "a\0\n\nb", "é. ü\n\n", ". ", "x" * 20000 + "\n" * 20001]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(__spark_entry__.oracle_sql()["paragraphs"]).fetchall()
    got = __spark_entry__.queries()["paragraphs"](spark, str(tmp_path)).select("doc_id", "pieces").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
