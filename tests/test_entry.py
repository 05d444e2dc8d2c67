import importlib.util

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not (n[0] == "p" and n[1:2].isdigit()) or n.startswith("p6_")))
def test_sql_agrees(spark, sf, name):
    """Every core query against its SQL on the smallest tables."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_core_stands_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("quarrymill").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarrymill.llm" not in p.read_text(), p
