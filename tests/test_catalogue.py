"""Every registered query over the smallest driver tables, against its SQL in DuckDB."""

import duckdb
import pytest

from strandwise.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_alike_twice(spark, name):
    f = catalogue.QUERIES[name]
    first = rows(f(spark, DATA).toPandas())
    assert first and first == rows(f(spark, DATA).toPandas())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["relation", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_needs_the_llm_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import .*\bllm\b|\bllm\b.* import", p.read_text()), p
