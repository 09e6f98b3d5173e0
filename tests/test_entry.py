from pathlib import Path

import pytest

import __spark_entry__ as E


def test_names_and_entry(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    if Path("/root/testdata/sf0.001").exists():
        assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["top_n_categories", "nearest_link", "locf_fill", "rebalance_topk"])
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(E.oracle_sql()[name])
    cols = sorted(want.columns)
    got = E.queries()[name](spark, d)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, ([r[c] for c in cols] for r in got.collect()))) == sorted(repr(list(r)) for r in want.select(", ".join(cols)).fetchall())
