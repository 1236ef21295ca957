"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = sorted(p.stem for p in Path(SF).glob("*.parquet"))
pytestmark = pytest.mark.skipif(not TABLES, reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def ordered(df):
    columns = sorted(df.columns)
    keys = [c for c in columns if df[c].dtype.kind != "f"] + [c for c in columns if df[c].dtype.kind == "f"]
    return df[columns].sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ours = ordered(QUERIES[name](spark, SF).toPandas())
    theirs = ordered(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            np.testing.assert_allclose(ours[c], theirs[c], rtol=0, atol=1.5e-5, equal_nan=True)
        else:
            assert (ours[c] == theirs[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    result = entry.entry(spark)
    assert result.columns == ["vec_id", "label", "pred_label"]
    assert result.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
