"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from boxwise.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations pages benchmark".split()


def _text(x) -> str:
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(int(x))
    return f"{float(x):.4f}" if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float")) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got)
    assert rows(got) == rows(wanted)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_no_nested_loops(spark, sf_dir):
    for name in ("nearest_label_value", "column_bucket_assign", "spatial_dedup", "region_overlap", "receipt_region_filter", "column_cells", "row_words", "footer_candidates"):
        assert "NestedLoop" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name
