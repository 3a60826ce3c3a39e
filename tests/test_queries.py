"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelworks.plans import registry

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return db


def aligned(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("Int"):  # nullable integers, which Spark gives as floats
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        if str(df[c].dtype).startswith(("datetime", "object", "str")) and df[c].notna().any() and hasattr(df[c].dropna().iloc[0], "year"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
    keys = [c for c in df.columns if df[c].dtype.kind not in "f"]
    return df.sort_values([*keys, *(c for c in df.columns if c not in keys)]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = aligned(registry.QUERIES[name](spark, DIR).toPandas())
    want = aligned(con.execute(registry.ORACLES[name]).df())
    assert len(got) and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["date", "security_id", "momentum_60", "momentum_5", "volatility_20", "adv20_amount", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
