"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from statweave.plans import catalogue, recorded  # noqa: F401  registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, (float, bool)) and float(v).is_integer() else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, small, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    want = db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, small, name):
    assert len(catalogue.QUERIES[name](spark, small).columns) > 0 and catalogue.QUERIES[name](spark, small).count() > 0
