"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/**/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>") else round(float(x), 6) if isinstance(x, float) else x
    return sorted(repr(tuple(clean(x) for x in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["ward_sizes", "compression_ratio", "change_point_sessions"])
def test_rows_only(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_upsert_with_part_numbers_of_suppliers(spark, tmp_path):
    """Part numbers beyond a million are not those of suppliers."""
    import __spark_entry__ as entry

    spark.createDataFrame([(7, "small", 3), (1_000_007, "small", 3), (1_000_008, "large", 30)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "s7"), (8, "s8")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, entry.queries()["upsert_transaction"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    for t in ("part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(c.execute(entry.oracle_sql()["upsert_transaction"]).fetchall()) and len(got) == 7
