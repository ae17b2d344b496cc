from __future__ import annotations

import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("daybook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm_value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat") and not isinstance(v, str):
        s = str(v)
        return s[:10] if s[10:].strip(" 0:") == "" else s
    return v


def rows_of(df_rows, cols, order):
    idx = [cols.index(c) for c in order]
    return sorted((tuple(norm_value(r[i]) for i in idx) for r in df_rows), key=repr)


def assert_same(spark_df, duck_rel):
    cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    ocols = duck_rel.columns
    exp = duck_rel.fetchall()
    assert sorted(cols) == sorted(ocols), (cols, ocols)
    a = rows_of(got, cols, cols)
    b = rows_of(exp, ocols, cols)
    assert a == b, (set(a) - set(b), set(b) - set(a))
