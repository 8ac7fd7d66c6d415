import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(root / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no generated tables here")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f[: -len('.parquet')]} as select * from '{small}/{f}'")
    return con


def norm(v):
    import datetime
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert mine == theirs
