import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def same_rows(spark_df, sql, folder):
    """Spark's rows against DuckDB's, in any order, floats to nine digits."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(folder):
        path = os.path.join(folder, file)
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    theirs = sorted(repr([cell(r[names.index(c)]) for c in order]) for r in got.fetchall())
    ours = sorted(repr([cell(r[c]) for c in order]) for r in spark_df.collect())
    assert ours == theirs
    return len(ours)
