"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest
from conftest import same_rows

from tidewind import oracle, queries

ORACLE = oracle.oracle_sql()
#: Queries without SQL: content hashes and trained models.
BEYOND_SQL = {"frame_fingerprint", "table_hashes", "trained_model_ranking", "model_lightgbm", "model_random_forest", "model_adaboost", "model_xgboost"}


def test_every_query_is_accounted_for():
    assert set(queries.queries()) - set(ORACLE) == BEYOND_SQL
    assert not set(ORACLE) - set(queries.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), ORACLE[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    got = {r["regime"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert got == {"LowVol": 1000, "HighVol": 1017, "unlabelled": 272}


def test_fingerprint_ignores_order_and_sees_changes(spark, sf_dir):
    from pyspark.sql import functions as F

    from tidewind.operators.quality import fingerprint
    from tidewind.sources.bars import lineitem_bars

    b = lineitem_bars(spark, sf_dir)
    one = fingerprint(b).first()
    assert fingerprint(b.orderBy(F.rand(1))).first() == one
    assert fingerprint(b.withColumn("Close", F.col("Close") + 1e-9)).first() != one
