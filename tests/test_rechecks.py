"""Features recomputed by hand and canonical rows read again: planted faults must be seen."""

import pytest
from pyspark.sql import functions as F

from tidewind.operators import quality
from tidewind.operators.features import canonical, prepared
from tidewind.sources.bars import flatten_names, lineitem_bars, provider_bars, read_csv, write_bars_csv


@pytest.fixture(scope="module")
def bars(spark, sf_dir):
    from tidewind.operators import tables

    return spark.read.parquet(tables.write(lineitem_bars(spark, sf_dir)))


def test_planted_faults_are_seen(spark, bars):
    rows = prepared(bars)
    good = quality.feature_manual_check(bars).collect()
    assert len(good) == 15 and all(r["agrees"] for r in good) and any(r["by_hand"] is None for r in good)
    t = "historical_volatility_threshold_20d"
    wrong = rows.withColumns({"trend_60d": F.col("trend_60d") + 1e-6, t: F.when(F.col(t).isNotNull(), F.col("volatility_20d"))})
    bad = {r["feature"]: r["agrees"] for r in quality.feature_manual_check(bars, rows=wrong).where("row_idx > 1000").collect()}
    assert not bad["trend_60d"] and not bad[t] and bad["return_5d"]
    lost = quality.feature_manual_check(bars, rows=rows.withColumn(t, F.lit(None).cast("double"))).where((F.col("feature") == t) & (F.col("row_idx") > 1000))
    assert lost.count() > 0 and lost.where("agrees").count() == 0


def test_few_rows_have_nothing_to_check_by_hand(bars):
    few = bars.orderBy("Date").limit(30)
    got = quality.feature_manual_check(few).collect()
    assert {r["row_idx"] for r in got} == {15, 20} and all(r["agrees"] for r in got)
    assert quality.feature_manual_check(bars.limit(0)).count() == 0


def test_round_trip_sees_changed_missing_and_renamed(spark, bars, tmp_path):
    rows = canonical(prepared(bars))
    write_bars_csv(rows, str(tmp_path / "c"))
    again = read_csv(spark, str(tmp_path / "c"), rows.schema)
    got = quality.reload_check(rows, again).collect()
    assert len(got) == len(rows.columns) - 1 and not any(r["n_different"] for r in got)
    first = rows.agg(F.min("Date")).first()[0]
    other = again.withColumns({"trend_10d": F.when(F.col("Date") == first, F.col("trend_10d") + 1e-9).otherwise(F.col("trend_10d")), "regime": F.when(F.col("Date") != first, F.col("regime"))})
    assert {r["column_name"] for r in quality.reload_check(rows, other).collect() if r["n_different"] == 1} == {"trend_10d", "regime"}
    assert {r["n_different"] for r in quality.reload_check(rows, again.where(F.col("Date") != first)).collect()} == {1}
    with pytest.raises(quality.ValidationError, match="columns"):
        quality.reload_check(rows, again.withColumnRenamed("regime", "label"))
    with pytest.raises(Exception, match="(?i)header|column"):
        read_csv(spark, str(tmp_path / "c"), rows.withColumnRenamed("regime", "label").schema).collect()


def test_a_two_level_header_keeps_the_fields():
    assert flatten_names([("Open", "T"), ("Close", "T")]) == ["Open", "Close"]


def test_provider_answers_for_a_ticker_and_dates(spark, sf_dir):
    path = f"{sf_dir}/lineitem.parquet"
    net, gross = (provider_bars(spark, path, 1, "1996-01-01", "1997-01-01", auto_adjust=a) for a in (True, False))
    both = net.join(gross.toDF("Date", *[f"g{c}" for c in gross.columns[1:]]), "Date").collect()
    assert both and all(r["Low"] <= r["gLow"] and r["High"] <= r["gHigh"] and r["Volume"] == r["gVolume"] and r["Date"].year == 1996 for r in both)
    assert any(r["Close"] < r["gClose"] for r in both)
    with pytest.raises(ValueError, match="no rows"):
        provider_bars(spark, path, 1, "1950-01-01", "1951-01-01")


def test_dictionary_profile_tells_what_is_amiss(spark):
    dictionary = spark.createDataFrame([("a", "double", "x"), ("b", "string", " "), ("gone", "date", "x")], "column string, dtype string, unit string")
    rows = spark.createDataFrame([(1.0, 2, None), (None, 3, "z")], "a double, b int, `c.d` string")
    got = {r["column"]: tuple(r)[1:] for r in quality.dictionary_profile(dictionary, rows).collect()}
    assert got == {"a": (1, 0, True, 2, 1), "b": (1, 1, False, 2, 0), "c.d": (0, 0, False, 2, 1), "gone": (1, 0, False, None, None)}
    none = {r["column"]: r["n_rows"] for r in quality.dictionary_profile(dictionary, rows.limit(0)).collect()}
    assert none == {"a": 0, "b": 0, "c.d": 0, "gone": None}


def test_provenance_digest_ignores_order_and_sees_changes(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir).limit(200).cache()
    one = quality.provenance_record(b).first()
    assert quality.provenance_record(b.repartition(7)).first() == one and one["columns"] == "Date,Open,High,Low,Close,Volume"
    other = quality.provenance_record(b.withColumn("Close", F.col("Close") + 0.01)).first()
    assert other["digest"] != one["digest"] and other["n_rows"] == one["n_rows"]
    assert quality.provenance_record(b.limit(0)).first()["n_rows"] == 0
    b.unpersist()
