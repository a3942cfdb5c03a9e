"""Windows, thresholds and regimes on small series, and properties on driver data."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewind.config import Config, ConfigError, RegimeConfig, feature_names, parse
from tidewind.operators import features
from tidewind.sources.bars import lineitem_bars, nan_to_null, read_bars_csv, write_bars_csv


def series(spark, closes, volumes=None, symbol=None):
    start = date(2020, 1, 1)
    rows = [(start + timedelta(days=i), *[float(c)] * 4, float(v)) for i, (c, v) in enumerate(zip(closes, volumes or [1] * len(closes)))]
    df = spark.createDataFrame(rows, "Date date, Open double, High double, Low double, Close double, Volume double")
    return df.withColumn("symbol", F.lit(symbol)) if symbol else df


def test_first_rows_are_null_and_values_by_hand(spark):
    got = features.with_features(series(spark, [100.0 + i for i in range(70)], range(1, 71))).orderBy("Date").collect()
    for name, first in {"return_1d": 1, "return_5d": 5, "return_20d": 20, "volatility_5d": 5, "trend_10d": 9, "trend_60d": 59, "volume_ratio_20d": 19}.items():
        assert [i for i, r in enumerate(got) if r[name] is not None][0] == first, name
    assert got[1]["return_1d"] == pytest.approx(0.01)
    assert got[19]["volume_ratio_20d"] == pytest.approx(20 / 10.5)


def test_target_is_the_fifth_later_row(spark):
    got = features.with_target(series(spark, [100.0, 1, 2, 3, 4, 110.0, 7])).orderBy("Date").collect()
    assert got[0]["forward_return_5d"] == pytest.approx(0.1) and got[2]["forward_return_5d"] is None


def test_zero_price_gives_null_not_an_error(spark):
    got = features.with_returns(series(spark, [0.0, 1.0])).orderBy("Date").collect()
    assert got[1]["return_1d"] is None


@pytest.mark.parametrize("method", ["grouped", "frame", "blocks"])
def test_threshold_needs_history_and_sees_only_the_past(spark, method):
    cfg = Config(regime=RegimeConfig(min_history=4))
    vols = [None, 1.0, 3.0, None, 2.0, 4.0, 100.0, 0.0]
    start = date(2020, 1, 1)
    df = spark.createDataFrame([(start + timedelta(days=i), v) for i, v in enumerate(vols)], "Date date, volatility_20d double")
    got = [r["historical_volatility_threshold_20d"] for r in features.with_threshold(df, cfg, method).orderBy("Date").collect()]
    assert got == [None] * 6 + [2.5, 3.0]


def test_equality_rule(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (1.0, None), (0.5, 1.0)], "v double, t double")
    label = lambda rule: [r[0] for r in df.select(features.regime_label(F.col("v"), F.col("t"), rule)).collect()]
    assert label("HighVol") == ["HighVol", None, None, "LowVol"]
    assert label("LowVol") == ["LowVol", None, None, "LowVol"]


def test_truncation_shuffling_and_symbols_change_nothing(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir)
    whole = {r["Date"]: r for r in features.prepared(b).select("Date", *feature_names(), "regime").collect()}
    cut = features.prepared(b.where("Date <= '1999-06-30'")).select("Date", *feature_names(), "regime")
    assert all(whole[r["Date"]] == r for r in cut.collect())
    shuffled = features.prepared(b.orderBy(F.rand(3))).select("Date", *feature_names(), "regime")
    assert {r["Date"]: r for r in shuffled.collect()} == whole
    two = b.withColumn("symbol", F.explode(F.array(F.lit("a"), F.lit("b"))))
    both = features.prepared(two).select("symbol", "Date", *feature_names(), "regime").collect()
    assert len(both) == 2 * len(whole) and all(tuple(r)[1:] == tuple(whole[r["Date"]]) for r in both)


def test_only_the_target_looks_ahead(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir)
    assert not features.future_uses(features.with_features(b))
    assert not features.future_uses(features.with_threshold(features.with_features(b), method="frame"))
    assert features.future_uses(features.with_target(b))


def test_one_shuffle_for_all_windows_of_a_symbol(spark, sf_dir):
    df = features.with_features(lineitem_bars(spark, sf_dir, "l_suppkey"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 2  # bars by symbol and date, windows by symbol


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    from tidewind.queries import queries

    plan = queries()["scan_bars"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan.split("ReadSchema")[1]


def test_csv_round_trip_and_nan(spark, sf_dir, tmp_path):
    b = lineitem_bars(spark, sf_dir)
    write_bars_csv(b, str(tmp_path / "bars"))
    again = read_bars_csv(spark, str(tmp_path / "bars"))
    assert again.exceptAll(b).count() == 0 and again.count() == b.count()
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "v double")).first()[0] is None


def test_config_errors():
    whole = {"features": {"return_windows": ["5", 10]}, "target": {}, "regime": {}, "folds": {"n_folds": "6"}, "model": {"constant_std": "1e-6"}}
    cfg = parse(whole | {"features": {"volume_window": "20"}})
    assert cfg.model.constant_std == 1e-6 and cfg.folds.n_folds == 6 and cfg.hash() == Config().hash()
    for wrong in ({}, whole | {"regime": {"equality_rule": "MidVol"}}, whole | {"target": {"horizon": 3}}, whole | {"folds": {"size": 1}}, whole | {"model": {"seed": "x"}}):
        with pytest.raises(ConfigError):
            parse(wrong)


@pytest.mark.parametrize(("block_days", "ranges"), [(16, 4), (50, 64), (4096, 8)])
def test_threshold_by_blocks_is_that_of_the_frame(spark, block_days, ranges):
    import random

    draw = random.Random(6)
    start, rows = date(2001, 3, 4), []
    for symbol, level in (("a", 1.0), ("b", 1000.0), ("c", 0.0)):
        for i in sorted(draw.sample(range(700), 300)):
            v = draw.choice([None, 0.5 * level, draw.gauss(level, 1 + i / 100), level * i])  # ties, gaps and a trend
            rows.append((symbol, start + timedelta(days=i), v, "kept"))
    df = spark.createDataFrame(rows, "symbol string, Date date, volatility_20d double, other string").repartition(4)
    cfg, t = Config(regime=RegimeConfig(min_history=20)), "historical_volatility_threshold_20d"
    got = features.with_threshold(df, cfg, "blocks", block_days, ranges)
    want = features.with_threshold(df, cfg, "frame")
    assert got.columns == want.columns
    key = lambda r: (r["symbol"], r["Date"])
    pairs = list(zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True))
    assert all(key(a) == key(b) and a["other"] == "kept" and a[t] == (None if b[t] is None else pytest.approx(b[t], rel=1e-12)) for a, b in pairs)
    assert sum(a[t] is not None for a, _ in pairs) > 500
    assert features.with_threshold(df.where("false"), cfg, "blocks").count() == 0


def test_point_in_time_finds_a_planted_leak(spark, sf_dir):
    from tidewind.operators import gate, quality

    b = lineitem_bars(spark, sf_dir)
    days = [r["Date"].isoformat() for r in quality.sampled_dates(b.where("Date > '1994-01-01'")).collect()]
    sound = features.prepared(b)
    ahead = sound.withColumn("return_5d", F.lead("return_5d", 1).over(features.by_date(sound)))
    found = {name: gate.point_in_time(b, days, published=table).collect() for name, table in (("sound", sound), ("leak", ahead))}
    assert len(found["sound"]) == 12 and not any(r["n_features_changed"] or r["regime_changed"] for r in found["sound"])
    assert all(r["n_features_changed"] == 1 for r in found["leak"])


def test_trailing_statistics_are_those_of_the_frames(spark):
    import random

    draw = random.Random(3)
    start, rows = date(2001, 3, 4), []
    for symbol, level in (("a", 1.0), ("b", 1e6), ("c", 0.0), ("d", 0.1), ("e", 1.0)):
        for i in sorted(draw.sample(range(400), 150)):
            v = draw.gauss(level, 1) if symbol in "ab" else level
            if symbol == "e":
                v = draw.choices([None, float("nan"), float("inf"), draw.random()], [1, 1, 1, 30])[0]
            rows.append((symbol, start + timedelta(days=i), v, draw.random()))
    df = spark.createDataFrame(rows, "symbol string, Date date, v double, u double").repartition(4)
    w, n_values = features.by_date(df), 0
    for windows in ((5, 10, 20, 60), (3, 7), (2, 3, 12), (1, 4), (11,)):
        wanted = {f"{kind}_{c}_{n}": (kind, c, n) for kind in ("mean", "stddev") for c in ("v", "u") for n in windows}
        frames = {n: w.rowsBetween(1 - n, 0) for n in windows}
        plain = {"mean": F.avg, "stddev": F.stddev_samp}
        want = df.select("*", *[F.when(F.count(c).over(frames[n]) == n, plain[k](c).over(frames[n])).alias(name) for name, (k, c, n) in wanted.items()])
        got = features.with_trailing(df, wanted)
        assert got.columns == want.columns
        key = lambda r: (r["symbol"], r["Date"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            for name in wanted:
                assert (a[name] is None) == (b[name] is None), name
                assert b[name] is None or a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-12, nan_ok=True), name
                n_values += b[name] is not None
            if a["symbol"] in "cd":  # one value throughout has no spread at all, not even a rounding error
                assert all(a[name] in (None, 0.0) for name, (k, c, _) in wanted.items() if k == "stddev" and c == "v")
    assert n_values > 20_000


def test_features_look_back_without_summing_whole_frames(spark, sf_dir):
    """No frame slides, each lag is made once, and a row has fewer of them than the longest window has rows."""
    import re

    df = features.with_features(lineitem_bars(spark, sf_dir, "l_suppkey"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RowFrame, (\S+), (\S+?)\)", plan)
    assert 0 < len(frames) < 60 and all(low == high for low, high in frames)
