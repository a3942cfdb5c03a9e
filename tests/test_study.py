"""Folds, comparisons, errors, gate, models, contracts, stages and streams."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewind.config import Config, FoldConfig, TargetConfig
from tidewind.operators import errors, evaluate, features, folds, gate, models, quality, trees
from tidewind.plans import contracts
from tidewind.plans.pipeline import Study
from tidewind.sources.bars import SyntheticMarketSource, lineitem_bars
from tidewind.streaming.bars import windowed_bars

BAR = "Date date, Open double, High double, Low double, Close double, Volume double"


def days(spark, n):
    return spark.createDataFrame([(date(2000, 1, 1) + timedelta(days=i),) for i in range(n)], "Date date")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return features.canonical(features.prepared(lineitem_bars(spark, sf_dir))).cache()


def test_fold_sizes(spark):
    got = folds.boundary_audit(days(spark, 2222)).orderBy("fold_id").collect()
    assert [r["n_test"] for r in got] == [160] * 5 + [162]
    assert [r["n_train"] for r in got] == [1255, 1415, 1575, 1735, 1895, 2055]
    assert {r["purge_gap_n_rows"] for r in got} == {5}


def test_too_few_rows(spark):
    with pytest.raises(folds.FoldError):
        folds.check_rows(10, FoldConfig(n_folds=3, min_train=20))
    assert folds.fold_spec(days(spark, 100)).count() == 0
    assert folds.verdict(days(spark, 100))["verdict"] == "BLOCKED"


def test_fold_without_training_rows(spark):
    cfg = Config(folds=FoldConfig(n_folds=1, min_train=2))
    got = folds.boundary_audit(days(spark, 10), cfg).first()
    assert (got["n_train"], got["purge_gap_n_rows"], got["train_start_date"]) == (0, 2, None)
    assert got["purge_gap_start_date"] == date(2000, 1, 1) and folds.chronology(days(spark, 10), cfg).first()["chronological"]


def test_purge_boundary(spark):
    spec = spark.createDataFrame([(0, 997, 1000), (1, 995, 1000)], "fold int, train_end_idx int, test_start_idx int")
    assert [r["sufficient"] for r in folds.purge_check(spec).orderBy("fold").collect()] == [False, True]


def test_gap_and_parameters_block(spark):
    long = days(spark, 2300)
    assert folds.verdict(long)["verdict"] == "PASS"
    assert folds.verdict(long, recorded={"n_folds": 6, "min_train": 1260, "horizon": 5})["parameters"] == "MATCH"
    assert folds.verdict(long, recorded={"n_folds": 5})["verdict"] == "BLOCKED"
    holed = long.where("Date < '2001-01-01' or Date > '2001-01-20'")
    assert "days without a row" in folds.verdict(holed)["reasons"][0]


def test_traceability_finds_moved_unknown_and_repeated(spark, rows):
    good = evaluate.zero_predictions(rows)
    first = good.agg(F.min("Date")).first()[0]
    bad = lambda p: folds.traceability(p, rows).where("not traceable").count()
    assert bad(good) == 0
    for fold in (1, 99):
        assert bad(good.withColumn("fold", F.when(F.col("Date") == F.lit(first), fold).otherwise(F.col("fold")))) == 2
    assert bad(good.unionByName(good.where(F.col("Date") == F.lit(first)))) == 1
    assert gate.in_sample(good.withColumn("fold", F.lit(99)), rows).count() == good.count()


def test_oos_contract(spark, rows):
    good = evaluate.zero_predictions(rows)
    dates = [r["Date"] for r in evaluate.check_oos(good.orderBy(F.rand(1))).collect()]
    assert dates == sorted(dates)
    for wrong in (good.withColumn("more", F.lit(1)), good.unionByName(good), good.withColumn("y_pred", F.lit(float("nan"))), good.limit(0)):
        with pytest.raises(evaluate.PredictionError):
            evaluate.check_oos(wrong)


def test_fairness(spark, rows):
    a = evaluate.zero_predictions(rows)
    evaluate.check_fair(a, evaluate.momentum_predictions(rows))
    first = F.lit(a.agg(F.min("Date")).first()[0])
    for wrong in (
        a.where(F.col("Date") != first),
        a.unionByName(a.where(F.col("Date") == first)),
        a.withColumn("regime", F.when(F.col("Date") == first, "other").otherwise(F.col("regime"))),
        a.withColumn("y_true", F.when(F.col("Date") == first, 9.0).otherwise(F.col("y_true"))),
    ):
        with pytest.raises(evaluate.FairnessError):
            evaluate.check_fair(a, wrong)


def test_scopes(spark, rows):
    only_low = evaluate.union_models({"m": evaluate.momentum_predictions(rows).where("regime = 'LowVol'")})
    got = {r["scope"]: r for r in evaluate.regime_performance(only_low).collect()}
    assert got["HighVol"]["n"] == 0 and got["HighVol"]["mae"] is None and got["HighVol"]["predictions_nearly_constant"] is None
    assert got["Overall"]["n"] == got["LowVol"]["n"] > 0
    with pytest.raises(ValueError):
        evaluate.scope_filter(only_low, "MidVol")


def test_hypergeometric_tail():
    assert errors.upper_tail(100, 50, 10, 5) == pytest.approx(0.6297, abs=1e-4)
    assert errors.upper_tail(3905, 1689, 39, 35) == pytest.approx(1.43e-9, rel=1e-2)
    assert errors.upper_tail(5000, 2500, 2500, 0) == 1.0


def test_top_count_rounds_half_to_even():
    assert [errors.top_count(n) for n in (3905, 50, 150)] == [39, 0, 2]


def test_clusters_join_at_ten_days(spark):
    d = date(2020, 1, 1)
    top = spark.createDataFrame([(d,), (d + timedelta(days=10),), (d + timedelta(days=21),)], "Date date")
    got = errors.clusters(top).orderBy("start_date").collect()
    assert [(r["n_dates"], r["largest"]) for r in got] == [(2, True), (1, False)]


def test_average_rank(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (2.0,), (2.0,)], "v double")
    assert sorted(r["rank"] for r in errors.average_rank(df, "v", "rank").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_raw_validation(spark):
    good = (date(2020, 1, 1), 10.0, 11.0, 9.0, 10.0, 5.0)
    ok = lambda *changed: spark.createDataFrame([tuple(c if c is not ... else g for c, g in zip(changed, good))], BAR)
    assert quality.validate_raw(spark.createDataFrame([good], BAR))["rows"] == 1
    quality.validate_raw(ok(..., 100.0, 100.0 - 1e-11, 100.0 - 1e-11, 100.0 - 1e-11, ...))
    for wrong in (ok(..., 100.0, 100.0 - 1e-6, ..., 100.0, ...), ok(..., ..., ..., -1.0, ..., ...), ok(..., ..., ..., ..., ..., -1.0), ok(..., ..., ..., ..., None, ...)):
        with pytest.raises(quality.ValidationError):
            quality.validate_raw(wrong)
    twice = spark.createDataFrame([good, good], BAR)
    with pytest.raises(quality.ValidationError, match="duplicate"):
        quality.validate_raw(twice)
    with pytest.raises(quality.MissingColumnError):
        quality.validate_raw(twice.drop("Close"))
    with pytest.raises(quality.EmptyTableError):
        quality.validate_raw(twice.limit(0))
    with pytest.raises(quality.ValidationError, match="numeric"):
        quality.validate_raw(twice.withColumn("Close", F.lit("x")))


def test_monotonic_allows_equal_neighbours(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 1, 1)), (3, date(2019, 1, 1))], "at int, Date date")
    assert quality.monotonic_check(df, "at").first()["n_descending"] == 1


def test_gate_fails_blocks_and_passes(spark, sf_dir, rows):
    bars, base, good = lineitem_bars(spark, sf_dir), evaluate.zero_predictions(rows), evaluate.momentum_predictions(rows)
    assert gate.audit(bars, good, base)["verdict"] == "PASS"
    assert gate.audit(bars, None, base)["verdict"] == "BLOCKED"
    bad = gate.audit(bars, good.withColumn("fold", F.lit(0)), base)
    assert bad["verdict"] == "FAIL" and "in_sample" in bad["violations"]


def test_models_are_deterministic_and_not_degenerate(spark, rows):
    def run():
        return sorted(tuple(r) for r in models.model_predictions(rows, ["lightgbm", "adaboost"]).collect())

    once = run()
    assert once == run()
    n = evaluate.zero_predictions(rows).count()
    assert len(once) == 2 * n and len({r[5] for r in once}) > 10


def fitted(params, x, y, train):
    """Predictions of all rows and the trees of models fitted on some rows of arrays."""
    edges = [np.unique(np.quantile(c, np.arange(1, trees.BINS) / trees.BINS)) for c in x[train].T]
    b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
    n, span = int(train.sum()), float(np.ptp(y[train]))
    at = trees.Scale(n, float(y[train].mean()), span, 2.0 ** np.floor(trees.EXACT - np.log2(n * span)))
    return trees.whole_fold(params, 0, at, b, y, np.arange(len(y)) * 7919, train)


def test_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=2000)
    kinds = [models.Boosting, models.Forest, models.BoostR2]
    found, _ = fitted([kind(trees=60) for kind in kinds], x, y, np.arange(2000) < 1500)
    for kind, p in zip(kinds, found, strict=True):
        assert np.abs(p - y)[1500:].mean() < 0.3, kind
    for spec in models.REGISTRY.values():
        assert all(not isinstance(v, (list, tuple, dict)) for v in spec.params.values())


def test_lightgbm_grows_leaf_by_leaf_and_xgboost_by_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = x @ np.array([1.0, 0.9, 0.8]) + 0.1 * rng.normal(size=3000)
    names, all_rows = ("lightgbm", "xgboost"), np.ones(3000, dtype=bool)
    leaves_of = lambda every, m: max(t.feature.count(-1) for t in every[m, 0])
    p, every = fitted([models.REGISTRY[n].build(**{**models.REGISTRY[n].params, "trees": 20}) for n in names], x, y, all_rows)
    assert {n: leaves_of(every, m) for m, n in enumerate(names)} == {"lightgbm": 15, "xgboost": 16}
    assert not np.array_equal(*p)
    _, every = fitted([models.Boosting(trees=1, columns=1.0, leaves=3)], x, y, all_rows)
    assert leaves_of(every, 0) == 3
    grown = every[0, 0][0]
    free, kept = trees.best_first(grown, {}, 3), trees.best_first(grown, {n: 1.0 for n, f in enumerate(grown.feature) if f >= 0}, 16)
    assert free.feature == [-1] and sorted(kept.value) == sorted(grown.value)


def test_seed_comes_from_the_configuration():
    assert models.Boosting(**{**models.REGISTRY["lightgbm"].params, "seed": 7}).seed == 7


def test_stages_skip_and_notice_changes(spark, sf_dir, tmp_path):
    study = Study(spark, sf_dir, str(tmp_path), model="adaboost")
    assert set(study.run_all().values()) == {"made"}
    assert set(study.run_all().values()) == {"kept"}
    assert (tmp_path / "manifest.json").exists()
    other = Study(spark, sf_dir, str(tmp_path), Config(target=TargetConfig(4), folds=FoldConfig(horizon=4)), "adaboost")
    with pytest.raises(contracts.StaleOutputError, match="configuration"):
        other.run("baseline")
    import shutil

    shutil.rmtree(tmp_path / "fold_boundaries.parquet")
    with pytest.raises(contracts.StaleOutputError, match="missing"):
        study.run("validation")
    assert study.run("validation", force=True) == "made"
    spark.range(1).write.mode("overwrite").parquet(study.path("raw"))
    with pytest.raises(contracts.StaleOutputError, match="recorded"):
        study.run("data_foundation")


def test_contract_inputs():
    kept = contracts.StageContract("s", "c", {"a": "1"})
    for inputs, says in (({"b": "1"}, "new"), ({"a": "2"}, "changed")):
        with pytest.raises(contracts.StaleOutputError, match=says):
            contracts.check_inputs(kept, "c", inputs)
    assert contracts.json_safe({"x": {1, 2}, "y": (1, math.pi)}) == {"x": "{1, 2}", "y": [1, math.pi]}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, windowed_bars(events).collect()))


def test_market_source(spark):
    spark.dataSource.register(SyntheticMarketSource)
    read = lambda **o: spark.read.format("tidewind_market").options(**o).load()
    got = read(start="2020-12-28", end="2021-01-05").collect()
    assert [r["Date"].isoformat() for r in got] == ["2020-12-28", "2020-12-29", "2020-12-30", "2020-12-31", "2021-01-01", "2021-01-04"]
    quality.validate_raw(read(start="2020-01-01", end="2021-01-01"))
    with pytest.raises(Exception, match="no rows"):
        read(start="2021-01-01", end="2021-01-01").collect()


def test_symbols_go_through_evaluation_and_errors(spark, sf_dir):
    """Two symbols are two studies: each has the rows, errors and top errors that it has alone, and no date counts twice."""
    one = features.canonical(features.prepared(lineitem_bars(spark, sf_dir)))
    two = one.withColumn("symbol", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("return_5d", F.when(F.col("symbol") == "b", -F.col("return_5d")).otherwise(F.col("return_5d")))
    made, base = evaluate.momentum_predictions(two), evaluate.zero_predictions(two)
    assert set(evaluate.same_rows(made, base).first()) == {0}
    assert gate.in_sample(made, two).count() == 0
    found = errors.with_errors(evaluate.to_oos(made), base)
    alone = errors.with_errors(evaluate.to_oos(evaluate.momentum_predictions(one)), evaluate.zero_predictions(one))
    assert found.count() == 2 * alone.count()
    pick = lambda df: sorted((r["Date"], r["abs_error"]) for r in df.select("Date", "abs_error").collect())
    assert pick(found.where("symbol = 'a'")) == pick(alone)
    k = errors.top_count(found.count())
    assert errors.top_errors(found).count() == k and errors.ranked(found).where("in_top_errors").count() == k
