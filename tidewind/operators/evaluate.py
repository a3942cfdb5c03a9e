"""Predictions, metrics by fold and scope, comparisons and rankings of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewind.config import Config
from tidewind.functions.exprs import is_close, is_finite, metrics
from tidewind.operators.features import keys
from tidewind.operators.folds import fold_rows, test_rows

SCOPES = ("Overall", "LowVol", "HighVol")
REGIMES = SCOPES[1:]


class FairnessError(ValueError):
    """Models that were not scored on the same rows."""


class PredictionError(ValueError):
    """A prediction table that breaks its contract."""


def expression_predictions(rows: DataFrame, prediction: Column, cfg: Config = Config()) -> DataFrame:
    """``(fold, Date, regime, y_true, y_pred)`` of every test row, and its symbol if it has one, for a prediction made of its own features."""
    t = test_rows(rows, cfg)
    return t.select("fold", *keys(t), "Date", "regime", F.col(cfg.target.column).alias("y_true"), prediction.alias("y_pred"))


def zero_predictions(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    return expression_predictions(rows, F.lit(0.0), cfg)


def momentum_predictions(rows: DataFrame, cfg: Config = Config(), factor: float = 0.1) -> DataFrame:
    return expression_predictions(rows, F.lit(factor) * F.col("return_5d"), cfg)


def union_models(models: dict[str, DataFrame]) -> DataFrame:
    """All models' predictions with ``model`` and its ordinal, in the order given."""
    parts = [p.select(F.lit(m).alias("model"), F.lit(i).alias("model_ordinal"), "*") for i, (m, p) in enumerate(models.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_oos(predictions: DataFrame) -> DataFrame:
    """The canonical out-of-sample table."""
    return predictions.select(*keys(predictions), "Date", F.col("y_pred").alias("prediction"), F.col("y_true").alias("actual_return_5d"), "regime", F.col("fold").alias("fold_id"))


def check_oos(predictions: DataFrame) -> DataFrame:
    """The canonical table, or an error for extra columns, missing values or a date twice."""
    wanted = ["fold", *keys(predictions), "Date", "regime", "y_true", "y_pred"]
    if sorted(predictions.columns) != sorted(wanted):
        raise PredictionError(f"columns are {predictions.columns}, not {wanted}")
    n, days, bad = predictions.agg(F.count("*"), F.count_distinct("Date", *keys(predictions)), F.count_if(~is_finite(F.col("y_pred")) | ~is_finite(F.col("y_true")) | F.col("Date").isNull())).first()
    if n == 0:
        raise PredictionError("no rows")
    if bad:
        raise PredictionError(f"{bad} rows with missing or infinite values")
    if days != n:
        raise PredictionError("duplicate dates")
    return to_oos(predictions).orderBy("Date", *keys(predictions))


def fold_metrics(predictions: DataFrame, rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Metrics of each fold with the number of rows it was trained on."""
    train = fold_rows(rows, cfg).where("role = 'train'").groupBy("fold").agg(F.count("*").alias("n_train"))
    m = predictions.groupBy("fold").agg(
        *metrics(F.col("y_true"), F.col("y_pred"), cfg.model.constant_std), F.min("Date").alias("test_start_date"), F.max("Date").alias("test_end_date")
    )
    return m.withColumnRenamed("n", "n_test").join(train, "fold", "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))


def against_baseline(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Fold metrics with the baseline's error and the improvement over it."""
    b = baseline.select("fold", F.col("mae").alias("baseline_zero_mae"))
    return model.join(b, "fold").withColumn("mae_improvement_over_baseline", F.col("baseline_zero_mae") - F.col("mae"))


def overall_metrics(models: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Metrics pooled over all rows of each model, not averaged over folds."""
    return models.groupBy("model").agg(*metrics(F.col("y_true"), F.col("y_pred"), cfg.model.constant_std))


def scope_filter(predictions: DataFrame, scope: str) -> DataFrame:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, not one of {SCOPES}")
    return predictions if scope == "Overall" else predictions.where(F.col("regime") == scope)


def regime_performance(models: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Metrics of each model over all rows and by regime; a scope without rows has n = 0 and nulls.

    One aggregation: a row counts towards two scopes.
    """
    scope = F.explode(F.array(F.lit("Overall"), F.col("regime")))
    y, p = F.col("y_true"), F.col("y_pred")
    got = models.withColumn("scope", scope).groupBy("model", "scope").agg(*metrics(y, p, cfg.model.constant_std), F.min("Date").alias("date_start"), F.max("Date").alias("date_end"))
    every = models.select("model").distinct().withColumn("scope", F.explode(F.array(*map(F.lit, SCOPES))))
    return every.join(got, ["model", "scope"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def regime_comparison(performance: DataFrame, model: str, baseline: str = "baseline_zero") -> DataFrame:
    """Baseline and model side by side by scope."""
    cols = ("mae", "prediction_correlation", "directional_hit_rate")
    b = performance.where(F.col("model") == baseline).select("scope", "n", *[F.col(c).alias(f"{baseline}_{c}") for c in cols])
    m = performance.where(F.col("model") == model).select("scope", *[F.col(c).alias(f"{model}_{c}") for c in cols])
    return b.join(m, "scope").withColumn("mae_improvement_over_baseline", F.col(f"{baseline}_mae") - F.col(f"{model}_mae"))


def model_ranking(models: DataFrame, cfg: Config = Config(), baseline: str = "baseline_zero") -> DataFrame:
    """Models by pooled error, equal errors in the order given; a handful of rows is ranked."""
    m = models.groupBy("model", "model_ordinal").agg(*metrics(F.col("y_true"), F.col("y_pred"), cfg.model.constant_std))
    every = Window.partitionBy()
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(every)
    ranked = m.withColumn("rank_by_mae", F.row_number().over(Window.orderBy("mae", "model_ordinal"))).withColumn("mae_improvement_over_baseline", base - F.col("mae"))
    return ranked.drop("model_ordinal")


def best_models(models: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The best model by each metric; undefined values are passed over, the first of equals wins."""
    m = models.groupBy("model", "model_ordinal").agg(*metrics(F.col("y_true"), F.col("y_pred"), cfg.model.constant_std))
    best = lambda c, sign: F.min_by("model", F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("v"), F.col("model_ordinal"))))
    return m.agg(
        best("mae", 1).alias("best_by_mae"),
        best("prediction_correlation", -1).alias("best_by_prediction_correlation"),
        best("directional_hit_rate", -1).alias("best_by_directional_hit_rate"),
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts of what makes a comparison unfair, over a full outer join on Date, and symbol if there is one."""
    by = [*keys(a), "Date"]
    side = lambda p, s: p.groupBy(*by).agg(F.count("*").alias(f"n_{s}"), F.min("regime").alias(f"regime_{s}"), F.min("y_true").alias(f"y_{s}"))
    both = side(a, "a").join(side(b, "b"), by, "full_outer")
    return both.agg(
        F.count_if(F.coalesce("n_a", F.lit(0)) > 1).alias("repeated_a"),
        F.count_if(F.coalesce("n_b", F.lit(0)) > 1).alias("repeated_b"),
        F.count_if(F.col("n_a").isNull()).alias("only_b"),
        F.count_if(F.col("n_b").isNull()).alias("only_a"),
        F.count_if(F.col("n_a").isNotNull() & F.col("n_b").isNotNull() & ~F.col("regime_a").eqNullSafe(F.col("regime_b"))).alias("regime_differs"),
        F.count_if(~is_close(F.col("y_a"), F.col("y_b"), 1e-8, 1e-5)).alias("target_differs"),
    )


def check_fair(a: DataFrame, b: DataFrame) -> None:
    found = same_rows(a, b).first().asDict()
    if wrong := {k: v for k, v in found.items() if v}:
        raise FairnessError(f"not the same rows: {wrong}")
