"""Purged, expanding walk-forward folds as relations.

With n rows the first ``min_train`` are never tested; the rest is cut into
``n_folds`` test blocks of equal size, the last also takes the remainder.  Fold
k trains on all rows more than ``horizon`` rows before its test block.  Folds
follow from a row's index and n by arithmetic, so membership needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewind.config import Config, FoldConfig
from tidewind.operators.features import by_date, keys, with_row_index


class FoldError(ValueError):
    """Too few rows for the folds asked for."""


def check_rows(n: int, f: FoldConfig) -> None:
    if n - f.min_train < f.n_folds:
        raise FoldError(f"{n} rows leave {n - f.min_train} for {f.n_folds} folds after {f.min_train} to train on")


def _bounds(f: FoldConfig) -> tuple[Column, Column]:
    """Start and end (excluded) of fold ``fold``'s test block among ``n_rows`` rows."""
    size = F.expr(f"(n_rows - {f.min_train}) div {f.n_folds}").cast("int")
    start = F.lit(f.min_train) + F.col("fold") * size
    end = F.when(F.col("fold") == f.n_folds - 1, F.col("n_rows")).otherwise(start + size)
    return start.cast("int"), end.cast("int")


def fold_spec(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``(fold, train_end_idx, test_start_idx, test_end_idx)`` of each symbol, ends excluded; none if rows are too few."""
    f = cfg.folds
    start, end = _bounds(f)
    n = rows.groupBy(*keys(rows)).agg(F.count("*").cast("int").alias("n_rows")).where(F.col("n_rows") >= f.min_train + f.n_folds)
    spec = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(f.n_folds - 1)))).withColumns({"test_start_idx": start, "test_end_idx": end})
    spec = spec.withColumn("train_end_idx", F.greatest(F.col("test_start_idx") - f.horizon, F.lit(0)))
    return spec.select(*keys(rows), "fold", "train_end_idx", "test_start_idx", "test_end_idx", "n_rows")


def fold_rows(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every row once per fold, with ``role``: train, purge, test or future."""
    f = cfg.folds
    start, end = _bounds(f)
    out = with_row_index(rows).where(F.col("n_rows") >= f.min_train + f.n_folds)
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(f.n_folds - 1)))).withColumns({"test_start_idx": start, "test_end_idx": end})
    i = F.col("row_idx")
    role = F.when(i < F.col("test_start_idx") - f.horizon, "train").when(i < F.col("test_start_idx"), "purge").when(i < F.col("test_end_idx"), "test").otherwise("future")
    return out.withColumn("role", role)


def test_rows(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows of the test blocks, each with its one fold."""
    f = cfg.folds
    out = with_row_index(rows).where((F.col("n_rows") >= f.min_train + f.n_folds) & (F.col("row_idx") >= f.min_train))
    size = F.expr(f"(n_rows - {f.min_train}) div {f.n_folds}")
    fold = F.least(F.floor((F.col("row_idx") - f.min_train) / size), F.lit(f.n_folds - 1)).cast("int")
    return out.withColumn("fold", fold)


def boundary_audit(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Sizes and dates of train, purge and test rows of each fold; null dates where there are none."""
    of = lambda role, agg: agg(F.when(F.col("role") == role, F.col("Date")))
    return (
        fold_rows(rows, cfg)
        .groupBy(*keys(rows), F.col("fold").alias("fold_id"))
        .agg(
            F.count_if(F.col("role") == "train").alias("n_train"),
            F.count_if(F.col("role") == "test").alias("n_test"),
            of("train", F.min).alias("train_start_date"),
            of("train", F.max).alias("train_end_date"),
            F.count_if(F.col("role") == "purge").alias("purge_gap_n_rows"),
            of("purge", F.min).alias("purge_gap_start_date"),
            of("purge", F.max).alias("purge_gap_end_date"),
            of("test", F.min).alias("test_start_date"),
            of("test", F.max).alias("test_end_date"),
        )
    )


def chronology(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Whether each fold's last training date is before its first test date; a fold without training passes."""
    a = boundary_audit(rows, cfg)
    ok = F.coalesce(F.col("train_end_date") < F.col("test_start_date"), F.lit(True))
    return a.select(*keys(rows), "fold_id", "train_end_date", "test_start_date", ok.alias("chronological"))


def purge_check(spec: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Whether the last label that training sees is known before the test block starts."""
    last = F.col("train_end_idx") - 1
    ok = (F.col("train_end_idx") == 0) | (last + cfg.folds.horizon < F.col("test_start_idx"))
    return spec.select(*keys(spec), "fold", last.alias("last_train_idx"), "test_start_idx", (F.col("test_start_idx") - F.col("train_end_idx")).alias("gap_rows"), ok.alias("sufficient"))


def coverage(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Whether the test blocks tile all rows from ``min_train`` on, each once."""
    t = fold_rows(rows, cfg).where("role = 'test'")
    out = t.groupBy(*keys(rows)).agg(
        F.count("*").alias("n_test_rows"),
        F.count_distinct("row_idx").alias("n_distinct_rows"),
        F.min("row_idx").alias("first_idx"),
        F.max("row_idx").alias("last_idx"),
        F.max("n_rows").alias("n_rows"),
    )
    whole = (F.col("n_test_rows") == F.col("n_distinct_rows")) & (F.col("first_idx") == cfg.folds.min_train) & (F.col("last_idx") == F.col("n_rows") - 1)
    return out.withColumn("tiles", whole & (F.col("n_test_rows") == F.col("n_rows") - cfg.folds.min_train))


def traceability(predictions: DataFrame, rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per fold, dates predicted but not tested, tested but not predicted, and predicted twice; unknown folds too."""
    by = [*keys(rows), "Date"]
    t = test_rows(rows, cfg).select(F.col("fold").alias("fold_id"), *by, F.lit(1).alias("tested"))
    p = predictions.groupBy(F.col("fold").alias("fold_id"), *by).agg(F.count("*").alias("predicted"))
    both = t.join(p, ["fold_id", *by], "full_outer")
    out = both.groupBy("fold_id").agg(
        F.count_if(F.col("tested").isNull()).alias("n_unexpected"),
        F.count_if(F.col("predicted").isNull()).alias("n_missing"),
        F.count_if(F.col("predicted") > 1).alias("n_repeated"),
    )
    return out.withColumn("traceable", (F.col("n_unexpected") + F.col("n_missing") + F.col("n_repeated")) == 0)


def scaler_stats(rows: DataFrame, names: list[str], cfg: Config = Config()) -> DataFrame:
    """Mean and population deviation of each feature over each fold's training rows only."""
    train = fold_rows(rows, cfg).where("role = 'train'")
    long = train.select(*keys(rows), "fold", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in names])).alias("x"))
    return long.groupBy(*keys(rows), "fold", "x.feature").agg(F.count("*").alias("n_train"), F.avg("x.v").alias("train_mean"), F.stddev_pop("x.v").alias("train_std"))


def verdict(rows: DataFrame, cfg: Config = Config(), recorded: dict | None = None) -> dict:
    """PASS or BLOCKED with reasons: parameters, first fold, chronology, purge, coverage and calendar gaps."""
    f = cfg.folds
    reasons = []
    audit = boundary_audit(rows, cfg).orderBy("fold_id").collect()  # n_folds rows of a symbol
    if not audit:
        reasons.append("too few rows")
    elif min(r["n_train"] for r in audit) < f.min_first_train:
        reasons.append(f"a fold trains on fewer than {f.min_first_train} rows")
    if chronology(rows, cfg).where(~F.col("chronological")).count():
        reasons.append("training reaches into a test block")
    if purge_check(fold_spec(rows, cfg), cfg).where(~F.col("sufficient")).count():
        reasons.append("purge gap too short")
    if coverage(rows, cfg).where(~F.col("tiles")).count():
        reasons.append("test blocks don't tile the rows")
    gap = rows.select(F.date_diff("Date", F.lag("Date").over(by_date(rows))).alias("g")).agg(F.max("g")).first()[0]
    if gap is not None and gap > f.max_gap_days:
        reasons.append(f"{gap} days without a row")
    drift = "SKIPPED"
    if recorded is not None:
        own = {"n_folds": f.n_folds, "min_train": f.min_train, "horizon": f.horizon}
        drift = "MATCH" if all(recorded.get(k) == v for k, v in own.items()) else "MISMATCH"
        if drift == "MISMATCH":
            reasons.append("parameters are not the recorded ones")
    return {"verdict": "BLOCKED" if reasons else "PASS", "reasons": reasons, "parameters": drift}
