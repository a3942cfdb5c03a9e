"""All queries by name: each takes (spark, sf_dir) and returns a DataFrame.

The input is the daily bars of lineitem's unit prices.  Doubles are rounded to
nine decimals at the very end, so that another engine's last digits don't show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.config import Config, RegimeConfig, feature_names
from tidewind.functions.exprs import mapped, rounded, safe_corr
from tidewind.operators import errors, evaluate, features, folds, gate, models, quality
from tidewind.operators.tables import delete_at_exit, shared_folder
from tidewind.sources.bars import lineitem_bars, provider_bars, read_bars_csv, read_csv, write_bars_csv
from tidewind.sources.files import file_hashes
from tidewind.streaming.bars import sessions, windowed_bars

CFG = Config()
LOW_RULE = Config(regime=RegimeConfig(equality_rule="LowVol"))
NAMES = feature_names()
TARGET = CFG.target.column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def published(df: DataFrame) -> DataFrame:
    """Doubles with nine decimals and without a negative zero."""
    return df.select(*[(rounded(F.col(c)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: published(f(spark, sf_dir))
    return f


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.prepared(lineitem_bars(spark, sf_dir))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.canonical(prepared(spark, sf_dir))


def three_models(rows: DataFrame) -> dict[str, DataFrame]:
    """The zero baseline and two predictors that SQL can express."""
    return {
        "baseline_zero": evaluate.zero_predictions(rows),
        "momentum": evaluate.momentum_predictions(rows),
        "reversal": evaluate.expression_predictions(rows, F.lit(-0.05) * F.col("return_20d")),
    }


def momentum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the momentum predictions; the baseline sees the same test rows."""
    found = three_models(canonical(spark, sf_dir))
    return errors.with_errors(evaluate.to_oos(found["momentum"]), found["baseline_zero"])


# Sources.


@query
def daily_bars(spark, sf_dir):
    return lineitem_bars(spark, sf_dir)


@query
def scan_bars(spark, sf_dir):
    """Projection and date filter that reach the scan."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.select(F.to_date("l_shipdate").alias("Date"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query
def supplier_bars(spark, sf_dir):
    """One symbol per supplier."""
    return lineitem_bars(spark, sf_dir, "l_suppkey")


@query
def provenance_profile(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir)
    return b.agg(F.count("*").alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.lit(len(b.columns)).cast("long").alias("n_columns"))


@query
def status_names(spark, sf_dir):
    """A value map: order states by name, how many orders have each."""
    names = {"F": "filled", "O": "open"}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))
    return orders.select("o_orderstatus", mapped(F.col("o_orderstatus"), names).alias("status"), "n_orders")


@query
def sampled_dates(spark, sf_dir):
    """Twelve seeded dates of the bars, for proofs at a sample."""
    return quality.sampled_dates(lineitem_bars(spark, sf_dir))


@query
def table_hashes(spark, sf_dir):
    """Content hashes of the two smallest tables' files."""
    found = file_hashes(spark, sf_dir, "region*.parquet,nation*.parquet")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")


@query
def frame_fingerprint(spark, sf_dir):
    return quality.fingerprint(lineitem_bars(spark, sf_dir))


@query
def market_source(spark, sf_dir):
    """Adjusted bars of one ticker and a range of dates, from the provider's trades."""
    return published(provider_bars(spark, f"{sf_dir}/lineitem.parquet", 1, "1994-01-01", "1998-01-01"))


@query
def csv_bars(spark, sf_dir):
    """Bars written as CSV, scanned again with their schema."""
    path = f"{shared_folder(spark)}/tidewind-csv-{uuid.uuid4().hex}"
    write_bars_csv(lineitem_bars(spark, sf_dir), path)
    delete_at_exit(spark, path)
    return read_bars_csv(spark, path)


@query
def provenance_record(spark, sf_dir):
    """What is kept about raw bars: rows, dates, columns and a digest."""
    return quality.provenance_record(lineitem_bars(spark, sf_dir))


# Window features.


@query
def daily_return(spark, sf_dir):
    return features.with_returns(lineitem_bars(spark, sf_dir)).select("Date", "Close", "return_1d")


@query
def momentum_features(spark, sf_dir):
    return features.with_returns(lineitem_bars(spark, sf_dir)).select("Date", "return_5d", "return_10d", "return_20d")


@query
def forward_target(spark, sf_dir):
    return features.with_target(lineitem_bars(spark, sf_dir)).select("Date", TARGET)


@query
def volatility_features(spark, sf_dir):
    return features.with_features(lineitem_bars(spark, sf_dir)).select("Date", "volatility_5d", "volatility_10d", "volatility_20d")


@query
def volatility_raw(spark, sf_dir):
    """Not annualized."""
    b = features.with_returns(lineitem_bars(spark, sf_dir))
    made = {f"Vol{n}": ("stddev", "return_1d", n) for n in (5, 10, 20)}
    return features.with_trailing(b, made).select("Date", *made)


@query
def trend_features(spark, sf_dir):
    return features.with_features(lineitem_bars(spark, sf_dir)).select("Date", "trend_10d", "trend_20d", "trend_60d")


@query
def volume_ratio(spark, sf_dir):
    return features.with_features(lineitem_bars(spark, sf_dir)).select("Date", "volume_ratio_20d")


@query
def supplier_features(spark, sf_dir):
    """All features of every supplier's bars, partitioned by symbol."""
    return features.with_features(lineitem_bars(spark, sf_dir, "l_suppkey")).select("symbol", "Date", *NAMES)


@query
def feature_range_read(spark, sf_dir):
    """Features of two years from just the rows that they need."""
    found = features.read_with_lookback(lineitem_bars(spark, sf_dir), "1996-01-01", "1997-12-31")
    return found.select("Date", *NAMES, TARGET)


@query
def regime_threshold(spark, sf_dir):
    """By blocks of the calendar, each from summaries of the blocks before."""
    rows = features.with_threshold(features.with_features(lineitem_bars(spark, sf_dir)), method="blocks")
    return rows.select("Date", CFG.regime.volatility_column, CFG.regime.threshold_column)


@query
def regime_labels(spark, sf_dir):
    return prepared(spark, sf_dir).select("Date", "regime")


@query
def regime_labels_lowvol_rule(spark, sf_dir):
    return features.prepared(lineitem_bars(spark, sf_dir), LOW_RULE).select("Date", "regime")


@query
def regime_counts(spark, sf_dir):
    """Counts and shares in fixed order, with unlabelled rows."""
    got = prepared(spark, sf_dir).groupBy(F.coalesce("regime", F.lit("unlabelled")).alias("regime")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(0, "LowVol"), (1, "HighVol"), (2, "unlabelled")], "ordinal int, regime string")
    out = every.join(got, "regime", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.crossJoin(got.agg(F.sum("n").alias("total"))).select("ordinal", "regime", "n", F.try_divide("n", "total").alias("share"))


@query
def calendar_gaps(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir)
    return b.select("Date", F.date_diff("Date", F.lag("Date").over(features.by_date(b))).alias("gap_days"))


@query
def warmup_boundaries(spark, sf_dir):
    return quality.warmup_boundaries(features.with_row_index(features.with_features(lineitem_bars(spark, sf_dir))), NAMES)


@query
def target_manual_check(spark, sf_dir):
    """The target at the first, middle and last labelled row, recomputed by a join on row numbers."""
    rows = features.with_row_index(features.with_target(lineitem_bars(spark, sf_dir))).select("Date", "row_idx", "n_rows", "Close", TARGET)
    h = CFG.target.horizon
    last = F.col("n_rows") - 1 - h
    sample = rows.where((F.col("row_idx") == 0) | (F.col("row_idx") == F.floor(last / 2)) | (F.col("row_idx") == last))
    later = rows.select((F.col("row_idx") - h).alias("row_idx"), F.col("Close").alias("later"))
    both = sample.join(later, "row_idx").withColumn("by_hand", F.col("later") / F.col("Close") - 1)
    return both.select("Date", "row_idx", TARGET, "by_hand", (F.abs(F.col("by_hand") - F.col(TARGET)) < 1e-12).alias("agrees"))


@query
def feature_manual_check(spark, sf_dir):
    """Features and threshold at three rows, recomputed from the rows before."""
    return quality.feature_manual_check(lineitem_bars(spark, sf_dir))


@query
def canonical_round_trip(spark, sf_dir):
    """Canonical rows against themselves, written as CSV and read again."""
    rows = canonical(spark, sf_dir)
    path = f"{shared_folder(spark)}/tidewind-csv-{uuid.uuid4().hex}"
    write_bars_csv(rows, path)
    delete_at_exit(spark, path)
    return quality.reload_check(rows, read_csv(spark, path, rows.schema))


@query
def canonical_dataset(spark, sf_dir):
    return canonical(spark, sf_dir)


@query
def row_accounting(spark, sf_dir):
    """Raw rows less warm-up less unlabelled tail are the canonical rows."""
    rows = features.with_row_index(prepared(spark, sf_dir))
    kept = features.all_present(rows, [*NAMES, TARGET, "regime"])
    one = rows.agg(F.count("*").alias("raw_rows"), F.min(F.when(kept, F.col("row_idx"))).cast("long").alias("warm_up_rows"), F.count_if(F.col(TARGET).isNull()).alias("tail_rows"), F.count_if(kept).alias("canonical_rows"))
    return one.withColumn("balances", F.col("raw_rows") - F.col("warm_up_rows") - F.col("tail_rows") == F.col("canonical_rows"))


@query
def full_sample_threshold(spark, sf_dir):
    return quality.median(features.with_features(lineitem_bars(spark, sf_dir)), "volatility_20d", "full_sample_threshold")


@query
def leaky_label_disagreement(spark, sf_dir):
    """Rows that a threshold over the whole sample would label differently."""
    rows = prepared(spark, sf_dir).where("regime is not null").select("volatility_20d", "regime")
    leaky = quality.median(features.with_features(lineitem_bars(spark, sf_dir)), "volatility_20d", "t")
    other = F.when(F.col("volatility_20d") >= F.col("t"), "HighVol").otherwise("LowVol")
    return rows.crossJoin(F.broadcast(leaky)).agg(F.count("*").alias("n_labelled"), F.count_if(other != F.col("regime")).alias("n_disagree"))  # leaky is one row


# Profiles and validation.


@query
def return_histogram(spark, sf_dir):
    return quality.histogram(features.with_returns(lineitem_bars(spark, sf_dir)), "return_1d")


@query
def return_describe(spark, sf_dir):
    return quality.describe(features.with_returns(lineitem_bars(spark, sf_dir)), "return_1d")


@query
def missing_counts(spark, sf_dir):
    return quality.missing_counts(prepared(spark, sf_dir), [*NAMES, TARGET])


@query
def feature_quality(spark, sf_dir):
    return quality.feature_quality(features.with_features(lineitem_bars(spark, sf_dir)), NAMES)


@query
def feature_target_corr(spark, sf_dir):
    """Correlation of each feature with the target; above 0.2 it is suspicious."""
    rows = canonical(spark, sf_dir)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in NAMES])).alias("x"), F.col(TARGET).alias("y"))
    got = long.groupBy("x.feature").agg(safe_corr(F.col("x.v"), F.col("y")).alias("correlation"))
    return got.withColumn("suspicious", F.abs("correlation") > 0.2)


@query
def finite_check(spark, sf_dir):
    return quality.finite_check(canonical(spark, sf_dir), [*NAMES, TARGET])


@query
def ohlc_violations(spark, sf_dir):
    return quality.ohlc_violations(lineitem_bars(spark, sf_dir))


@query
def raw_validation_report(spark, sf_dir):
    return quality.validation_report(lineitem_bars(spark, sf_dir))


@query
def duplicate_dates(spark, sf_dir):
    """Order dates with several orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("Date"))
    return quality.duplicate_dates(rows)


@query
def monotonic_check(spark, sf_dir):
    """Are orders in date order of their keys?  o_orderkey is the ingest ordinal."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = rows.select(F.to_date("o_orderdate").alias("Date"), "o_orderkey", F.col("o_orderstatus").alias("symbol"))
    return quality.monotonic_check(rows, "o_orderkey")


@query
def regime_domain_violations(spark, sf_dir):
    return quality.regime_domain(prepared(spark, sf_dir))


@query
def canonical_quality_gate(spark, sf_dir):
    return quality.canonical_gate(canonical(spark, sf_dir))


@query
def raw_unchanged(spark, sf_dir):
    b = lineitem_bars(spark, sf_dir)
    return quality.changed_rows(b, features.prepared(b))


@query
def dictionary_coverage(spark, sf_dir):
    """The data dictionary against the canonical rows: entries, blank fields, types and missing values by column."""
    return quality.dictionary_profile(quality.data_dictionary(spark), canonical(spark, sf_dir))


@query
def point_in_time_rebuild(spark, sf_dir):
    """The sampled days rebuilt from a history that ends there."""
    b = lineitem_bars(spark, sf_dir)
    days = [r["Date"].isoformat() for r in quality.sampled_dates(b).collect()]  # twelve
    return gate.point_in_time(b, days)


# Folds.


@query
def fold_spec(spark, sf_dir):
    return folds.fold_spec(canonical(spark, sf_dir))


@query
def fold_rows(spark, sf_dir):
    return folds.fold_rows(canonical(spark, sf_dir)).select("fold", "row_idx", "Date", "role")


@query
def fold_boundary_audit(spark, sf_dir):
    return folds.boundary_audit(canonical(spark, sf_dir))


@query
def fold_chronology(spark, sf_dir):
    return folds.chronology(canonical(spark, sf_dir))


@query
def purge_gap_check(spark, sf_dir):
    return folds.purge_check(folds.fold_spec(canonical(spark, sf_dir)))


@query
def fold_coverage(spark, sf_dir):
    return folds.coverage(canonical(spark, sf_dir))


@query
def fold_traceability(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    return folds.traceability(evaluate.zero_predictions(rows), rows)


@query
def fold_scaler_stats(spark, sf_dir):
    return folds.scaler_stats(canonical(spark, sf_dir), NAMES)


# Predictions, metrics, comparisons.


@query
def zero_baseline_predictions(spark, sf_dir):
    return evaluate.zero_predictions(canonical(spark, sf_dir))


@query
def all_model_predictions(spark, sf_dir):
    return evaluate.union_models(three_models(canonical(spark, sf_dir)))


@query
def oos_canonical_table(spark, sf_dir):
    return evaluate.to_oos(evaluate.momentum_predictions(canonical(spark, sf_dir)))


@query
def oos_manifest(spark, sf_dir):
    oos = evaluate.to_oos(evaluate.momentum_predictions(canonical(spark, sf_dir)))
    return oos.agg(F.count("*").alias("n_rows"), F.count_distinct("Date").alias("n_dates"), F.count_distinct("fold_id").alias("n_folds"), F.count_distinct("regime").alias("n_regimes"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


@query
def fold_metrics(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    return evaluate.fold_metrics(evaluate.momentum_predictions(rows), rows)


@query
def fold_metrics_vs_baseline(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    found = three_models(rows)
    return evaluate.against_baseline(evaluate.fold_metrics(found["momentum"], rows), evaluate.fold_metrics(found["baseline_zero"], rows))


@query
def overall_metrics(spark, sf_dir):
    return evaluate.overall_metrics(evaluate.union_models(three_models(canonical(spark, sf_dir))))


@query
def scope_filter(spark, sf_dir):
    return evaluate.scope_filter(evaluate.momentum_predictions(canonical(spark, sf_dir)), "HighVol")


@query
def regime_performance(spark, sf_dir):
    return evaluate.regime_performance(evaluate.union_models(three_models(canonical(spark, sf_dir))))


@query
def regime_comparison(spark, sf_dir):
    return evaluate.regime_comparison(evaluate.regime_performance(evaluate.union_models(three_models(canonical(spark, sf_dir)))), "momentum")


@query
def model_ranking(spark, sf_dir):
    return evaluate.model_ranking(evaluate.union_models(three_models(canonical(spark, sf_dir))))


@query
def best_models(spark, sf_dir):
    return evaluate.best_models(evaluate.union_models(three_models(canonical(spark, sf_dir))))


@query
def same_oos_rows(spark, sf_dir):
    found = three_models(canonical(spark, sf_dir))
    return evaluate.same_rows(found["baseline_zero"], found["momentum"])


@query
def in_sample_predictions(spark, sf_dir):
    """Predictions shifted by one fold: all but the last fold's are found out."""
    rows = canonical(spark, sf_dir)
    moved = evaluate.momentum_predictions(rows).withColumn("fold", F.col("fold") + 1)
    return gate.in_sample(moved, rows)


# Errors.


@query
def oos_errors(spark, sf_dir):
    return momentum_errors(spark, sf_dir)


@query
def top_errors(spark, sf_dir):
    return errors.top_errors(momentum_errors(spark, sf_dir))


@query
def top_overlap(spark, sf_dir):
    return errors.top_overlap(errors.ranked(momentum_errors(spark, sf_dir)))


@query
def error_only_dates(spark, sf_dir):
    return errors.error_only(errors.ranked(momentum_errors(spark, sf_dir)))


@query
def sign_mismatch(spark, sf_dir):
    found = errors.error_only(errors.ranked(momentum_errors(spark, sf_dir)))
    return found.agg(F.count("*").alias("n_error_only"), F.count_if("sign_mismatch").alias("n_sign_mismatch"))


@query
def error_clusters(spark, sf_dir):
    return errors.clusters(errors.top_errors(momentum_errors(spark, sf_dir)))


@query
def fold_share(spark, sf_dir):
    return errors.shares(errors.ranked(momentum_errors(spark, sf_dir)), "fold_id")


@query
def regime_share(spark, sf_dir):
    return errors.shares(errors.ranked(momentum_errors(spark, sf_dir)), "regime")


@query
def regime_error_stats(spark, sf_dir):
    return errors.regime_stats(momentum_errors(spark, sf_dir))


@query
def error_correlations(spark, sf_dir):
    return errors.correlations(momentum_errors(spark, sf_dir)).drop("spearman_actual_error")


@query
def spearman_corr(spark, sf_dir):
    return errors.correlations(momentum_errors(spark, sf_dir)).select("spearman_actual_error")


@query
def enrichment_test(spark, sf_dir):
    return errors.enrichment(errors.ranked(momentum_errors(spark, sf_dir)))


@query
def integrity_gate(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    found = three_models(rows)
    return gate.gate_counts(found["momentum"], rows, found["baseline_zero"])


# Models that SQL can't express.


def _trained(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return published(models.model_predictions(canonical(spark, sf_dir), [name]))

    return run


for _name in models.REGISTRY:
    QUERIES[f"model_{_name}"] = _trained(_name)


@query
def trained_model_ranking(spark, sf_dir):
    """The zero baseline and the four trained models, ranked."""
    rows = canonical(spark, sf_dir)
    order = F.create_map(*[x for i, n in enumerate(models.REGISTRY, 1) for x in (F.lit(n), F.lit(i))])
    made = models.model_predictions(rows, list(models.REGISTRY)).drop("train_mae_diagnostic_only").withColumn("model_ordinal", order[F.col("model")])
    base = evaluate.zero_predictions(rows).withColumns({"model": F.lit("baseline_zero"), "model_ordinal": F.lit(0)})
    return evaluate.model_ranking(base.unionByName(made))


# Event bars and sessions, the batch side of the streams.


@query
def event_bars(spark, sf_dir):
    return windowed_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query
def event_sessions(spark, sf_dir):
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "5 minutes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
