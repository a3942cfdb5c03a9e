"""Validators of raw bars and of the canonical dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.config import Config, feature_names
from tidewind.functions.exprs import all_finite, any_true, is_close, is_finite
from tidewind.operators.features import by_date, canonical_columns, keys, prepared, with_row_index
from tidewind.operators.order import BUFFER, descents, quantiles

PRICES = ("Open", "High", "Low", "Close")
OHLCV = (*PRICES, "Volume")


class ValidationError(ValueError):
    """Raw or canonical data that breaks a rule."""


class MissingColumnError(ValidationError):
    pass


class EmptyTableError(ValidationError):
    pass


def violations() -> dict[str, Column]:
    """A condition for each kind of impossible bar, with tolerance for rounding."""
    top, bottom = F.greatest("Open", "Close"), F.least("Open", "Close")
    high, low = F.col("High"), F.col("Low")
    return {
        "non_positive_price_rows": any_true([F.col(c) <= 0 for c in PRICES]),
        "invalid_high_low_rows": (high < low) & ~is_close(high, low),
        "invalid_high_rows": (high < top) & ~is_close(high, top),
        "invalid_low_rows": (low > bottom) & ~is_close(low, bottom),
        "negative_volume_rows": F.col("Volume") < 0,
        "zero_volume_rows_to_investigate": F.col("Volume") == 0,
    }


def ohlc_violations(bars: DataFrame) -> DataFrame:
    return bars.agg(*[F.count_if(c).alias(n) for n, c in violations().items()])


def validation_report(bars: DataFrame, gap_days: int = 5) -> DataFrame:
    """One row of ten counts."""
    gap = F.date_diff("Date", F.lag("Date").over(by_date(bars)))
    missing = sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in OHLCV)
    return bars.withColumn("_gap", gap).agg(
        F.count("*").alias("rows"),
        (F.count("Date") - F.count_distinct("Date", *keys(bars))).alias("duplicate_dates"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_values"),
        *[F.count_if(c).alias(n) for n, c in violations().items()],
        F.count_if(F.col("_gap") > gap_days).alias("calendar_gaps_over_5_days"),
    )


def check_columns(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> None:
    if missing := [c for c in wanted if c not in df.columns]:
        raise MissingColumnError(f"columns missing: {', '.join(missing)}")


def check_numeric(df: DataFrame, names: list[str] | tuple[str, ...] = OHLCV) -> None:
    kinds = dict(df.dtypes)
    if wrong := [c for c in names if not kinds[c].startswith(("double", "float", "bigint", "int", "smallint", "tinyint", "decimal"))]:
        raise ValidationError(f"not numeric: {', '.join(wrong)}")


def validate_raw(bars: DataFrame) -> dict:
    """The report, or the first rule that is broken as an error."""
    check_columns(bars, ("Date", *OHLCV))
    check_numeric(bars)
    report = validation_report(bars).first().asDict()
    if not report["rows"]:
        raise EmptyTableError("no rows")
    for rule in ("duplicate_dates", "missing_values", "non_positive_price_rows", "negative_volume_rows", "invalid_high_low_rows", "invalid_high_rows", "invalid_low_rows"):
        if report[rule]:
            raise ValidationError(f"{report[rule]} {rule.replace('_', ' ')}")
    return report


def duplicate_dates(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*keys(rows), "Date").agg(F.count("*").alias("n")).where("n > 1")


def monotonic_check(rows: DataFrame, ordinal: str) -> DataFrame:
    """Neighbours out of order by an ingest ordinal, of each symbol; equal dates are in order."""
    return descents(rows, ordinal, keys(rows)).withColumn("ascending", F.col("n_descending") == 0)


def missing_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Missing values of each column, one pass."""
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in names])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in names])).alias("x")).select("x.*", F.col("n").alias("n_rows"))


def feature_quality(rows: DataFrame, names: list[str]) -> DataFrame:
    """Missing, smallest and largest value of each feature, one pass."""
    aggs = [a for c in names for a in (F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    one = rows.agg(F.count("*").alias("rows"), *aggs)
    parts = [F.struct(F.lit(c).alias("feature"), (F.col("rows") - F.col(f"{c}_n")).alias("n_missing"), F.col(f"{c}_lo").alias("min_value"), F.col(f"{c}_hi").alias("max_value")) for c in names]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def warmup_boundaries(indexed: DataFrame, names: list[str]) -> DataFrame:
    """First row with a value of each feature."""
    at = lambda c, v: F.min(F.when(F.col(c).isNotNull(), F.col(v)))
    one = indexed.agg(*[a for c in names for a in (at(c, "row_idx").alias(f"{c}_i"), at(c, "Date").alias(f"{c}_d"))])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_i").alias("first_valid_idx"), F.col(f"{c}_d").alias("first_valid_date")) for c in names]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def finite_check(rows: DataFrame, names: list[str]) -> DataFrame:
    one = rows.agg(F.count("*").alias("n_rows"), F.count_if(~all_finite(names)).alias("n_not_finite"))
    return one.withColumn("all_finite", (F.col("n_rows") > 0) & (F.col("n_not_finite") == 0))


def regime_domain(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Labels outside the domain, eligible rows without a label, ineligible rows with one."""
    eligible = F.col(cfg.regime.volatility_column).isNotNull() & F.col(cfg.regime.threshold_column).isNotNull()
    return rows.agg(
        F.count_if(F.col("regime").isNotNull() & ~F.col("regime").isin("LowVol", "HighVol")).alias("outside_domain"),
        F.count_if(eligible & F.col("regime").isNull()).alias("unlabelled"),
        F.count_if(~eligible & F.col("regime").isNotNull()).alias("labelled_too_early"),
    )


def canonical_gate(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Counts that are all zero in a sound canonical dataset."""
    check_columns(rows, canonical_columns(cfg))
    names = [*feature_names(cfg.features), cfg.target.column]
    return rows.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("Date", *keys(rows))).alias("repeated_dates"),
        F.count_if(~all_finite(names)).alias("rows_not_finite"),
        F.count_if(~F.coalesce(F.col("regime").isin("LowVol", "HighVol"), F.lit(False))).alias("regime_outside_domain"),
    )


def changed_rows(before: DataFrame, after: DataFrame, names: tuple[str, ...] = ("Date", *OHLCV)) -> DataFrame:
    """Rows of raw columns that features removed or added, as a bag."""
    a, b = before.select(*names), after.select(*names)
    lost = a.exceptAll(b).agg(F.count("*").alias("lost"))
    return lost.crossJoin(b.exceptAll(a).agg(F.count("*").alias("gained")))  # one row each


def same_within(a: DataFrame, b: DataFrame, names: list[str], atol: float = 1e-12, rtol: float = 1e-9) -> DataFrame:
    """Per column, dates at which two tables differ by more than the tolerance or one has no value."""
    by = [*keys(a), "Date"]
    left = a.select(*by, *[F.col(c).alias(f"{c}_a") for c in names])
    both = left.join(b.select(*by, *[F.col(c).alias(f"{c}_b") for c in names]), by, "full_outer")
    differ = lambda c: ~F.coalesce(is_close(F.col(f"{c}_a"), F.col(f"{c}_b"), atol, rtol), F.col(f"{c}_a").isNull() & F.col(f"{c}_b").isNull())
    one = both.agg(F.count("*").alias("n"), *[F.count_if(differ(c)).alias(c) for c in names])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_different")) for c in names])).alias("x")).select("x.*", F.col("n").alias("n_dates"))


def reload_check(made: DataFrame, again: DataFrame, cfg: Config = Config()) -> DataFrame:
    """``(column_name, n_different, n_dates)`` of canonical rows as made and as read again from where they were written."""
    if again.columns != made.columns:
        raise ValidationError(f"columns are {again.columns}, not {made.columns}")
    numbers = same_within(made, again, [*feature_names(cfg.features), cfg.target.column], 1e-14, 1e-12)
    by = [*keys(made), "Date"]
    regimes = made.select(*by, F.col("regime").alias("a")).join(again.select(*by, F.col("regime").alias("b")), by, "full_outer")
    return numbers.unionByName(regimes.agg(F.lit("regime").alias("column_name"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"), F.count("*").alias("n_dates")))


def feature_manual_check(bars: DataFrame, cfg: Config = Config(), rows: DataFrame | None = None) -> DataFrame:
    """``(Date, row_idx, feature, value, by_hand, agrees)``: features and threshold recomputed at three rows of each symbol.

    The rows are the 101st, the middle one and the tenth from the end, as far as there
    are any.  A row's features follow from it and the 60 rows before, which are joined
    by number.  The threshold is right if as many earlier volatilities lie below as
    above it, which counts tell.  ``rows`` are the features to look at, by default
    those of ``bars``.
    """
    by, v, t, f = keys(bars), cfg.regime.volatility_column, cfg.regime.threshold_column, cfg.features
    looked = ["return_5d", "volatility_20d", "trend_60d", "volume_ratio_20d"]
    rows = with_row_index(prepared(bars, cfg) if rows is None else rows).select(*by, "Date", "row_idx", "n_rows", *dict.fromkeys([*looked, v]), t)
    n = F.col("n_rows")
    sample = rows.where(F.col("row_idx").isin(100) | (F.col("row_idx") == F.floor(n / 2)) | (F.col("row_idx") == n - 10))
    back = sample.select(*by, "row_idx", F.explode(F.sequence(F.greatest(F.col("row_idx") - 60, F.lit(0)), "row_idx")).alias("at"))
    past = with_row_index(bars).select(*by, F.col("row_idx").alias("at"), F.col("Close").cast("double").alias("c"), F.col("Volume").cast("double").alias("v"))
    seen = back.join(past, [*by, "at"]).groupBy(*by, "row_idx").agg(F.sort_array(F.collect_list(F.struct("at", "c", "v")), asc=False).alias("w"))  # 61 rows at most
    close, volume = (lambda k: F.get("w", F.lit(k))["c"]), F.transform(F.slice("w", 1, 20), lambda x: x["v"])
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    days = F.array(*[F.try_divide(close(k), close(k + 1)) - 1 for k in range(20)])
    spread = F.sqrt(F.aggregate(F.transform(days, lambda x: (x - mean(days)) * (x - mean(days))), F.lit(0.0), lambda s, x: s + x) / 19)
    full = lambda k, x: F.when(F.size("w") >= k, x)
    closes = F.transform(F.slice("w", 1, 60), lambda x: x["c"])
    hands = seen.select(
        *by,
        "row_idx",
        full(6, F.try_divide(close(0), close(5)) - 1).alias("h0"),
        full(21, spread * F.sqrt(F.lit(float(f.days_per_year)))).alias("h1"),
        full(60, F.try_divide(close(0), mean(closes)) - 1).alias("h2"),
        full(20, F.try_divide(volume[0], mean(volume))).alias("h3"),
    )
    one = sample.select(*by, F.col("row_idx").alias("pos"), F.col(t).alias("t"))
    earlier = rows.where(F.col(v).isNotNull()).select(*by, "row_idx", F.col(v).alias("x"))
    on = F.col("s.pos") > F.col("e.row_idx")
    for k in by:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}"))
    pairs = one.alias("s").join(earlier.alias("e"), on, "left").select("s.*", "x")
    x, m = F.col("x"), F.col("t")
    counts = pairs.groupBy(*by, F.col("pos").alias("row_idx")).agg(
        F.count("x").alias("n"), F.count_if(x < m).alias("less"), F.count_if(x <= m).alias("upto"), F.max(F.when(x < m, x)).alias("lo"), F.max(F.when(x == m, x)).alias("mid"), F.min(F.when(x > m, x)).alias("hi")
    )
    place = lambda r: F.when(r == F.col("less") - 1, F.col("lo")).when((r >= F.col("less")) & (r < F.col("upto")), F.col("mid")).when(r == F.col("upto"), F.col("hi"))
    median_ = (place(F.floor((F.col("n") - 1) / 2)) + place(F.floor(F.col("n") / 2))) / 2
    halves = counts.select(*by, "row_idx", F.when(F.col("n") >= cfg.regime.min_history, median_).alias("h4"), (F.col("n") >= cfg.regime.min_history).alias("due"))
    both = sample.join(hands, [*by, "row_idx"]).join(halves, [*by, "row_idx"])
    each = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"h{i}").alias("by_hand"), (F.lit(False) if c != t else F.col("due")).alias("due")) for i, c in enumerate([*looked, t])]
    long = both.select(*by, "Date", "row_idx", F.explode(F.array(*each)).alias("x")).select(*by, "Date", "row_idx", "x.*")
    agrees = F.coalesce(is_close(F.col("by_hand"), F.col("value"), 1e-12, 1e-12), F.col("by_hand").isNull() & F.col("value").isNull() & ~F.col("due"))
    return long.withColumn("agrees", agrees).drop("due")


def describe(rows: DataFrame, c: str, buffer: int = BUFFER) -> DataFrame:
    """Number, mean, deviation, extremes and exact quartiles of a column."""
    one = rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("std_value"), F.min(c).alias("min_value"), F.max(c).alias("max_value"))
    found = quantiles(rows, F.col(c), [0.25, 0.5, 0.75], buffer)
    q = [F.lit(v).cast("double").alias(n) for v, n in zip(found, ("q25", "q50", "q75"), strict=True)]
    return one.select("n", "mean_value", "std_value", "min_value", *q, "max_value")


def median(rows: DataFrame, c: str, out: str, buffer: int = BUFFER) -> DataFrame:
    """The exact median of a column, one row."""
    return rows.sparkSession.createDataFrame([tuple(quantiles(rows, F.col(c), [0.5], buffer))], f"`{out}` double")


def histogram(rows: DataFrame, c: str, bins: int = 100) -> DataFrame:
    """Counts of equal-width bins from the smallest to the largest value, which falls into the last."""
    v = rows.where(is_finite(F.col(c))).select(F.col(c).alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return v.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def data_dictionary(spark: SparkSession, cfg: Config = Config()) -> DataFrame:
    """What each canonical column is, all of it derived from the configuration."""
    f, t, r = cfg.features, cfg.target, cfg.regime
    late = "rows before the window is full are not published"

    def feature(name: str, formula: str, window: str, unit: str, source: str) -> tuple:
        return (name, "feature", "double", formula, window, "known at the close of t", unit, late, source)

    rows = [("Date", "identifier", "date", "trading date", "none", "prediction date t", "date", "never missing", "raw bars")]
    rows += [feature(f"return_{n}d", f"Close[t] / Close[t-{n}] - 1", f"{n} rows", "decimal return", "Close") for n in (1, *f.return_windows)]
    rows += [feature(f"volatility_{n}d", f"stddev_samp(return_1d[t-{n - 1}..t]) * sqrt({f.days_per_year})", f"{n} rows", "annual volatility", "return_1d") for n in f.volatility_windows]
    rows += [feature(f"trend_{n}d", f"Close[t] / avg(Close[t-{n - 1}..t]) - 1", f"{n} rows", "decimal ratio less one", "Close") for n in f.trend_windows]
    n = f.volume_window
    rows.append(feature(f"volume_ratio_{n}d", f"Volume[t] / avg(Volume[t-{n - 1}..t])", f"{n} rows", "ratio", "Volume"))
    rows.append((t.column, "target", "double", f"Close[t+{t.horizon}] / Close[t] - 1", f"{t.horizon} later rows", "label of t, never a feature", "decimal return", f"the last {t.horizon} rows are not published", "Close"))
    sign = ">=" if r.equality_rule == "HighVol" else ">"
    rule = f"HighVol if {r.volatility_column} {sign} median of earlier {r.volatility_column}, else LowVol"
    rows.append(("regime", "segment label", "string", rule, f"all earlier rows, at least {r.min_history}", "the threshold leaves out t and later", "LowVol or HighVol", "rows without history are not published", r.volatility_column))
    from tidewind.schemas import DICTIONARY

    return spark.createDataFrame(rows, DICTIONARY)


def dictionary_profile(dictionary: DataFrame, rows: DataFrame) -> DataFrame:
    """The dictionary against a stored table: for each column of either its entries, their blank fields, whether the types agree, rows and missing values.

    A column that only the dictionary has has null rows.
    """
    counts = rows.agg(F.count("*").alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(rows.columns)])
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("_stored"), (F.col("n_rows") - F.col(f"_n{i}")).alias("n_missing")) for i, (c, t) in enumerate(rows.dtypes)]
    blank = any_true([F.coalesce(F.trim(c), F.lit("")) == "" for c in dictionary.columns])
    entries = dictionary.groupBy("column").agg(F.count("*").alias("n_entries"), F.count_if(blank).alias("n_blank"), F.max("dtype").alias("_said"))
    both = counts.select("n_rows", F.inline(F.array(*each))).join(entries, "column", "full")
    agrees = F.coalesce(F.col("_stored") == F.col("_said"), F.lit(False)).alias("type_agrees")
    return both.select("column", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_entries", "n_blank")], agrees, "n_rows", "n_missing")


def provenance_record(bars: DataFrame) -> DataFrame:
    """Rows, first and last date, columns and a digest of raw bars.

    The digest is the same in any order of rows: it takes the sum of 60 bits of each
    row's MD5, prices in millionths.
    """
    numbers = [F.col(c) for c in bars.columns if c != "Date"]
    text = F.concat_ws("|", F.col("Date").cast("string"), *[F.coalesce(F.round(c * 1_000_000).cast("long").cast("string"), F.lit("")) for c in numbers])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    one = bars.agg(F.count("*").alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.sum(part).alias("_sum"))
    digest = F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.coalesce(F.col("_sum").cast("string"), F.lit("0"))), 256)
    return one.select("n_rows", "first_date", "last_date", F.lit(",".join(bars.columns)).alias("columns"), digest.alias("digest"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """A content hash that doesn't depend on the order of rows: their number and sums of two hashes of each."""
    cols = [F.col(c) for c in sorted(rows.columns)]
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)"))
    one = rows.agg(F.count("*").alias("n_rows"), h(1).alias("a"), h(2).alias("b"))
    text = F.concat_ws("|", F.lit(",".join(sorted(rows.columns))), "n_rows", F.col("a").cast("string"), F.col("b").cast("string"))
    return one.select("n_rows", F.sha2(text, 256).alias("fingerprint"))


def sampled_dates(dates: DataFrame, k: int = 12, seed: int = 20260824) -> DataFrame:
    """``k`` distinct dates without replacement, by the order of a seeded hash; fewer if there are fewer.

    Each partition keeps its first ``k`` only, so no task sorts all dates.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.date_format("Date", "yyyy-MM-dd")))
    return dates.select("Date").where(F.col("Date").isNotNull()).distinct().orderBy(draw, "Date").limit(k)
