"""DuckDB SQL for the queries that SQL can express.

Every query is a SELECT over common tables that build up from lineitem: bars,
features, threshold and regime, canonical rows, folds, predictions, errors.
"""

from __future__ import annotations

RETURNS = ("return_1d", "return_5d", "return_10d", "return_20d")
VOLS = ("volatility_5d", "volatility_10d", "volatility_20d")
TRENDS = ("trend_10d", "trend_20d", "trend_60d")
NAMES = (*RETURNS, *VOLS, *TRENDS, "volume_ratio_20d")
TARGET = "forward_return_5d"


def r(*names: str) -> str:
    """Rounded columns."""
    return ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in names)


def per(names: tuple[str, ...], sql: str, sep: str = " UNION ALL ") -> str:
    return sep.join(sql.format(c=c) for c in names)


def bars(symbol: str = "", price: str = "l_extendedprice / l_quantity", where: str = "l_quantity <> 0") -> str:
    s, by = (f"{symbol}::VARCHAR AS symbol, ", "1, 2") if symbol else ("", "1")
    return f"""SELECT {s}l_shipdate::DATE AS "Date", arg_min(px, o) AS "Open", max(px) AS "High", min(px) AS "Low",
      arg_max(px, o) AS "Close", sum(l_quantity) AS "Volume"
    FROM (SELECT *, {price} AS px,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem WHERE {where})
    GROUP BY {by}"""


def feature_tables(source: str, prefix: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    rets = ", ".join(f'"Close" / lag("Close", {n}) OVER w - 1 AS return_{n}d' for n in (1, 5, 10, 20))
    vols = ", ".join(f"CASE WHEN count(return_1d) OVER w{n} = {n} THEN stddev_samp(return_1d) OVER w{n} * sqrt(252.0::DOUBLE) END AS volatility_{n}d" for n in (5, 10, 20))
    trends = ", ".join(f'CASE WHEN count("Close") OVER w{n} = {n} THEN "Close" / avg("Close") OVER w{n} - 1 END AS trend_{n}d' for n in (10, 20, 60))
    frames = ", ".join(f'w{n} AS ({p}ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (5, 10, 20, 60))
    return f"""{prefix}ret AS (SELECT *, {rets} FROM {source} WINDOW w AS ({p}ORDER BY "Date")),
  {prefix}feat AS (SELECT *, {vols}, {trends},
      CASE WHEN count("Volume") OVER w20 = 20 THEN "Volume" / avg("Volume") OVER w20 END AS volume_ratio_20d,
      lead("Close", 5) OVER w / "Close" - 1 AS {TARGET}
    FROM {prefix}ret WINDOW w AS ({p}ORDER BY "Date"), {frames})"""


PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in (*NAMES, TARGET, "regime"))
THRESHOLD = "historical_volatility_threshold_20d"
METRICS = """count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
  CASE WHEN min(y_pred) <> max(y_pred) AND min(y_true) <> max(y_true)
    THEN covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)) END AS prediction_correlation,
  avg(CASE WHEN y_pred <> 0 THEN (sign(y_true) = sign(y_pred))::INT END) AS directional_hit_rate,
  stddev_pop(y_pred) < 1e-6 AS predictions_nearly_constant"""
MADE = "mae, prediction_correlation, directional_hit_rate"

COMMON = f"""WITH bars AS ({bars()}),
  {feature_tables("bars", "")},
  thr AS (SELECT *, CASE WHEN count(volatility_20d) OVER p >= 252 THEN median(volatility_20d) OVER p END AS {THRESHOLD}
    FROM feat WINDOW p AS (ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  prep AS (SELECT *, CASE WHEN volatility_20d IS NULL OR {THRESHOLD} IS NULL THEN NULL
      WHEN volatility_20d >= {THRESHOLD} THEN 'HighVol' ELSE 'LowVol' END AS regime FROM thr),
  canon AS (SELECT "Date", {", ".join(NAMES)}, {TARGET}, regime FROM prep WHERE {PRESENT}),
  idx AS (SELECT *, (row_number() OVER (ORDER BY "Date") - 1)::INT AS row_idx, (count(*) OVER ())::INT AS n_rows FROM canon),
  spec AS (SELECT fold::INT AS fold, n_rows, (1260 + fold * ((n_rows - 1260) // 6))::INT AS test_start_idx,
      (CASE WHEN fold = 5 THEN n_rows ELSE 1260 + (fold + 1) * ((n_rows - 1260) // 6) END)::INT AS test_end_idx
    FROM (SELECT count(*) AS n_rows FROM canon), (SELECT unnest(range(6)) AS fold) WHERE n_rows >= 1266),
  frows AS (SELECT idx.*, fold, CASE WHEN row_idx < test_start_idx - 5 THEN 'train' WHEN row_idx < test_start_idx THEN 'purge'
      WHEN row_idx < test_end_idx THEN 'test' ELSE 'future' END AS role FROM idx, spec),
  tested AS (SELECT * FROM frows WHERE role = 'test'),
  preds AS (
    SELECT 'baseline_zero' AS model, 0 AS model_ordinal, fold, "Date", regime, {TARGET} AS y_true, 0.0::DOUBLE AS y_pred FROM tested
    UNION ALL SELECT 'momentum', 1, fold, "Date", regime, {TARGET}, 0.1::DOUBLE * return_5d FROM tested
    UNION ALL SELECT 'reversal', 2, fold, "Date", regime, {TARGET}, -0.05::DOUBLE * return_20d FROM tested),
  mom AS (SELECT * FROM preds WHERE model = 'momentum'),
  fmet AS (SELECT model, fold, {METRICS}, min("Date") AS test_start_date, max("Date") AS test_end_date FROM preds GROUP BY ALL),
  ftrain AS (SELECT fold, count(*) AS n_train FROM frows WHERE role = 'train' GROUP BY 1),
  overall AS (SELECT model, min(model_ordinal) AS model_ordinal, {METRICS} FROM preds GROUP BY model),
  scoped AS (SELECT model, scope, {METRICS}, min("Date") AS date_start, max("Date") AS date_end
    FROM (SELECT *, unnest(['Overall', regime]) AS scope FROM preds) GROUP BY ALL),
  perf AS (SELECT m.model, s.scope, coalesce(n, 0) AS n, {MADE}, predictions_nearly_constant, date_start, date_end
    FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN (SELECT unnest(['Overall', 'LowVol', 'HighVol']) AS scope) s
    LEFT JOIN scoped USING (model, scope)),
  errs AS (SELECT "Date", y_pred AS prediction, y_true AS actual_return_5d, regime, fold AS fold_id, abs(y_true) AS baseline_abs_error,
      y_true - y_pred AS error, abs(y_true - y_pred) AS abs_error, abs(y_true) AS abs_actual FROM mom),
  kk AS (SELECT round_even(count(*) * 0.01::DOUBLE, 0)::BIGINT AS k FROM errs),
  marked AS (SELECT *, row_number() OVER (ORDER BY abs_error DESC, "Date") <= k AS in_top_errors,
      row_number() OVER (ORDER BY abs_actual DESC, "Date") <= k AS in_top_actuals FROM errs, kk)
"""

LOW_RULE = COMMON.replace(f"volatility_20d >= {THRESHOLD}", f"volatility_20d > {THRESHOLD}")
SUPPLIER = f"""WITH sbars AS ({bars("l_suppkey")}), {feature_tables("sbars", "s", "symbol")}
"""
CLOSE = "abs({a} - {b}) <= 1e-10 + 1e-12 * abs({b})"
TOP, BOTTOM = 'greatest("Open", "Close")', 'least("Open", "Close")'
VIOLATIONS = f"""count(*) FILTER ("Open" <= 0 OR "High" <= 0 OR "Low" <= 0 OR "Close" <= 0) AS non_positive_price_rows,
  count(*) FILTER ("High" < "Low" AND NOT {CLOSE.format(a='"High"', b='"Low"')}) AS invalid_high_low_rows,
  count(*) FILTER ("High" < {TOP} AND NOT {CLOSE.format(a='"High"', b=TOP)}) AS invalid_high_rows,
  count(*) FILTER ("Low" > {BOTTOM} AND NOT {CLOSE.format(a='"Low"', b=BOTTOM)}) AS invalid_low_rows,
  count(*) FILTER ("Volume" < 0) AS negative_volume_rows,
  count(*) FILTER ("Volume" = 0) AS zero_volume_rows_to_investigate"""
FINITE = " AND ".join(f"isfinite({c})" for c in (*NAMES, TARGET))
SHARES = """SELECT {by}, n, n_top, round(n / sum(n) OVER (), 9) + 0.0 AS share, round(n_top / sum(n_top) OVER (), 9) + 0.0 AS top_share
  FROM (SELECT {by}, count(*) AS n, count(*) FILTER (in_top_errors) AS n_top FROM marked GROUP BY 1)"""
OHLCV = '"Open", "High", "Low", "Close", "Volume"'
ROUND_BARS = ", ".join(f'round({c}, 9) + 0.0 AS {c}' for c in OHLCV.split(", "))


def corr(x: str, y: str) -> str:
    return f"CASE WHEN min({x}) <> max({x}) AND min({y}) <> max({y}) THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def boundary(role: str, f: str) -> str:
    return f"""{f}("Date") FILTER (role = '{role}')"""


AUDIT = f"""SELECT fold AS fold_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
  {boundary("train", "min")} AS train_start_date, {boundary("train", "max")} AS train_end_date,
  count(*) FILTER (role = 'purge') AS purge_gap_n_rows, {boundary("purge", "min")} AS purge_gap_start_date, {boundary("purge", "max")} AS purge_gap_end_date,
  {boundary("test", "min")} AS test_start_date, {boundary("test", "max")} AS test_end_date FROM frows GROUP BY 1"""

ON_COMMON: dict[str, str] = {
    "daily_bars": f'SELECT "Date", {ROUND_BARS} FROM bars',
    "provenance_profile": 'SELECT count(*) AS n_rows, min("Date") AS first_date, max("Date") AS last_date, 6::BIGINT AS n_columns FROM bars',
    "sampled_dates": """SELECT "Date" FROM bars ORDER BY md5('20260824|' || strftime("Date", '%Y-%m-%d')), "Date" LIMIT 12""",
    "daily_return": f'SELECT "Date", round("Close", 9) + 0.0 AS "Close", {r("return_1d")} FROM ret',
    "momentum_features": f'SELECT "Date", {r(*RETURNS[1:])} FROM ret',
    "forward_target": f'SELECT "Date", {r(TARGET)} FROM feat',
    "volatility_features": f'SELECT "Date", {r(*VOLS)} FROM feat',
    "volatility_raw": 'SELECT "Date", ' + ", ".join(f'round(volatility_{n}d / sqrt(252.0::DOUBLE), 9) + 0.0 AS "Vol{n}"' for n in (5, 10, 20)) + " FROM feat",
    "trend_features": f'SELECT "Date", {r(*TRENDS)} FROM feat',
    "volume_ratio": f'SELECT "Date", {r("volume_ratio_20d")} FROM feat',
    "feature_range_read": f"""SELECT "Date", {r(*NAMES, TARGET)} FROM feat WHERE "Date" BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    "regime_threshold": f'SELECT "Date", {r("volatility_20d", THRESHOLD)} FROM prep',
    "regime_labels": 'SELECT "Date", regime FROM prep',
    "regime_counts": """SELECT ordinal::INT AS ordinal, regime, count(p.d) AS n, round(count(p.d) / (SELECT count(*) FROM prep), 9) + 0.0 AS share
      FROM (VALUES (0, 'LowVol'), (1, 'HighVol'), (2, 'unlabelled')) v(ordinal, regime)
      LEFT JOIN (SELECT coalesce(regime, 'unlabelled') AS regime, "Date" AS d FROM prep) p USING (regime) GROUP BY 1, 2""",
    "calendar_gaps": 'SELECT "Date", ("Date" - lag("Date") OVER (ORDER BY "Date"))::INT AS gap_days FROM bars',
    "warmup_boundaries": per(NAMES, """SELECT '{c}' AS feature, min(i) FILTER ({c} IS NOT NULL)::INT AS first_valid_idx, min("Date") FILTER ({c} IS NOT NULL) AS first_valid_date
      FROM (SELECT *, row_number() OVER (ORDER BY "Date") - 1 AS i FROM feat)"""),
    "target_manual_check": f"""SELECT a."Date", a.i::INT AS row_idx, round(a.{TARGET}, 9) + 0.0 AS {TARGET}, round(b."Close" / a."Close" - 1, 9) + 0.0 AS by_hand,
      abs(b."Close" / a."Close" - 1 - a.{TARGET}) < 1e-12 AS agrees
      FROM (SELECT *, row_number() OVER (ORDER BY "Date") - 1 AS i, count(*) OVER () AS n FROM feat) a
      JOIN (SELECT "Close", row_number() OVER (ORDER BY "Date") - 1 AS i FROM bars) b ON b.i = a.i + 5
      WHERE a.i IN (0, (a.n - 6) // 2, a.n - 6)""",
    "feature_manual_check": f"""SELECT * FROM (WITH x AS (SELECT *, row_number() OVER (ORDER BY "Date") - 1 AS i, count(*) OVER () AS n FROM prep),
      y AS (SELECT a."Date", a.i, a.return_5d AS v0, a.volatility_20d AS v1, a.trend_60d AS v2, a.volume_ratio_20d AS v3, a.{THRESHOLD} AS v4,
          max(CASE WHEN b.i = a.i - 5 THEN a."Close" / b."Close" - 1 END) AS h0,
          CASE WHEN a.i >= 20 THEN stddev_samp(b.return_1d) FILTER (b.i > a.i - 20) * sqrt(252) END AS h1,
          CASE WHEN a.i >= 59 THEN a."Close" / avg(b."Close") - 1 END AS h2,
          CASE WHEN a.i >= 19 THEN a."Volume" / avg(b."Volume") FILTER (b.i > a.i - 20) END AS h3
        FROM x a JOIN x b ON b.i BETWEEN a.i - 59 AND a.i WHERE a.i IN (100, a.n // 2, a.n - 10)
        GROUP BY a."Date", a.i, a."Close", a."Volume", v0, v1, v2, v3, v4),
      z AS (SELECT y.i, CASE WHEN count(x.volatility_20d) >= 252 THEN median(x.volatility_20d) END AS h4 FROM y LEFT JOIN x ON x.i < y.i GROUP BY y.i),
      s AS (SELECT y.*, z.h4 FROM y JOIN z USING (i))
      """
    + per(
        (("return_5d", 0), ("volatility_20d", 1), ("trend_60d", 2), ("volume_ratio_20d", 3), (THRESHOLD, 4)),
        """SELECT "Date", i::INT AS row_idx, '{c[0]}' AS feature, round(v{c[1]}, 9) + 0.0 AS value, round(h{c[1]}, 9) + 0.0 AS by_hand,
          coalesce(abs(h{c[1]} - v{c[1]}) < 1e-9, h{c[1]} IS NULL AND v{c[1]} IS NULL) AS agrees FROM s""",
    )
    + ")",
    "canonical_round_trip": per(
        (*NAMES, TARGET, "regime"), "SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_different, count(*) AS n_dates FROM canon"
    ),
    "canonical_dataset": f'SELECT "Date", {r(*NAMES, TARGET)}, regime FROM canon',
    "row_accounting": f"""SELECT *, raw_rows - warm_up_rows - tail_rows = canonical_rows AS balances FROM (
      SELECT count(*) AS raw_rows, min(i) FILTER ({PRESENT}) AS warm_up_rows, count(*) FILTER ({TARGET} IS NULL) AS tail_rows,
        count(*) FILTER ({PRESENT}) AS canonical_rows FROM (SELECT *, row_number() OVER (ORDER BY "Date") - 1 AS i FROM prep))""",
    "full_sample_threshold": "SELECT round(median(volatility_20d), 9) + 0.0 AS full_sample_threshold FROM feat",
    "leaky_label_disagreement": """SELECT count(*) AS n_labelled, count(*) FILTER (regime <> CASE WHEN volatility_20d >= t THEN 'HighVol' ELSE 'LowVol' END) AS n_disagree
      FROM prep, (SELECT median(volatility_20d) AS t FROM feat) WHERE regime IS NOT NULL""",
    "return_histogram": """SELECT coalesce(least(floor((return_1d - lo) / nullif(hi - lo, 0) * 100), 99), 0)::INT AS bin, count(*) AS n
      FROM ret, (SELECT min(return_1d) AS lo, max(return_1d) AS hi FROM ret) WHERE return_1d IS NOT NULL GROUP BY 1""",
    "return_describe": """SELECT count(return_1d) AS n, round(avg(return_1d), 9) + 0.0 AS mean_value, round(stddev_samp(return_1d), 9) + 0.0 AS std_value,
      round(min(return_1d), 9) + 0.0 AS min_value, round(quantile_cont(return_1d, 0.25), 9) + 0.0 AS q25, round(quantile_cont(return_1d, 0.5), 9) + 0.0 AS q50,
      round(quantile_cont(return_1d, 0.75), 9) + 0.0 AS q75, round(max(return_1d), 9) + 0.0 AS max_value FROM ret""",
    "missing_counts": per((*NAMES, TARGET), "SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n_rows FROM prep"),
    "feature_quality": per(NAMES, "SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_missing, round(min({c}), 9) + 0.0 AS min_value, round(max({c}), 9) + 0.0 AS max_value FROM feat"),
    "feature_target_corr": per(NAMES, "SELECT '{c}' AS feature, round(" + corr("{c}", TARGET) + ", 9) + 0.0 AS correlation, abs(" + corr("{c}", TARGET) + ") > 0.2 AS suspicious FROM canon"),
    "finite_check": f"SELECT *, n_rows > 0 AND n_not_finite = 0 AS all_finite FROM (SELECT count(*) AS n_rows, count(*) FILTER (NOT ({FINITE})) AS n_not_finite FROM canon)",
    "ohlc_violations": f"SELECT {VIOLATIONS} FROM bars",
    "raw_validation_report": f"""SELECT count(*) AS rows, count("Date") - count(DISTINCT "Date") AS duplicate_dates,
      coalesce(sum(("Open" IS NULL)::INT + ("High" IS NULL)::INT + ("Low" IS NULL)::INT + ("Close" IS NULL)::INT + ("Volume" IS NULL)::INT), 0)::BIGINT AS missing_values,
      {VIOLATIONS}, count(*) FILTER (gap > 5) AS calendar_gaps_over_5_days FROM (SELECT *, "Date" - lag("Date") OVER (ORDER BY "Date") AS gap FROM bars)""",
    "regime_domain_violations": f"""SELECT count(*) FILTER (regime NOT IN ('LowVol', 'HighVol')) AS outside_domain,
      count(*) FILTER (volatility_20d IS NOT NULL AND {THRESHOLD} IS NOT NULL AND regime IS NULL) AS unlabelled,
      count(*) FILTER (NOT (volatility_20d IS NOT NULL AND {THRESHOLD} IS NOT NULL) AND regime IS NOT NULL) AS labelled_too_early FROM prep""",
    "canonical_quality_gate": f"""SELECT count(*) AS rows, count(*) - count(DISTINCT "Date") AS repeated_dates, count(*) FILTER (NOT ({FINITE})) AS rows_not_finite,
      count(*) FILTER (regime IS NULL OR regime NOT IN ('LowVol', 'HighVol')) AS regime_outside_domain FROM canon""",
    "raw_unchanged": f"""SELECT (SELECT count(*) FROM (SELECT "Date", {OHLCV} FROM bars EXCEPT ALL SELECT "Date", {OHLCV} FROM prep)) AS lost,
      (SELECT count(*) FROM (SELECT "Date", {OHLCV} FROM prep EXCEPT ALL SELECT "Date", {OHLCV} FROM bars)) AS gained""",
    "fold_spec": "SELECT fold, greatest(test_start_idx - 5, 0)::INT AS train_end_idx, test_start_idx, test_end_idx, n_rows::INT AS n_rows FROM spec",
    "fold_rows": 'SELECT fold, row_idx, "Date", role FROM frows',
    "fold_boundary_audit": AUDIT,
    "fold_chronology": f"SELECT fold_id, train_end_date, test_start_date, coalesce(train_end_date < test_start_date, true) AS chronological FROM ({AUDIT})",
    "purge_gap_check": """SELECT fold, (test_start_idx - 6)::INT AS last_train_idx, test_start_idx, 5::INT AS gap_rows, test_start_idx - 6 + 5 < test_start_idx AS sufficient FROM spec""",
    "fold_coverage": """SELECT *, n_test_rows = n_distinct_rows AND first_idx = 1260 AND last_idx = n_rows - 1 AND n_test_rows = n_rows - 1260 AS tiles FROM (
      SELECT count(*) AS n_test_rows, count(DISTINCT row_idx) AS n_distinct_rows, min(row_idx)::INT AS first_idx, max(row_idx)::INT AS last_idx, max(n_rows)::INT AS n_rows FROM tested)""",
    "fold_traceability": """SELECT fold_id, count(*) FILTER (t IS NULL) AS n_unexpected, count(*) FILTER (c IS NULL) AS n_missing, count(*) FILTER (c > 1) AS n_repeated,
      count(*) FILTER (t IS NULL) + count(*) FILTER (c IS NULL) + count(*) FILTER (c > 1) = 0 AS traceable
      FROM (SELECT fold AS fold_id, "Date", 1 AS t FROM tested) FULL JOIN
        (SELECT fold AS fold_id, "Date", count(*) AS c FROM preds WHERE model = 'baseline_zero' GROUP BY ALL) USING (fold_id, "Date") GROUP BY 1""",
    "fold_scaler_stats": per(NAMES, "SELECT fold, '{c}' AS feature, count(*) AS n_train, round(avg({c}), 9) + 0.0 AS train_mean, round(stddev_pop({c}), 9) + 0.0 AS train_std FROM frows WHERE role = 'train' GROUP BY 1"),
    "zero_baseline_predictions": f"SELECT fold, \"Date\", regime, {r('y_true', 'y_pred')} FROM preds WHERE model = 'baseline_zero'",
    "all_model_predictions": f'SELECT model, model_ordinal::INT AS model_ordinal, fold, "Date", regime, {r("y_true", "y_pred")} FROM preds',
    "oos_canonical_table": 'SELECT "Date", round(y_pred, 9) + 0.0 AS prediction, round(y_true, 9) + 0.0 AS actual_return_5d, regime, fold AS fold_id FROM mom',
    "oos_manifest": """SELECT count(*) AS n_rows, count(DISTINCT "Date") AS n_dates, count(DISTINCT fold) AS n_folds, count(DISTINCT regime) AS n_regimes,
      min("Date") AS first_date, max("Date") AS last_date FROM mom""",
    "fold_metrics": f"SELECT fold, n AS n_test, {r(*MADE.split(', '))}, predictions_nearly_constant, test_start_date, test_end_date, coalesce(n_train, 0) AS n_train FROM fmet LEFT JOIN ftrain USING (fold) WHERE model = 'momentum'",
    "fold_metrics_vs_baseline": f"""SELECT m.fold, m.n AS n_test, {", ".join(f"round(m.{c}, 9) + 0.0 AS {c}" for c in MADE.split(", "))}, m.predictions_nearly_constant,
      m.test_start_date, m.test_end_date, coalesce(n_train, 0) AS n_train, round(b.mae, 9) + 0.0 AS baseline_zero_mae, round(b.mae - m.mae, 9) + 0.0 AS mae_improvement_over_baseline
      FROM fmet m JOIN fmet b ON m.fold = b.fold AND b.model = 'baseline_zero' LEFT JOIN ftrain t ON t.fold = m.fold WHERE m.model = 'momentum'""",
    "overall_metrics": f"SELECT model, n, {r(*MADE.split(', '))}, predictions_nearly_constant FROM overall",
    "scope_filter": f"SELECT fold, \"Date\", regime, {r('y_true', 'y_pred')} FROM mom WHERE regime = 'HighVol'",
    "regime_performance": f"SELECT model, scope, n, {r(*MADE.split(', '))}, predictions_nearly_constant, date_start, date_end FROM perf",
    "regime_comparison": "SELECT b.scope, b.n, "
    + ", ".join(f"round({s}.{c}, 9) + 0.0 AS {m}_{c}" for s, m in (("b", "baseline_zero"), ("m", "momentum")) for c in MADE.split(", "))
    + ", round(b.mae - m.mae, 9) + 0.0 AS mae_improvement_over_baseline FROM perf b JOIN perf m USING (scope) WHERE b.model = 'baseline_zero' AND m.model = 'momentum'",
    "model_ranking": f"""SELECT model, n, {r(*MADE.split(", "))}, predictions_nearly_constant, (row_number() OVER (ORDER BY overall.mae, model_ordinal))::INT AS rank_by_mae,
      round((SELECT mae FROM overall WHERE model = 'baseline_zero') - overall.mae, 9) + 0.0 AS mae_improvement_over_baseline FROM overall""",
    "best_models": """SELECT (SELECT model FROM overall ORDER BY mae, model_ordinal LIMIT 1) AS best_by_mae,
      (SELECT model FROM overall WHERE prediction_correlation IS NOT NULL ORDER BY prediction_correlation DESC, model_ordinal LIMIT 1) AS best_by_prediction_correlation,
      (SELECT model FROM overall WHERE directional_hit_rate IS NOT NULL ORDER BY directional_hit_rate DESC, model_ordinal LIMIT 1) AS best_by_directional_hit_rate""",
    "same_oos_rows": """SELECT count(*) FILTER (na > 1) AS repeated_a, count(*) FILTER (nb > 1) AS repeated_b, count(*) FILTER (na IS NULL) AS only_b, count(*) FILTER (nb IS NULL) AS only_a,
      count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL AND ra IS DISTINCT FROM rb) AS regime_differs, count(*) FILTER (NOT (abs(ya - yb) <= 1e-8 + 1e-5 * abs(yb))) AS target_differs
      FROM (SELECT "Date", count(*) AS na, min(regime) AS ra, min(y_true) AS ya FROM preds WHERE model = 'baseline_zero' GROUP BY 1)
      FULL JOIN (SELECT "Date", count(*) AS nb, min(regime) AS rb, min(y_true) AS yb FROM mom GROUP BY 1) USING ("Date")""",
    "in_sample_predictions": f"""SELECT (m.fold + 1)::INT AS fold, m."Date", m.regime, {r("y_true", "y_pred")} FROM mom m
      WHERE NOT EXISTS (SELECT 1 FROM tested t WHERE t.fold = m.fold + 1 AND t."Date" = m."Date")""",
    "oos_errors": f'SELECT "Date", {r("prediction", "actual_return_5d")}, regime, fold_id, {r("baseline_abs_error", "error", "abs_error", "abs_actual")} FROM errs',
    "top_errors": f'SELECT "Date", fold_id, regime, {r("actual_return_5d", "prediction", "error", "abs_error")} FROM marked WHERE in_top_errors',
    "top_overlap": """SELECT count(*) FILTER (in_top_errors) AS k, count(*) FILTER (in_top_errors AND in_top_actuals) AS n_overlap,
      count(*) FILTER (in_top_errors AND NOT in_top_actuals) AS n_error_only FROM marked""",
    "error_only_dates": f"""SELECT "Date", {r("actual_return_5d", "prediction", "abs_error")}, sign(marked.actual_return_5d) <> sign(marked.prediction) AS sign_mismatch
      FROM marked WHERE in_top_errors AND NOT in_top_actuals""",
    "sign_mismatch": """SELECT count(*) AS n_error_only, count(*) FILTER (sign(actual_return_5d) <> sign(prediction)) AS n_sign_mismatch
      FROM marked WHERE in_top_errors AND NOT in_top_actuals""",
    "error_clusters": """SELECT cluster::INT AS cluster, n_dates, start_date, end_date, row_number() OVER (ORDER BY n_dates DESC, start_date) = 1 AS largest FROM (
      SELECT cluster, count(*) AS n_dates, min("Date") AS start_date, max("Date") AS end_date FROM (
        SELECT "Date", sum(s) OVER (ORDER BY "Date") AS cluster FROM (
          SELECT "Date", coalesce(("Date" - lag("Date") OVER (ORDER BY "Date") > 10)::INT, 1) AS s FROM marked WHERE in_top_errors)) GROUP BY 1)""",
    "fold_share": SHARES.format(by="fold_id"),
    "regime_share": SHARES.format(by="regime"),
    "regime_error_stats": "SELECT regime, count(*) AS n, round(avg(abs_error), 9) + 0.0 AS mae, round(avg(abs_actual), 9) + 0.0 AS mean_abs_actual FROM errs GROUP BY 1",
    "error_correlations": f"SELECT round({corr('abs_actual', 'abs_error')}, 9) + 0.0 AS pearson_actual_error, round({corr('abs_error', 'baseline_abs_error')}, 9) + 0.0 AS pearson_error_baseline_error FROM errs",
    "spearman_corr": f"""SELECT round({corr("a", "e")}, 9) + 0.0 AS spearman_actual_error FROM (
      SELECT rank() OVER (ORDER BY abs_actual) + (count(*) OVER (PARTITION BY abs_actual) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (ORDER BY abs_error) + (count(*) OVER (PARTITION BY abs_error) - 1) / 2.0::DOUBLE AS e FROM errs)""",
    "enrichment_test": """, c AS (SELECT count(*) AS n, count(*) FILTER (regime = 'HighVol') AS s, count(*) FILTER (in_top_errors) AS k,
        count(*) FILTER (in_top_errors AND regime = 'HighVol') AS x FROM marked),
      tail AS (SELECT sum(exp(lgamma(s + 1) - lgamma(i + 1) - lgamma(s - i + 1) + lgamma(n - s + 1) - lgamma(k - i + 1) - lgamma(n - s - k + i + 1)
        - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) AS p FROM (SELECT *, unnest(range(x, least(k, s) + 1)) AS i FROM c))
      SELECT n AS n_total, s AS n_regime, k, x AS n_regime_top, round(k * (s / n), 9) + 0.0 AS expected,
        round(sqrt(k * (s / n) * (1 - s / n) * (n - k) / (n - 1)), 9) + 0.0 AS sd, round(p, 9) + 0.0 AS p_value FROM c, tail""",
}

EXTRA = {
    "regime_labels_lowvol_rule": LOW_RULE + 'SELECT "Date", regime FROM prep',
    "scan_bars": """SELECT l_shipdate::DATE AS "Date", l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'""",
    "supplier_bars": SUPPLIER + f'SELECT symbol, "Date", {ROUND_BARS} FROM sbars',
    "supplier_features": SUPPLIER + f'SELECT symbol, "Date", {r(*NAMES)} FROM sfeat',
    "duplicate_dates": 'SELECT o_orderdate::DATE AS "Date", count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1',
    "monotonic_check": """SELECT symbol, count(*) AS n_rows, count(*) FILTER (back) AS n_descending, count(*) FILTER (back) = 0 AS ascending FROM (
      SELECT o_orderstatus AS symbol, lag(o_orderdate::DATE) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) > o_orderdate::DATE AS back FROM orders) GROUP BY 1""",
    "event_bars": """SELECT ts::DATE AS "Date", round(arg_min(value, row(ts, event_id)), 9) + 0.0 AS "Open", round(max(value), 9) + 0.0 AS "High", round(min(value), 9) + 0.0 AS "Low",
      round(arg_max(value, row(ts, event_id)), 9) + 0.0 AS "Close", count(*) AS "Volume" FROM events GROUP BY 1""",
    "event_sessions": """SELECT event_type, min(ts) AS start_ts, max(ts) + INTERVAL 5 MINUTE AS end_ts, count(*) AS n_events, round(sum(value), 9) + 0.0 AS total FROM (
      SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM (
        SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) >= INTERVAL 5 MINUTE)::INT, 1) AS s FROM events)) GROUP BY event_type, session""",
}


EXTRA["status_names"] = """SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, count(*) AS n_orders
      FROM orders GROUP BY 1"""


ON_COMMON["csv_bars"] = ON_COMMON["daily_bars"]

EXTRA["market_source"] = f"""SELECT "Date", {ROUND_BARS} FROM ({bars(price="l_extendedprice / l_quantity * (1 - l_discount)",
      where="l_quantity <> 0 AND l_suppkey = 1 AND l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'")})"""

ON_COMMON["provenance_record"] = """SELECT count(*) AS n_rows, min("Date") AS first_date, max("Date") AS last_date, 'Date,Open,High,Low,Close,Volume' AS columns,
      sha256(count(*)::VARCHAR || '|' || coalesce(sum(('0x' || substr(md5(line), 1, 15))::UBIGINT), 0)::VARCHAR) AS digest FROM (
        SELECT "Date", concat_ws('|', "Date"::VARCHAR, """ + ", ".join(f"""coalesce(round("{c}" * 1000000)::BIGINT::VARCHAR, '')""" for c in ("Open", "High", "Low", "Close", "Volume")) + """) AS line FROM bars)"""

#: One entry for each stored column and the type it should have.
STORED = {"Date": "DATE", **dict.fromkeys((*NAMES, TARGET), "DOUBLE"), "regime": "VARCHAR"}
ON_COMMON["dictionary_coverage"] = f""", stored AS ({ON_COMMON["canonical_dataset"]}) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 1::BIGINT AS n_entries, 0::BIGINT AS n_blank, coalesce(typeof(any_value("{c}")) = '{t}', false) AS type_agrees,
      count(*) AS n_rows, count(*) FILTER ("{c}" IS NULL) AS n_missing FROM stored""" for c, t in STORED.items())

#: Features and threshold of each sampled day from bars up to it alone, against those of all bars.
ON_COMMON["point_in_time_rebuild"] = f""", days AS ({ON_COMMON["sampled_dates"]}), cut AS (SELECT bars.*, days."Date" AS as_of FROM bars JOIN days ON bars."Date" <= days."Date"),
  {feature_tables("cut", "c", "as_of")},
  cthr AS (SELECT *, CASE WHEN count(volatility_20d) OVER p >= 252 THEN median(volatility_20d) OVER p END AS {THRESHOLD}
    FROM cfeat WINDOW p AS (PARTITION BY as_of ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  again AS (SELECT *, CASE WHEN volatility_20d IS NULL OR {THRESHOLD} IS NULL THEN NULL WHEN volatility_20d >= {THRESHOLD} THEN 'HighVol' ELSE 'LowVol' END AS regime
    FROM cthr WHERE "Date" = as_of)
  SELECT "Date", ({" + ".join(f"(NOT coalesce(abs(a.{c} - b.{c}) <= 1e-12 + 1e-9 * abs(b.{c}), a.{c} IS NULL AND b.{c} IS NULL))::INT" for c in NAMES)})::INT AS n_features_changed,
    a.regime IS DISTINCT FROM b.regime AS regime_changed FROM again a JOIN prep b USING ("Date")"""

ON_COMMON["integrity_gate"] = f"""SELECT 'chronology' AS check_name, count(*) FILTER (NOT chronological) AS n_violations FROM ({ON_COMMON["fold_chronology"]})
  UNION ALL SELECT 'purge', count(*) FILTER (NOT sufficient) FROM ({ON_COMMON["purge_gap_check"]})
  UNION ALL SELECT 'in_sample', count(*) FROM mom m WHERE NOT EXISTS (SELECT 1 FROM tested t WHERE t.fold = m.fold AND t."Date" = m."Date")
  UNION ALL SELECT 'traceability', count(*) FILTER (NOT traceable) FROM ({ON_COMMON["fold_traceability"].replace("model = 'baseline_zero'", "model = 'momentum'")})
  UNION ALL SELECT 'same_rows', (repeated_a + repeated_b + only_a + only_b + regime_differs + target_differs)::BIGINT FROM ({ON_COMMON["same_oos_rows"]})"""


def oracle_sql() -> dict[str, str]:
    return {name: COMMON + sql for name, sql in ON_COMMON.items()} | EXTRA
