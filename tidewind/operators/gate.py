"""Integrity gate over published tables: five checks and one verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.config import Config, feature_names
from tidewind.operators import evaluate, folds, quality
from tidewind.operators.features import canonical, keys, prepared


def in_sample(predictions: DataFrame, rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Predictions of dates that are not in their fold's test block."""
    by = ["fold", *keys(rows), "Date"]
    return predictions.join(folds.test_rows(rows, cfg).select(*by), by, "left_anti")


def point_in_time(bars: DataFrame, as_of: list[str], cfg: Config = Config(), published: DataFrame | None = None) -> DataFrame:
    """Features and regime of each day rebuilt from bars up to that day against the published ones, by default those built from all bars.

    Each truncated history is a symbol of its own, so all days are rebuilt by one plan.
    """
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in as_of]))
    cut = bars.withColumn("as_of", days).where("Date <= as_of").withColumn("symbol", F.date_format("as_of", "yyyy-MM-dd")).drop("as_of")
    names = feature_names(cfg.features)
    again = prepared(cut, cfg).where(F.date_format("Date", "yyyy-MM-dd") == F.col("symbol"))
    full = prepared(bars, cfg) if published is None else published
    pick = lambda df, s: df.select("Date", *[F.col(c).alias(f"{c}_{s}") for c in [*names, "regime"]])
    both = pick(again, "a").join(pick(full, "b"), "Date")
    from tidewind.functions.exprs import is_close

    off = [(~F.coalesce(is_close(F.col(f"{c}_a"), F.col(f"{c}_b"), 1e-12, 1e-9), F.col(f"{c}_a").isNull() & F.col(f"{c}_b").isNull())).cast("int") for c in names]
    return both.select("Date", sum(off).alias("n_features_changed"), (~F.col("regime_a").eqNullSafe(F.col("regime_b"))).alias("regime_changed"))


def gate_counts(predictions: DataFrame, rows: DataFrame, baseline: DataFrame | None, cfg: Config = Config()) -> DataFrame:
    """``(check_name, n_violations)`` of the checks that need no raw bars."""
    one = lambda name, df, cond: df.agg(F.count_if(cond).alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
    out = one("chronology", folds.chronology(rows, cfg), ~F.col("chronological"))
    out = out.unionByName(one("purge", folds.purge_check(folds.fold_spec(rows, cfg), cfg), ~F.col("sufficient")))
    out = out.unionByName(one("in_sample", in_sample(predictions, rows, cfg), F.lit(True)))
    out = out.unionByName(one("traceability", folds.traceability(predictions, rows, cfg), ~F.col("traceable")))
    if baseline is not None:
        f = evaluate.same_rows(predictions, baseline)
        total = sum(F.col(c) for c in f.columns)
        out = out.unionByName(f.select(F.lit("same_rows").alias("check_name"), total.alias("n_violations")))
    return out


def audit(bars: DataFrame | None, predictions: DataFrame | None, baseline: DataFrame | None, cfg: Config = Config(), samples: int = 5) -> dict:
    """Gate report.  A missing table blocks; a violation fails; else the gate passes."""
    if missing := [n for n, t in (("bars", bars), ("predictions", predictions), ("baseline", baseline)) if t is None]:
        return {"verdict": "BLOCKED", "violations": [], "checks_passed": [], "missing": missing}
    rows = canonical(prepared(bars, cfg), cfg)
    counts = {r["check_name"]: r["n_violations"] for r in gate_counts(predictions, rows, baseline, cfg).collect()}
    n = rows.count()
    dates = folds.with_row_index(rows).where(F.col("row_idx").isin([i * (n - 1) // max(1, samples - 1) for i in range(samples)])).select(F.date_format("Date", "yyyy-MM-dd")).collect()
    moved = point_in_time(bars, [d[0] for d in dates], cfg) if dates else None
    counts["point_in_time"] = moved.where("n_features_changed > 0 or regime_changed").count() if moved is not None else 0
    counts["canonical"] = sum(v for k, v in quality.canonical_gate(rows, cfg).first().asDict().items() if k != "rows")
    bad = sorted(k for k, v in counts.items() if v)
    return {"verdict": "FAIL" if bad else "PASS", "violations": bad, "checks_passed": sorted(set(counts) - set(bad)), "missing": [], "counts": counts}
