"""Analysis of the largest out-of-sample errors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewind.functions.exprs import safe_corr
from tidewind.operators.features import keys
from tidewind.operators.order import BUFFER, average_rank, islands, largest, plain

TOP_SHARE = 0.01
CLUSTER_DAYS = 10


def with_errors(oos: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds error, abs_error, abs_actual and the baseline's absolute error of the date, and symbol if there is one (null if it has none)."""
    by = [*keys(oos), "Date"]
    b = baseline.select(*by, F.abs("y_true").alias("baseline_abs_error"))
    e = F.col("actual_return_5d") - F.col("prediction")
    return oos.join(b, by, "left").withColumns({"error": e, "abs_error": F.abs(e), "abs_actual": F.abs("actual_return_5d")})


def top_count(n: int, share: float = TOP_SHARE) -> int:
    """Half-even rounding of n * share."""
    return round(n * share)


def ranked(errors: DataFrame, share: float = TOP_SHARE, buffer: int = BUFFER) -> DataFrame:
    """Adds in_top_errors and in_top_actuals: among the k rows with the largest values, equal values by date.

    k is the rounded share of all rows; the k largest are told by a comparison with
    the kth value, so neither is anything sorted nor joined.
    """
    names = ("abs_error", "abs_actual")
    n, *values = errors.agg(F.count("*"), *[F.count(plain(F.col(c))) for c in names]).first()
    k, then = top_count(n, share), ["Date", *keys(errors)]
    marks = [largest(errors, c, k, m, then, buffer) for c, m in zip(names, values, strict=True)]
    return errors.withColumns(dict(zip(("in_top_errors", "in_top_actuals"), marks, strict=True)))


def top_errors(errors: DataFrame, share: float = TOP_SHARE, buffer: int = BUFFER) -> DataFrame:
    n, values = errors.agg(F.count("*"), F.count(plain(F.col("abs_error")))).first()
    top = errors.where(largest(errors, "abs_error", top_count(n, share), values, ["Date", *keys(errors)], buffer))
    return top.select(*keys(errors), "Date", "fold_id", "regime", "actual_return_5d", "prediction", "error", "abs_error")


def top_overlap(marked: DataFrame) -> DataFrame:
    both = F.col("in_top_errors") & F.col("in_top_actuals")
    return marked.agg(
        F.count_if("in_top_errors").alias("k"),
        F.count_if(both).alias("n_overlap"),
        F.count_if(F.col("in_top_errors") & ~F.col("in_top_actuals")).alias("n_error_only"),
    )


def error_only(marked: DataFrame) -> DataFrame:
    """Rows with a large error but not a large move."""
    rows = marked.where(F.col("in_top_errors") & ~F.col("in_top_actuals"))
    return rows.select(*keys(rows), "Date", "actual_return_5d", "prediction", "abs_error", (F.signum("actual_return_5d") != F.signum("prediction")).alias("sign_mismatch"))


def clusters(top: DataFrame, days: int = CLUSTER_DAYS) -> DataFrame:
    """Runs of top dates with gaps of at most ``days`` calendar days; ``largest`` marks the longest, the earliest of equals.

    With a symbol column the runs are those of each symbol.
    """
    by = keys(top)
    runs = islands(top.select(*by, "Date"), days, by).groupBy(*by, "cluster")
    out = runs.agg(F.count("*").alias("n_dates"), F.min("Date").alias("start_date"), F.max("Date").alias("end_date"))
    size = F.struct("n_dates", -F.unix_date("start_date"))
    best = out.groupBy(*by).agg(F.max(size).alias("_best"))
    both = out.join(best, by) if by else out.crossJoin(F.broadcast(best))  # one row
    return both.withColumn("largest", size == F.col("_best")).drop("_best")


def shares(marked: DataFrame, by: str) -> DataFrame:
    """Share of each value among all rows and among the top errors."""
    every = Window.partitionBy()
    g = marked.groupBy(by).agg(F.count("*").alias("n"), F.count_if("in_top_errors").alias("n_top"))
    return g.withColumns({"share": F.col("n") / F.sum("n").over(every), "top_share": F.try_divide(F.col("n_top"), F.sum("n_top").over(every))})


def regime_stats(errors: DataFrame) -> DataFrame:
    return errors.groupBy("regime").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("abs_actual").alias("mean_abs_actual"))


def correlations(errors: DataFrame) -> DataFrame:
    """Pearson and Spearman between move and error, and Pearson between error and baseline error."""
    r = average_rank(average_rank(errors, "abs_actual", "actual_rank"), "abs_error", "error_rank")
    return r.agg(
        safe_corr(F.col("abs_actual"), F.col("abs_error")).alias("pearson_actual_error"),
        safe_corr(F.col("actual_rank"), F.col("error_rank")).alias("spearman_actual_error"),
        safe_corr(F.col("abs_error"), F.col("baseline_abs_error")).alias("pearson_error_baseline_error"),
    )


def _ratios(at: np.ndarray, population: int, successes: int, draws: int) -> np.ndarray:
    """P(X = i + 1) / P(X = i) of the hypergeometric law."""
    i = at.astype(float)
    return (successes - i) / (i + 1) * ((draws - i) / (population - successes - draws + i + 1))


def _sum_from(start: int, end: int, step: int, law: tuple[int, int, int], part: int = 1 << 16) -> float:
    """P(X = start) + P(X = start + step) + ... up to ``end``, over P(X = start); stops where terms no longer count."""
    total, term, at = 1.0, 1.0, start
    while at != end and term > 1e-25 * total:
        n = min(part, abs(end - at))
        here = at + step * np.arange(n) if step > 0 else at - 1 - np.arange(n)
        ratios = _ratios(here, *law) if step > 0 else 1 / _ratios(here, *law)
        terms = term * np.cumprod(ratios)
        total, term, at = total + math.fsum(terms), float(terms[-1]), at + step * n
    return total


def upper_tail(population: int, successes: int, draws: int, observed: int) -> float:
    """P(X >= observed) of the hypergeometric law.

    Terms follow from one another by their ratios, so no factorial is needed: the
    sum of the tail over the sum of all, both positive.  Each ratio is good to a few
    units in the last place, so the relative error is below about 1e-15 times the
    number of terms between the mode and the end of the tail that counts, some
    forty standard deviations or the way from the mode to ``observed``.
    """
    law = (population, successes, draws)
    low, high = max(0, successes + draws - population), min(successes, draws)
    if observed <= low:
        return 1.0
    if observed > high:
        return 0.0
    mode = min(high, max(low, (successes + 1) * (draws + 1) // (population + 2)))
    up, down = _sum_from(mode, high, 1, law), _sum_from(mode, low, -1, law) - 1
    if observed <= mode:
        return (up + _sum_from(mode, observed, -1, law) - 1) / (up + down)
    logs = [math.fsum(np.log(_ratios(np.arange(a, min(observed, a + (1 << 16))), *law))) for a in range(mode, observed, 1 << 16)]
    return math.exp(math.fsum(logs)) * _sum_from(observed, high, 1, law) / (up + down)


def enrichment(marked: DataFrame, regime: str = "HighVol") -> DataFrame:
    """Is a regime over-represented among the top errors?  Counts, moments under the null and the exact tail."""
    counts = marked.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("regime") == regime).alias("n_regime"),
        F.count_if("in_top_errors").alias("k"),
        F.count_if(F.col("in_top_errors") & (F.col("regime") == regime)).alias("n_regime_top"),
    )
    n, s, k, x = counts.first()  # four numbers
    share = s / n if n else None
    mean = k * share if n else None
    sd = math.sqrt(k * share * (1 - share) * (n - k) / (n - 1)) if n and n > 1 else None
    p = upper_tail(n, s, k, x) if n else None
    row = [(n, s, k, x, mean, sd, p)]
    return marked.sparkSession.createDataFrame(row, "n_total long, n_regime long, k long, n_regime_top long, expected double, sd double, p_value double")
