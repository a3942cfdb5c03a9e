"""Point-in-time features, the forward target, volatility regimes and the canonical dataset.

Tables of one symbol have no symbol column; with one, every window is
partitioned by it and symbols are independent.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewind.config import Config, feature_names


def keys(df: DataFrame) -> list[str]:
    return ["symbol"] if "symbol" in df.columns else []


def by_date(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(*keys(df)).orderBy("Date")


def past_return(w: WindowSpec, n: int) -> Column:
    """Close over the close n rows before, less one; null in the first n rows."""
    return F.try_divide(F.col("Close"), F.lag("Close", n).over(w)) - 1


def with_returns(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    w = by_date(bars)
    return bars.withColumns({f"return_{n}d": past_return(w, n) for n in (1, *cfg.features.return_windows)})


def with_trailing(rows: DataFrame, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds for each name the ``mean`` or ``stddev`` of a column's last n rows, null unless all n have a value.

    A frame that slides is summed anew at every row, so its cost is rows times n.  Here
    each row sums a short block that ends with it, and the statistics of n rows are put
    together from the blocks that lie n, n - step, ... rows back: a few lags a row.  Only
    the frame's own values go into a result, no running sum that would carry errors on.
    """
    w, longest = by_date(rows), max(n for _, _, n in wanted.values())
    common = math.gcd(*[n for _, _, n in wanted.values()])
    step = min((d for d in range(1, common + 1) if common % d == 0), key=lambda d: d + longest // d)
    sizes = {kind: {c: max(n for k, d, n in wanted.values() if (k, d) == (kind, c)) for k, c, _ in wanted.values() if k == kind} for kind in ("mean", "stddev")}
    total = lambda xs: reduce(operator.add, xs)

    def lags(of: dict[str, int], by: int) -> dict[str, Column]:
        """The columns ``by``, 2 * ``by``, ... rows back, each once, for frames of so many rows."""
        return {f"_{c}_{i}": F.lag(c, i).over(w) for c, n in of.items() for i in range(by, n, by)}

    def back(c: str, n: int, by: int) -> list[Column]:
        return [F.col(f"_{c}_{i}" if i else c) for i in range(0, n, by)]

    def centre(xs: list[Column]) -> Column:
        """The mean by differences from the first, which is that value if all are alike."""
        return xs[0] + total([x - xs[0] for x in xs[1:]]) / len(xs) if len(xs) > 1 else xs[0]

    def squares(xs: list[Column], middle: Column) -> Column:
        return total([(x - middle) * (x - middle) for x in xs])

    blocks = rows.withColumns(lags(dict.fromkeys([*sizes["mean"], *sizes["stddev"]], step), 1))
    made = {f"sum_{c}": total(back(c, step, 1)) for c in sizes["mean"]} | {f"centre_{c}": centre(back(c, step, 1)) for c in sizes["stddev"]}
    blocks = blocks.withColumns(made).withColumns({f"squares_{c}": squares(back(c, step, 1), F.col(f"centre_{c}")) for c in sizes["stddev"]})
    of = {f"{part}_{c}": n for kind, parts in (("mean", ["sum"]), ("stddev", ["centre", "squares"])) for c, n in sizes[kind].items() for part in parts}
    blocks = blocks.withColumns(lags(of, step))
    blocks = blocks.withColumns({f"_all_{c}_{n}": centre(back(f"centre_{c}", n, step)) for k, c, n in wanted.values() if k == "stddev"})
    found = {}
    for name, (kind, c, n) in wanted.items():
        if kind == "mean":
            found[name] = total(back(f"sum_{c}", n, step)) / n
        else:
            between = squares(back(f"centre_{c}", n, step), F.col(f"_all_{c}_{n}"))
            found[name] = F.sqrt(F.try_divide(total(back(f"squares_{c}", n, step)) + step * between, F.lit(n - 1)))
    return blocks.select(*rows.columns, *[column.alias(name) for name, column in found.items()])


def with_features(bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Bars plus the eleven features; one sort by symbol and date serves all windows."""
    f = cfg.features
    spread = {f"volatility_{n}d": ("stddev", "return_1d", n) for n in f.volatility_windows}
    level = {f"trend_{n}d": ("mean", "Close", n) for n in f.trend_windows}
    volume = {f"volume_ratio_{f.volume_window}d": ("mean", "Volume", f.volume_window)}
    rows = with_trailing(with_returns(bars, cfg), spread | level | volume)
    made = {name: F.col(name) * F.sqrt(F.lit(float(f.days_per_year))) for name in spread}
    made |= {name: F.try_divide(F.col("Close"), F.col(name)) - 1 for name in level}
    return rows.withColumns(made | {name: F.try_divide(F.col("Volume"), F.col(name)) for name in volume})


def with_target(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds the close ``horizon`` rows later over the close, less one; null in the last rows."""
    ahead = F.lead("Close", cfg.target.horizon).over(by_date(rows))
    return rows.withColumn(cfg.target.column, F.try_divide(ahead, F.col("Close")) - 1)


def with_threshold(rows: DataFrame, cfg: Config = Config(), method: str = "grouped", block_days: int = 1024, ranges: int = 64) -> DataFrame:
    """Adds the median of all earlier volatilities, null below ``min_history`` of them.

    ``grouped`` keeps a running median per symbol, n log n in the length of its
    history, which has a row a calendar day at most; ``blocks`` spreads a symbol's
    history over blocks of ``block_days`` days; ``frame`` is one window expression,
    exact too but quadratic, for short histories.
    """
    c, t, least = cfg.regime.volatility_column, cfg.regime.threshold_column, cfg.regime.min_history
    if method == "frame":
        past = by_date(rows).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(t, F.when(F.count(c).over(past) >= least, F.percentile(c, 0.5).over(past)))
    if method == "blocks":
        return _threshold_by_blocks(rows, c, t, least, block_days, ranges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("Date", kind="stable")
        return pdf.assign(**{t: pdf[c].expanding(min_periods=least).median().shift(1)})

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + f", `{t}` double"
    return rows.groupBy(*keys(rows)).applyInPandas(run, schema)


def _threshold_by_blocks(rows: DataFrame, c: str, t: str, least: int, block_days: int, ranges: int) -> DataFrame:
    """The running median block by block.

    A block of n rows moves the median of the rows before it by n ranks at most, so
    it needs only their middle: the 2n + 2 values around their median.  Values are
    cut into ``ranges`` ranges of each symbol; the numbers of values of each block
    and range, summed over earlier blocks, say which ranges hold a block's middle and
    how many values lie below.  Only those ranges' values are sent to the block, equal
    values of a block as one.
    """
    by = keys(rows)
    rows = rows.withColumn("_block", F.floor(F.unix_date("Date") / block_days).cast("int"))
    value = F.when(~F.isnan(c), F.col(c))
    values = rows.select(*by, "_block", value.alias("_v")).where("_v is not null").groupBy(*by, "_block", "_v").agg(F.count("*").alias("_n"))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = values.groupBy(*by).agg(F.percentile_approx("_v", at, F.lit(50 * ranges)).alias("_cuts"))
    ranged = (values.join(cuts, by) if by else values.crossJoin(F.broadcast(cuts))).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    cells = ranged.groupBy(*by, "_block", "_range").agg(F.sum("_n").alias("_n"))
    sizes = rows.groupBy(*by, "_block").agg(F.count("*").alias("_rows")).withColumn("_range", F.lit(-1))
    kinds = {n: k for n, k in rows.dtypes if n in by}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block of a symbol the ranges that it needs, and how many earlier values there are and lie below."""
        blocks = pdf[pdf["_range"] < 0].sort_values("_block")
        counts = pdf[pdf["_range"] >= 0].sort_values("_block")
        made, before, done = [], np.zeros(ranges, dtype=np.int64), 0
        of, cell, n = counts["_block"].to_numpy(), counts["_range"].to_numpy(dtype=np.int64), counts["_n"].to_numpy(dtype=np.int64)
        for block, size in zip(blocks["_block"], blocks["_rows"], strict=True):
            upto = np.searchsorted(of, block)
            np.add.at(before, cell[done:upto], n[done:upto])
            done, total = upto, int(before.sum())
            if not total:
                continue
            trim = max(0, total // 2 - int(size) - 1)
            ends = np.cumsum(before)
            low, high = np.searchsorted(ends, trim, side="right"), np.searchsorted(ends, total - trim)
            below = int(ends[low - 1]) if low else 0
            made += [(block, r, total, below, trim) for r in range(low, high + 1)]
        out = pd.DataFrame(made, columns=["_for", "_range", "_total", "_below", "_trim"])
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out

    key = "".join(f", `{k}` {kinds[k]}" for k in by)
    cells = cells.withColumn("_rows", F.lit(None).cast("long")).unionByName(sizes.withColumn("_n", F.lit(None).cast("long")))
    needs = cells.groupBy(*by).applyInPandas(plan, f"_for int, _range int, _total long, _below long, _trim long{key}")
    sent = ranged.join(needs, [*by, "_range"]).where("_block < _for").select(*by, F.col("_for").alias("_block"), "_v", "_n", "_total", "_below", "_trim")
    own, names = rows.columns, ["_v", "_n", "_total", "_below", "_trim"]
    none = {n: F.lit(None).cast(k) for n, k in sent.dtypes if n in names}
    both = rows.withColumns(none).unionByName(sent, allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        past, mine = pdf[pdf["_n"].notna()].sort_values("_v"), pdf[pdf["_n"].isna()].sort_values("Date", kind="stable")
        middle, total = np.empty(0), 0
        if len(past):
            total, below, trim = (int(past[x].iloc[0]) for x in ("_total", "_below", "_trim"))
            ends = below + past["_n"].cumsum().to_numpy(dtype=np.int64)
            starts = np.append(below, ends[:-1])
            times = np.clip(ends, trim, total - trim) - np.clip(starts, trim, total - trim)
            middle = np.repeat(past["_v"].to_numpy(), times)
        # As many values are left out below as above, so the median of the rest is that of all.
        series = pd.Series(np.concatenate([middle, mine[c].to_numpy(dtype=float)]))
        running = series.expanding(min_periods=1).median().shift(1).to_numpy()[len(middle) :]
        known = total + mine[c].notna().cumsum().shift(1, fill_value=0).to_numpy()
        return mine[[n for n in own if n != "_block"]].assign(**{t: np.where(known >= least, running, np.nan)})

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "_block") + f", `{t}` double"
    out = both.groupBy(*by, "_block").applyInPandas(run, schema)
    return out.withColumn(t, F.when(~F.isnan(t), F.col(t)))


def regime_label(v: Column, threshold: Column, equality_rule: str) -> Column:
    high = v >= threshold if equality_rule == "HighVol" else v > threshold
    return F.when(v.isNull() | threshold.isNull(), F.lit(None).cast("string")).when(high, "HighVol").otherwise("LowVol")


def with_regime(rows: DataFrame, cfg: Config = Config(), method: str = "grouped") -> DataFrame:
    rows = with_threshold(rows, cfg, method)
    return rows.withColumn("regime", regime_label(F.col(cfg.regime.volatility_column), F.col(cfg.regime.threshold_column), cfg.regime.equality_rule))


def prepared(bars: DataFrame, cfg: Config = Config(), method: str = "grouped") -> DataFrame:
    """Bars with features, target, threshold and regime, all rows."""
    return with_regime(with_target(with_features(bars, cfg), cfg), cfg, method)


def canonical_columns(cfg: Config = Config()) -> list[str]:
    return ["Date", *feature_names(cfg.features), cfg.target.column, "regime"]


def canonical(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows in which no feature, target or regime is missing, reduced to the published columns."""
    wanted = canonical_columns(cfg)
    return rows.dropna(how="any", subset=wanted[1:]).select(*keys(rows), *wanted)


def with_row_index(rows: DataFrame) -> DataFrame:
    """Adds ``row_idx`` from 0 in date order and the number ``n_rows`` of its symbol's rows."""
    return rows.withColumns({"row_idx": (F.row_number().over(by_date(rows)) - 1).cast("int"), "n_rows": F.count("*").over(Window.partitionBy(*keys(rows))).cast("int")})


def read_with_lookback(bars: DataFrame, first: str, last: str, cfg: Config = Config()) -> DataFrame:
    """Features and target of the days from ``first`` to ``last`` from just the rows they need.

    Windows look back max(window) rows and ahead ``horizon`` rows.  The date of
    the earliest and latest row needed is found on the Date column alone, so the
    filter below the windows reaches the scan; the wanted days are cut above them.
    """
    f = cfg.features
    back = max(*f.return_windows, *(n + 1 for n in f.volatility_windows), *f.trend_windows, f.volume_window)
    days = bars.select("Date").distinct()
    low = days.where(F.col("Date") < F.lit(first).cast("date")).orderBy(F.col("Date").desc()).limit(back).agg(F.min("Date")).first()[0]
    high = days.where(F.col("Date") > F.lit(last).cast("date")).orderBy("Date").limit(cfg.target.horizon).agg(F.max("Date")).first()[0]
    near = bars
    if low is not None:
        near = near.where(F.col("Date") >= F.lit(low))
    if high is not None:
        near = near.where(F.col("Date") <= F.lit(high))
    return with_target(with_features(near, cfg), cfg).where(F.col("Date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def future_uses(df: DataFrame) -> list[str]:
    """Window frames of an analysed plan that reach past the current row, to prove that features have none."""
    import re

    plan = df._jdf.queryExecution().analyzed().toString()
    return re.findall(r"specifiedwindowframe\(RowFrame, [^,]*, (?!currentrow|-)[^)]*\)|lead\([^)]*\)", plan)


def all_present(rows: DataFrame, names: list[str]) -> Column:
    """Whether none of the columns is null or NaN."""
    doubles = {c for c, t in rows.dtypes if t == "double"}
    found = F.lit(True)
    for c in names:
        found = found & F.col(c).isNotNull() & (~F.isnan(c) if c in doubles else F.lit(True))
    return found
