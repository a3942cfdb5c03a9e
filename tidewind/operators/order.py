"""Order statistics of columns too large for one task.

Ranks go by ranges of the value: each range is put in order by itself and starts
at the number of rows in the ranges below.  Single ranks (quantiles, the k
largest) need no order at all: passes of a sketch and of exact counts narrow the
interval that holds them until it has no more rows than a buffer.  Sequences in
time go by blocks of the calendar or of an ordinal, each compared with the last
row of the block before.  No window here is without a partition, apart from
those over one row for each block.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a selection may bring to the driver.
BUFFER = 10_000


def plain(v: Column) -> Column:
    """A double that a sketch can take: null instead of NaN."""
    d = v.cast("double")
    return F.when(~F.isnan(d), d)


def average_rank(rows: DataFrame, value: str, out: str, ranges: int = 64) -> DataFrame:
    """Adds the rank of a value, equal values sharing the mean of their ranks; null comes first, NaN last.

    Only distinct values are put in order, in ``ranges`` ranges of about equal
    numbers of them; a value that many rows share is one row of them.
    """
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = counts.agg(F.percentile_approx(plain(F.col("_v")), at, F.lit(50 * ranges)).alias("_cuts"))
    mine = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))
    ranged = counts.crossJoin(F.broadcast(cuts)).select("_v", "_n", mine.alias("_range"))  # cuts is one row
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    sizes = sizes.agg(F.collect_list(F.struct("_range", "_size")).alias("_sizes"))  # one entry for each range
    below = F.aggregate(F.filter("_sizes", lambda s: s["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda n, s: n + s["_size"])
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("_v"))
    ranks = ranged.crossJoin(F.broadcast(sizes)).select("_v", (below + upto - (F.col("_n") - 1) / 2).alias(out))  # sizes is one row
    return rows.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def select(rows: DataFrame, value: Column, ranks: list[int], n: int, buffer: int = BUFFER, accuracy: int = 10_000) -> list[tuple[float, int, int]]:
    """For each rank (0 is the smallest) its value and how many values are less and at most that, exactly.

    ``n`` is the number of values that are neither null nor NaN; others don't count.
    Each pass brackets every open rank by a sketch of the values in its interval,
    then counts exactly how many lie below and at the ends; the interval narrows
    to what is between them.  At most ``buffer`` values of an interval are read.
    """
    if not all(0 <= r < n for r in ranks):
        raise IndexError(f"no such rank among {n} values")
    held = rows.select(plain(value).alias("v")).where("v is not null")
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("v") > lo) & (F.lit(True) if hi is None else F.col("v") < hi)
    found: dict[int, tuple[float, int, int]] = {}
    open_ = {r: (None, None, 0, n) for r in ranks}  # the values around the interval, rows up to it, rows inside
    while open_:
        for lo, hi, below in {(lo, hi, below) for lo, hi, below, size in open_.values() if size <= buffer}:
            values = sorted(x["v"] for x in held.where(inside(lo, hi)).collect())
            for r in [r for r, s in open_.items() if s[:3] == (lo, hi, below)]:
                v = values[r - below]
                found[r] = (v, below + bisect_left(values, v), below + bisect_right(values, v))
                del open_[r]
        if not open_:
            break
        wanted = list(open_)
        share = {r: (r - below + 0.5) / size for r, (_, _, below, size) in open_.items()}
        near = [[F.lit(min(1.0, max(0.0, share[r] + d / accuracy))) for d in (-2, 0, 2)] for r in wanted]
        sketches = [F.percentile_approx(F.when(inside(*open_[r][:2]), F.col("v")), F.array(*p), F.lit(accuracy)) for r, p in zip(wanted, near, strict=True)]
        cuts = held.agg(*[s.alias(f"c{i}") for i, s in enumerate(sketches)]).first()
        ends = sorted({c for got in cuts for c in got})
        counts = held.agg(*[a for i, c in enumerate(ends) for a in (F.count_if(F.col("v") < c).alias(f"l{i}"), F.count_if(F.col("v") <= c).alias(f"u{i}"))]).first()
        less, upto = {c: counts[f"l{i}"] for i, c in enumerate(ends)}, {c: counts[f"u{i}"] for i, c in enumerate(ends)}
        for r in wanted:
            lo, hi, below, size = open_[r]
            over = below + size  # rows below the interval's upper end
            for c in ends:
                if less[c] <= r < upto[c]:
                    found[r] = (c, less[c], upto[c])
                elif upto[c] <= r and (lo is None or c > lo):
                    lo, below = c, upto[c]
                elif less[c] > r and (hi is None or c < hi):
                    hi, over = c, less[c]
            if r in found:
                del open_[r]
            else:
                open_[r] = (lo, hi, below, over - below)
    return [found[r] for r in ranks]


def quantiles(rows: DataFrame, value: Column, shares: list[float], buffer: int = BUFFER) -> list[float | None]:
    """Exact quantiles, neighbouring values interpolated; null where there is no value."""
    n = rows.agg(F.count(plain(value))).first()[0]
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    at = {r: v for r, (v, _, _) in zip(ranks, select(rows, value, ranks, n, buffer), strict=True)}
    return [at[int(p)] + (p - int(p)) * (at[min(int(p) + 1, n - 1)] - at[int(p)]) for p in places]


def largest(rows: DataFrame, value: str, k: int, n: int, then: list[str], buffer: int = BUFFER) -> Column:
    """Whether a row is one of the ``k`` with the largest of ``n`` values; of equal values the first by date, then by symbol.

    ``then`` is the date column and, if there is one, the symbol's.  The condition
    compares with three values at most, found by ``select``; rows without a value
    are never among the largest and don't count in ``n``.
    """
    v, day = plain(F.col(value)), F.unix_date(then[0])
    if k <= 0 or n == 0:
        return F.lit(False)
    if k >= n:
        return v.isNotNull()
    ((t, less, upto),) = select(rows, F.col(value), [n - k], n, buffer)
    if n - less == k:
        return F.coalesce(v >= t, F.lit(False))
    ties, missing = rows.where(v == t), k - (n - upto)
    ((last, early, there),) = select(ties, day, [missing - 1], upto - less, buffer)
    at_last = day == int(last)
    if there > missing and len(then) > 1:  # of one date's equal values the first symbols
        names = ties.where(at_last).orderBy(then[1]).limit(missing - early)
        at_last = at_last & (F.col(then[1]) <= F.lit(names.agg(F.max(then[1])).first()[0]))
    return F.coalesce((v > t) | ((v == t) & ((day < int(last)) | at_last)), F.lit(False))


def islands(rows: DataFrame, days: int, keys: list[str], block: int = 1024) -> DataFrame:
    """``rows(Date)`` with ``cluster``: from 1 in date order, a new one after a gap of more than ``days`` days.

    Dates meet in blocks of ``block`` calendar days; a block's first date is
    compared with the last one of the block before, and clusters are numbered on
    from the number of starts before the block.
    """
    blocks = rows.withColumn("_block", F.floor(F.unix_date("Date") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("Date")
    marked = blocks.withColumn("_back", F.lag("Date").over(inside)).withColumn("_starts", F.coalesce((F.date_diff("Date", "_back") > days).cast("int"), F.lit(0)))
    ends = marked.groupBy(*keys, "_block").agg(F.min("Date").alias("_first"), F.max("Date").alias("_last"), F.sum("_starts").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_block")  # a row for each block
    opens = F.coalesce((F.date_diff("_first", F.lag("_last").over(order)) > days).cast("int"), F.lit(1))
    ends = ends.withColumn("_opens", opens)
    ends = ends.select(*keys, "_block", (F.sum(F.col("_opens") + F.col("_n")).over(order) - F.col("_n")).alias("_from"))
    numbered = marked.join(ends, [*keys, "_block"])
    return numbered.withColumn("cluster", (F.col("_from") + F.sum("_starts").over(inside)).cast("int")).drop("_block", "_back", "_starts", "_from")


def descents(rows: DataFrame, ordinal: str, keys: list[str], block: int = 1 << 20) -> DataFrame:
    """``(keys, n_rows, n_descending)``: neighbours by an integer ordinal whose date goes back; equal dates don't.

    Rows meet in blocks of ``block`` ordinals, so a task's size depends on neither
    the number of keys nor of rows; the first date of a block is compared with the
    last one of the block before.  Rows of one ordinal are neighbours by date.
    """
    blocks = rows.select(*keys, "Date", F.col(ordinal).alias("_at"), F.floor(F.col(ordinal) / block).alias("_block"))
    back = F.lag("Date").over(Window.partitionBy(*keys, "_block").orderBy("_at", "Date")) > F.col("Date")
    place = F.struct("_at", "Date")
    ends = blocks.withColumn("_back", back).groupBy(*keys, "_block").agg(F.count("*").alias("n"), F.count_if("_back").alias("d"), F.min_by("Date", place).alias("first"), F.max_by("Date", place).alias("last"))
    border = F.lag("last").over(Window.partitionBy(*keys).orderBy("_block")) > F.col("first")  # a row for each block
    return ends.withColumn("border", border).groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), (F.coalesce(F.sum("d"), F.lit(0)) + F.count_if("border")).alias("n_descending"))
