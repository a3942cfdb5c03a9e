"""Order statistics that no task holds whole, against Python's own."""

import datetime
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidewind.operators import errors, order, quality

DAY = datetime.date(2001, 1, 1)


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(5)


def test_average_rank_over_many_ranges(spark):
    draw = random.Random(1)
    values = [round(draw.gauss(0, 1), 2) + 0.0 for _ in range(3000)] + [0.0] * 1500 + [None, None, float("nan"), float("inf"), -1e300]
    key = lambda v: (v is not None, v is not None and v != v, 0 if v is None or v != v else v)
    put = sorted(values, key=key)
    spans = {}
    for i, v in enumerate(put, 1):
        spans.setdefault(repr(v), []).append(i)
    for ranges in (1, 7, 64):
        got = order.average_rank(table(spark, values), "v", "rank", ranges).collect()
        assert len(got) == len(values)
        assert all(r["rank"] == sum(spans[repr(r["v"])]) / len(spans[repr(r["v"])]) for r in got)


def test_ranks_have_no_unpartitioned_window(spark):
    plan = order.average_rank(table(spark, [1.0, 2.0]), "v", "rank")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("windowspecdefinition(_range" in line for line in windows)


@pytest.mark.parametrize("kind", ["smooth", "ties", "steep"])
def test_select_with_a_small_buffer(spark, kind):
    draw = random.Random(2)
    make = {"smooth": lambda: draw.gauss(0, 1), "ties": lambda: float(draw.randrange(5)), "steep": lambda: math.copysign(10.0 ** draw.uniform(-300, 300), draw.random() - 0.5)}[kind]
    values = [make() for _ in range(5000)]
    put, ranks = sorted(values), [0, 1, 1234, 2500, 4998, 4999]
    got = order.select(table(spark, [*values, None, float("nan")]), F.col("v"), ranks, 5000, buffer=20, accuracy=50)
    assert [g[0] for g in got] == [put[r] for r in ranks]
    assert all(put.index(v) == less and upto == less + put.count(v) for v, less, upto in got)


def test_one_value_a_million_times(spark):
    rows = spark.range(1_000_000).select(F.lit(2.5).alias("v")).union(spark.range(10).select(F.col("id").cast("double")))
    assert order.quantiles(rows, F.col("v"), [0.0, 0.25, 0.5, 1.0], buffer=100) == [0.0, 2.5, 2.5, 9.0]
    one = quality.describe(rows, "v", buffer=100).first()
    assert (one["n"], one["q25"], one["q50"], one["q75"], one["max_value"]) == (1_000_010, 2.5, 2.5, 2.5, 9.0)


def test_quantiles_interpolate_and_may_be_undefined(spark):
    assert order.quantiles(table(spark, [1.0, 2.0, 4.0, 8.0]), F.col("v"), [0.25, 0.5]) == [1.75, 3.0]
    assert order.quantiles(table(spark, [None, float("nan")]), F.col("v"), [0.5]) == [None]
    assert quality.describe(table(spark, []), "v").first()["q50"] is None


def test_largest_by_value_then_date_then_symbol(spark):
    draw = random.Random(3)
    rows = [(s, DAY + datetime.timedelta(d), float(draw.randrange(4)) if draw.random() > 0.1 else None) for d in range(60) for s in "abc"]
    df = spark.createDataFrame(rows, "symbol string, Date date, v double").repartition(4)
    put = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1], r[0]))
    for k in (0, 1, 2, 30, 77, len(put), len(rows)):
        got = df.where(order.largest(df, "v", k, len(put), ["Date", "symbol"], buffer=5)).collect()
        assert sorted(map(tuple, got)) == sorted(put[:k])


def test_islands_over_block_borders(spark):
    draw = random.Random(4)
    rows = [(s, DAY + datetime.timedelta(d)) for s in "ab" for d in sorted(draw.sample(range(900), 120))]
    df = spark.createDataFrame(rows, "symbol string, Date date").repartition(3)
    want = {}
    for s in "ab":
        last, cluster = None, 0
        for _, d in (r for r in rows if r[0] == s):
            cluster += last is None or (d - last).days > 10
            want[s, d], last = cluster, d
    for block in (1, 7, 64, 4096):
        assert {(r["symbol"], r["Date"]): r["cluster"] for r in order.islands(df, 10, ["symbol"], block).collect()} == want
    assert order.islands(df.where("false"), 10, ["symbol"]).count() == 0
    biggest = errors.clusters(df).where("largest").collect()
    assert sorted(r["symbol"] for r in biggest) == ["a", "b"]


def test_descents_over_block_borders(spark):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), i * 3, DAY + datetime.timedelta(draw.randrange(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, at long, Date date").repartition(3)
    want = {s: sum(x[2] > y[2] for x, y in zip(mine, mine[1:])) for s in "ab" for mine in [[r for r in rows if r[0] == s]]}
    for block in (1, 16, 1 << 20):
        assert {r["symbol"]: r["n_descending"] for r in order.descents(df, "at", ["symbol"], block).collect()} == want
    assert quality.monotonic_check(df.drop("symbol").where("false"), "at").first()["n_rows"] == 0


def test_tail_against_fractions():
    def exact(n, s, k, x):
        return Fraction(sum(math.comb(s, i) * math.comb(n - s, k - i) for i in range(x, min(s, k) + 1)), math.comb(n, k))

    for n, s, k in ((30, 12, 9), (100, 50, 10), (1000, 990, 700), (3905, 1689, 39), (5000, 2500, 400), (7, 7, 3), (9, 0, 4)):
        for x in range(0, min(s, k) + 2, max(1, min(s, k) // 12)):
            want = float(exact(n, s, k, x))
            assert errors.upper_tail(n, s, k, x) == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_tail_of_a_hundred_million_rows_is_quick():
    import time

    began = time.perf_counter()
    half = errors.upper_tail(100_000_000, 45_000_000, 1_000_000, 450_000)
    far = errors.upper_tail(100_000_000, 45_000_000, 1_000_000, 453_000)
    assert time.perf_counter() - began < 3
    assert half == pytest.approx(0.5, abs=1e-2) and 0 < far < 1e-6
