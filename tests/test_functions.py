"""Undefined values, tolerance and signs."""

import math

from pyspark.sql import functions as F

from tidewind.functions.exprs import hit_rate, is_close, is_finite, mae, metrics, nearly_constant, rounded, safe_corr


def one(spark, rows, *cols):
    return spark.createDataFrame(rows, "y double, p double").agg(*cols).first()


def test_zero_predictor_has_no_correlation_and_no_hits(spark):
    y, p = F.col("y"), F.col("p")
    got = one(spark, [(0.01, 0.0), (-0.02, 0.0), (0.0, 0.0), (0.03, 0.0)], mae(y, p), safe_corr(y, p), hit_rate(y, p), nearly_constant(p))
    assert math.isclose(got[0], 0.015) and got[1] is None and got[2] is None and got[3] is True


def test_hit_rate_leaves_out_zero_predictions(spark):
    assert one(spark, [(0.01, 0.0), (-0.02, -0.01), (0.05, 0.02)], hit_rate(F.col("y"), F.col("p")))[0] == 1.0


def test_zero_actual_is_a_miss_unless_excluded(spark):
    rows = [(0.0, 0.01), (0.01, 0.01)]
    assert one(spark, rows, hit_rate(F.col("y"), F.col("p")))[0] == 0.5
    assert one(spark, rows, hit_rate(F.col("y"), F.col("p"), exclude_zero_actual=True))[0] == 1.0
    assert one(spark, rows, safe_corr(F.col("y"), F.col("p")))[0] is None


def test_no_rows(spark):
    got = one(spark, [], *metrics(F.col("y"), F.col("p")))
    assert got["n"] == 0 and all(got[c] is None for c in got.asDict() if c != "n")


def test_tolerance_and_finite(spark):
    rows = [(100.0, 100.0 - 1e-11), (100.0, 100.0 - 1e-6), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0)]
    got = spark.createDataFrame(rows, "y double, p double").select(is_close(F.col("y"), F.col("p")), is_finite(F.col("y"))).collect()
    assert [r[0] for r in got][:2] == [True, False]
    assert [r[1] for r in got] == [True, True, False, False, False]


def test_rounded_is_round_to_the_last_bit(spark):
    import random
    import struct

    draw = random.Random(9)
    values = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 5e-10, -5e-10, 1.5e-9, 0.0000000015, 1e4, 9999.9999999995, 1e300, 5e-324, 2.5, 0.1234567895]
    values += [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.randint(-12, 18) for _ in range(20_000)]
    values += [draw.choice([-1, 1]) * float(f"{draw.randint(0, 10 ** draw.randint(1, 13))}.{draw.randint(0, 10**9 - 1):09}5") * 10.0 ** -draw.randint(0, 9) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    bits = lambda x: x if x is None else struct.pack("d", x)
    got = df.select("v", (rounded(F.col("v")) + 0.0).alias("a"), (F.round("v", 9) + 0.0).alias("b")).collect()
    assert len(got) == len(values) and not [r for r in got if bits(r["a"]) != bits(r["b"])]
