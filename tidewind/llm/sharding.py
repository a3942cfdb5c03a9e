"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows start in ``blocks`` source blocks (a hash of their content, so a block is
the same when a lost task runs again).  Given how many rows each block holds and
how many each shard must get, the number of rows that go from block b to shard s
in a uniform random permutation follows a multivariate hypergeometric law; that
matrix is drawn exactly, block by block.  Each block is then permuted locally and
cut by its row of the matrix, rows are exchanged, and every shard is permuted
again.  The rows themselves are only touched by DataFrame functions; the driver
draws ``blocks * shards`` numbers from ``blocks`` counts.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewind.llm.common import materialize


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    left = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each block to each shard; row sums are ``block_rows``, shard sums differ by at most one."""
    rng, total = random.Random(seed), sum(block_rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for rows in block_rows:
        line, left, space = [], rows, sum(room)
        for s in range(shards):
            space -= room[s]
            line.append(hypergeometric(rng, room[s], space, left))
            left -= line[-1]
        room = [r - x for r, x in zip(room, line, strict=True)]
        matrix.append(line)
    return matrix


def uniform_shards(rows: DataFrame, key: Column, shards: int = 8, blocks: int = 1024, seed: int = 42) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard) to ``rows``.

    ``key`` is a 64-bit hash of a row's content.  Rows with equal keys are
    interchangeable copies and get different slots.  Existing columns named shard
    or slot are replaced; columns that start with ``_tw_`` are reserved.  No
    rows give no rows; with fewer rows than shards some shards stay empty.
    """
    rows = rows.drop("shard", "slot").withColumn("_tw_key", key)
    block = F.pmod(F.xxhash64(F.col("_tw_key"), F.lit("block"), F.lit(seed)), F.lit(blocks)).cast("int")
    rows = rows.withColumn("_tw_block", block)
    sizes = dict(rows.groupBy("_tw_block").count().collect())
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    ends = [[sum(line[: s + 1]) for s in range(shards)] for line in matrix]
    table = F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")
    local = Window.partitionBy("_tw_block").orderBy(F.xxhash64("_tw_key", F.lit("local"), F.lit(seed)), "_tw_key")
    at = F.row_number().over(local) - 1
    shard = F.size(F.filter(F.element_at(table, F.col("_tw_block") + 1), lambda e: e <= F.col("_tw_at"))).cast("int")
    sent = rows.withColumn("_tw_at", at).withColumn("shard", shard).drop("_tw_at", "_tw_block")
    again = F.xxhash64("_tw_key", F.lit("again"), F.lit(seed))
    sent = materialize(sent.withColumn("_tw_order", again).withColumn("_tw_run", F.shiftrightunsigned("_tw_order", 56)))
    # At most shards * 256 runs: the second permutation is the order of _tw_order, found run by run.
    runs = sent.groupBy("shard", "_tw_run").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_tw_run")) - F.col("count")
    offsets = runs.select("shard", "_tw_run", before.alias("_tw_before"))
    inside = Window.partitionBy("shard", "_tw_run").orderBy("_tw_order", "_tw_key")
    slot = F.row_number().over(inside) - 1 + F.col("_tw_before")
    out = sent.join(F.broadcast(offsets), ["shard", "_tw_run"]).withColumn("slot", slot)
    return out.drop("_tw_key", "_tw_order", "_tw_run", "_tw_before")
