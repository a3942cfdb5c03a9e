"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum with map-side combination and an equi-join;
no adjacency list is ever gathered, and the edges of hubs meet their minimum by
a broadcast of bounded size, so a hub of any degree costs no task its whole
neighbourhood.  Each round is a table in the shared folder; the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewind.llm.common import attach, discard, materialize, parts


def _lowest(edges: DataFrame, total: int) -> DataFrame:
    """``edges(a, b)`` with m, the smallest b of each a."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return attach(edges, low, "a", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _lowest(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return _lowest(down, total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _round(edges: DataFrame, files: int | None) -> tuple[DataFrame, tuple]:
    """The distinct edges as a table; their number and a sum of hashes, taken while it is written."""
    seen = Observation()
    check = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("check")
    table = materialize(edges.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), check), files)
    return table, (seen.get["n"], seen.get["check"])


def connected_components(edges: DataFrame, files: int | None = None, max_rounds: int = 64) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, root)``, root the smallest node reachable.

    Loops and repeated edges are ignored; nodes without another node are not
    returned.  An empty input gives an empty result.  ``files`` as in ``materialize``.
    """
    edges, state = _round(edges.select("a", "b"), files)
    for _ in range(max_rounds if state[0] else 0):
        large, at = _round(_large_star(edges, state[0]), parts(state[0]))
        small, after = _round(_small_star(large, at[0]), parts(at[0]))
        discard(edges, large)
        edges, before, state = small, state, after
        if before == after:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    out._tw_path = edges._tw_path
    return out
