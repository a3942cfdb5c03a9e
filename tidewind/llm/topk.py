"""Exact top-k search by inner product with vector-approximation files.

Queries and candidates are dealt to blocks of bounded size and every pair of a
query block and a candidate block is one group.  In a group each candidate has
an approximation: the cell of a uniform grid of ``2 ** bits`` steps per
dimension.  The scan over the cells bounds every score from above and below;
exact vectors are then read in order of their bound, until the next bound is
below the kth exact score, so the result is certain.  Groups return k rows for
each query and the best k of those are the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 2.0**53


def _ints(vectors: pd.Series, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) as float64, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(scale * out)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; Python integers where doubles could round, held within 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.size < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(a * int(b) for a, b in zip(whole, r, strict=True)))) for r in x], dtype=np.int64)


def va_search(q: np.ndarray, q_own: np.ndarray, x: np.ndarray, x_key: np.ndarray, x_order: np.ndarray, k: int, bits: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query, as row numbers; ties go to smaller ``x_order``.

    A candidate whose key is the query's ``q_own`` is the query's own row.
    """
    low, high = x.min(axis=0), x.max(axis=0)
    step = np.maximum(high - low, 1e-300) / (1 << bits)
    cells = np.clip(np.floor((x - low) / step), 0, (1 << bits) - 1).astype(np.uint16 if bits > 8 else np.uint8)
    centres = low + (cells + 0.5) * step
    found = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        middle = part @ centres.T
        size = np.abs(part) @ np.maximum(np.abs(low), np.abs(high))
        slack = np.abs(part) @ (step / 2) + 1e-9 * size + 1e-6
        for number, (row, mid, more, own) in enumerate(zip(part, middle, slack, q_own[at : at + 256], strict=True), at):
            mid[x_key == own] = -np.inf
            take, done = min(4 * k, len(mid)), 0
            best_id, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            while True:
                order = np.argpartition(-mid, take - 1)[:take] if take < len(mid) else np.arange(len(mid))
                order = order[np.lexsort((x_order[order], -mid[order]))]
                read = order[done:]
                read = read[mid[read] > -np.inf]
                best_id, best = np.concatenate([best_id, read]), np.concatenate([best, _exact(row, x[read])])
                top = np.lexsort((x_order[best_id], -best))[:k]
                best_id, best = best_id[top], best[top]
                if take == len(mid) or (len(best) == k and mid[order[-1]] + more < best[-1]):
                    break
                done, take = 0, min(4 * take, len(mid))
                best_id, best = best_id[:0], best[:0]
            found += zip([number] * len(best), best_id, best, strict=True)
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, bits: int = 8, query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``.

    Components become floor(scale * x).  Vectors that are null or hold null, NaN or
    infinite components take no part.  Every other row is a candidate of every
    query row but itself, so repeated rows come as often as they occur, and each row
    of a repeated query has its own ranking.  A shorter vector, also an empty one,
    counts as filled with zeros.  Ties go to the smaller vec_id, null last.  A query
    has fewer than ``k`` rows only if there are fewer other rows.  Scores beyond 64
    bits are held at the limit.  Other columns are not read.
    """
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    # Equal rows are searched once and counted: ``times`` is their number, a row's own copy doesn't count for it.
    rows = rows.where(F.col("v").isNotNull() & ~bad).groupBy("vec_id", "v").agg(F.coalesce(F.max("q"), F.lit(False)).alias("q"), F.count("*").alias("times"))
    rows = rows.withColumn("key", F.xxhash64("vec_id", "v"))
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    c_blocks, q_blocks = max(1, -(-n // candidate_rows)), max(1, -(-n_q // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mine = lambda m: F.pmod("key", F.lit(m)).cast("int")
    queries = rows.where("q").select(F.lit(True).alias("q"), "vec_id", "key", "times", "v", mine(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    others = rows.select(F.lit(False).alias("q"), "vec_id", "key", "times", "v", every(q_blocks).alias("qb"), mine(c_blocks).alias("cb"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["q"].to_numpy(dtype=bool)
        dim = int(pdf["v"].map(len).max())
        v, a, b = _ints(pdf["v"], dim, scale), pdf[is_q], pdf[~is_q]
        places = np.lexsort((b["key"].to_numpy(), b["vec_id"].fillna(0).to_numpy(dtype=np.int64), b["vec_id"].isna().to_numpy()))
        order = np.empty(len(places), dtype=np.int64)
        order[places] = np.arange(len(places))
        # A query that occurs several times is a candidate of itself.
        own = np.where(a["times"] > 1, 0, a["key"])
        single = np.where(b["times"] > 1, 1, b["key"])
        found = va_search(v[is_q], own, v[~is_q], single, order, k, bits) if len(a) and len(b) else []
        number, other, score = (np.array(c, dtype=np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        same = a["key"].to_numpy()[number] == b["key"].to_numpy()[other]
        made = {"key": a["key"].to_numpy()[number], "query_id": a["vec_id"].to_numpy(dtype=np.int64)[number], "n_queries": a["times"].to_numpy()[number]}
        made |= {"vec_id": b["vec_id"].astype("Int64").array[other], "times": np.minimum(k, b["times"].to_numpy()[other] - same), "score": score}
        return pd.DataFrame(made)

    schema = "key long, query_id long, n_queries long, vec_id long, times long, score long"
    best = queries.unionByName(others).groupBy("qb", "cb").applyInPandas(search, schema)
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))  # k at most
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_queries").cast("int")))).select("query_id", "rank", "vec_id", "score")
