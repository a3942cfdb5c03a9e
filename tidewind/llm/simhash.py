"""SimHash near-duplicate detection with pivot distance tables.

Every distinct fingerprint gets, once, its Hamming distances to a table of
reference fingerprints (pivots): over all bits, and inside each of ``blocks``
blocks of bits.  By the triangle inequality two fingerprints at distance d differ
by at most d in every coordinate, and where they agree in a block their
distances there are equal.

Two fingerprints within ``max_distance`` bits agree in all but ``max_distance``
blocks, so rows meet by equal block distances on each choice of that many blocks
(no link is lost).  In such a bucket rows are sorted by their first pivot
distance; a row stops looking when the next is out of reach, a pair whose maximum
coordinate difference exceeds the limit is discarded without looking at the
bits, and the survivors are verified.  In a bucket above ``bucket_rows`` all rows
are first compared with one of them, and only those that don't link to it are
compared with the others, in cells of bounded size on different tasks.  A bucket
returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewind.llm.common import attach, bounded, discard, join_labels, materialize, parts, stream_groups, tidy
from tidewind.llm.components import connected_components

SEED = 42


def pivots(n: int) -> np.ndarray:
    """``n`` reference fingerprints, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", seed=SEED) for i in range(n)], dtype=np.uint64)


def simhash_text(text: str | None, width: int = 3) -> int:
    """Fingerprint of one text: a bit is set if over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed=SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed=SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: Column | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``, fp the fingerprint as a signed long; with a long ``key`` also ``rk``."""
    keyed = key is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([simhash_text(t, width) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps} | ({"rk": pdf["rk"]} if keyed else {}))

    keys = [key.alias("rk")] if keyed else []
    return bounded(docs).select(F.col("doc_id").cast("long"), "text", *keys).mapInPandas(tidy(run), "doc_id long, fp long" + ", rk long" * keyed)


def pivot_table(fps: DataFrame, blocks: int, n_pivots: int = 8) -> DataFrame:
    """``fps(fp)`` with dist, the distances to the pivots (a byte each), and bands, those inside each block (four bits each)."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    if n_pivots > 8 or max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > 15:
        raise ValueError("distances must fit into 64 bits")
    refs = pivots(n_pivots).view(np.int64).tolist()

    def packed(mask: int, bits: int) -> Column:
        mask -= (mask >> 63) << 64
        apart = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(r)).bitwiseAND(F.lit(mask))).cast("long") for r in refs]
        return reduce(Column.bitwiseOR, [F.shiftleft(a, bits * i) for i, a in enumerate(apart)])

    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return fps.select("fp", packed((1 << 64) - 1, 8).alias("dist"), F.array(*[packed(m, 4) for m in parts]).alias("bands"))


def _bucket_links(fp: np.ndarray, dist: np.ndarray, group: np.ndarray, asks: np.ndarray, limit: int) -> np.ndarray:
    """Spanning forest (pairs of row numbers) of the links inside each group of which one side at least asks.

    Rows are sorted by group and first pivot distance.
    """
    table = dist.view(np.uint8).reshape(len(dist), 8).astype(np.int16)
    first, labels = table[:, 0], np.arange(len(fp))
    live, step = np.arange(len(fp)), 0
    while True:
        step += 1
        live = live[live + step < len(fp)]
        to = live + step
        near = (group[live] == group[to]) & (first[to] - first[live] <= limit)
        live, to = live[near], to[near]
        if not len(live):
            break
        ask = (labels[live] != labels[to]) & (asks[live] | asks[to])
        a, b = live[ask], to[ask]
        keep = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= limit
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= limit
        join_labels(labels, a[keep], b[keep])
    rows = np.flatnonzero(labels != np.arange(len(fp)))
    return np.stack([rows, labels[rows]], axis=1)


def links(fps: DataFrame, max_distance: int = 3, blocks: int = 6, bucket_rows: int = 4096) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct ``fps(fp)`` -> ``(a, b)``: links whose components are those of all links within ``max_distance``; and tables to discard."""
    table = pivot_table(fps, blocks)
    agree = list(combinations(range(blocks), blocks - max_distance))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("bands")[c] for c in chosen]) for i, chosen in enumerate(agree)])
    keyed = table.select("fp", "dist", F.explode(keys).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("fp").alias("head"), F.max("fp").alias("other")).where("head <> other")
    n_fps = fps.count()
    buckets = materialize(sizes.select("k", "n", "head"), parts(n_fps))
    met = attach(keyed, buckets, "k", "n", len(agree) * n_fps).where("n is not null")
    met = materialize(met.withColumn("apart", F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) > max_distance), parts(n_fps))
    small, large = met.where(F.col("n") <= bucket_rows), met.where(F.col("n") > bucket_rows)
    cells = lambda c: F.ceil(F.col(c) / bucket_rows).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    salt = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    askers = large.where("apart").groupBy("k").agg(F.count("*").alias("n_asks")).withColumn("ask_parts", cells("n_asks"))
    askers = materialize(askers, parts(n_fps))
    rows = attach(large, askers, "k", "n_asks", met.count()).where("ask_parts is not null").withColumn("all_parts", cells("n"))
    dealt = (
        small.select("fp", "dist", "k", F.lit(True).alias("asks"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        .unionByName(rows.select("fp", "dist", "k", F.lit(False).alias("asks"), every("ask_parts").alias("i"), salt("all_parts").alias("j")))
        .unionByName(rows.where("apart").select("fp", "dist", "k", F.lit(True).alias("asks"), salt("ask_parts").alias("i"), every("all_parts").alias("j")))
    )
    dealt = dealt.withColumn("d", F.col("dist").bitwiseAND(F.lit(255)).cast("int"))

    def each(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        many = np.bincount(group)[group] > 1
        fp = pdf["fp"].to_numpy()[many]
        pairs = _bucket_links(fp.view(np.uint64), pdf["dist"].to_numpy()[many], group[many], pdf["asks"].to_numpy(dtype=bool)[many], max_distance)
        return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    found = stream_groups(dealt, ["k", "i", "j"], ["d"], each, "a long, b long")
    return found.unionByName(large.where("not apart").select(F.col("fp").alias("a"), F.col("head").alias("b"))), [buckets, met, askers]


def simhash_components(docs: DataFrame, max_distance: int = 3, width: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, one row per input row.

    component_id is the smallest doc_id reachable over links of at most
    ``max_distance`` differing bits.  Null and empty texts have fingerprint zero
    and link like any other; repeated rows stay repeated; a null doc_id is never
    a component_id unless its whole component has none.  Other columns are not
    read, so they may have any name.  Empty input gives an empty result.
    """
    return _components(fingerprints(docs, width), max_distance).select("doc_id", "fp", "component_id")


def first_of_components(docs: DataFrame, key: Column, max_distance: int = 3, width: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(rk)``, the ``key`` of one row of each component: the first by doc_id (null last), fp and key."""
    rows = _components(fingerprints(docs, width, key), max_distance)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "rk")).alias("first")
    return rows.groupBy("root").agg(first).select("first.rk").distinct()


def _components(rows: DataFrame, max_distance: int) -> DataFrame:
    """``rows(doc_id, fp, ..)`` with the fingerprint that names the component, root, and component_id."""
    rows = materialize(rows)
    total = rows.count()
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), parts(total))
    found, spare = links(fps.select("fp"), max_distance)
    roots = connected_components(found, parts(total))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialize(named.join(least, "root").select("fp", "n", "root", "component_id"), parts(total))
    discard(fps, roots, *spare)
    return attach(rows, classes, "fp", "n", total)
