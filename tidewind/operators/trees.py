"""Boosted and bagged trees of all models and folds, grown together from histograms that Spark sums.

Features are cut into bins once and written with the rows.  A level of a tree is
one grouped sum: tasks add up gradients and row counts by (model, fold, node,
feature, bin), a shuffle adds these partial sums, and the driver chooses splits.
What reaches the driver depends on the number of models, folds, nodes, features
and bins, never on the number of rows.  Only the smaller child of a split is
summed; its sibling is the parent less it.

Gradients are whole numbers of a fixed unit, so a sum is the same in any order
and a lost task changes no tree.  Rows of a tree are drawn by a hash of their
symbol and date; the kinds of model draw apart.  A number for each row and model
(a margin, a mean so far, a log weight) is written every ``KEEP`` trees; between two
writes tasks add the trees grown since.

A model says how rows are drawn and what its trees are fitted to: ``start`` (a row's
first number), ``columns_of`` (columns that a node may split), ``drawn`` (how often
rows are taken), ``aim`` (what is fitted), ``step`` (the numbers after more trees),
``final`` (predictions).  One that ``weighs`` its trees also has ``judge``, which
gets a tree's largest miss and weighted mean miss.

A round trip to the cluster for each level is dear for small folds.  Where no fold
has more than ``WHOLE_ROWS`` rows a task takes a fold through all its trees; sums
being exact, the trees are the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewind.operators import tables

BINS = 64
#: Trees between two writes of the margins.
KEEP = 10
#: Training rows of a fold that bin edges are taken from, about; up to that many all are.
EDGE_ROWS = 200_000
#: The sum of all gradients of a fold stays below 2 to this, so that doubles add it exactly.
EXACT = 50
#: Rows of a fold (binned, about 50 bytes each) up to which one task may grow its trees.
WHOLE_ROWS = 1 << 20
_STEP = 1 << 40
At = tuple[int, int]  # a model's number and a fold
Sums = dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]  # (model, fold, node): sums of gradients and rows by feature and bin


@dataclass(frozen=True)
class Scale:
    """A fold's training rows: their number, mean and range of y, the unit of gradients."""

    n: int
    base: float
    span: float
    unit: float

    @property
    def heavy(self) -> float:
        """What a weight of one counts for, so that all weights add up exactly."""
        return 2.0 ** np.floor(EXACT - np.log2(self.n))


class Tree:
    """Nodes in order of creation: ``feature`` is -1 at a leaf, rows of a bin up to ``at`` go left.

    A weighing model keeps its say, beta and largest miss here.
    """

    def __init__(self) -> None:
        self.say, self.beta, self.top = 1.0, 1.0, 0.0
        self.feature, self.at, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def add(self) -> int:
        for part, empty in ((self.feature, -1), (self.at, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part.append(empty)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        self.feature[node], self.at[node] = feature, at
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def leaf_of(self, b: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned features."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.at, self.left, self.right))
        node, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        while (inner := feature[node] >= 0).any():
            below = b[rows, np.maximum(feature[node], 0)] <= at[node]
            node = np.where(inner, np.where(below, left[node], right[node]), node)
        return node

    def predict(self, b: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(b)]


def uniform(rid: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) of each row key, drawn anew for each salt (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = rid.astype(np.int64).view(np.uint64) + np.random.SeedSequence(salt).generate_state(1, np.uint64)[0]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """How often a row with this mean is taken: the Poisson law, inverted at u; of a mean above 64 the whole part beyond is sure."""
    mean = np.broadcast_to(np.asarray(mean, dtype=float), u.shape)
    sure = np.floor(np.maximum(mean - 64, 0))
    rest, out = mean - sure, sure.astype(np.int64)
    term = np.exp(-rest)
    below = term.copy()
    for k in range(1, 512):
        if not (more := u >= below).any():
            break
        out += more
        term = term * rest / k
        below += term
    return out


def best_split(g: np.ndarray, h: np.ndarray, leaf: float, l2: float, columns: np.ndarray) -> tuple[float, int, int] | None:
    """``(gain, feature, bin)`` of a node's histograms, the first of equal gains; None if no split gains."""
    total_g, total_h = g[0].sum(), h[0].sum()
    if total_h < 2 * leaf or total_h <= 0:
        return None
    left_g, left_h = g[columns].cumsum(axis=1), h[columns].cumsum(axis=1)
    right_g, right_h = total_g - left_g, total_h - left_h
    ok = (left_h >= leaf) & (right_h >= leaf)
    score = left_g**2 / np.maximum(left_h + l2, 1e-12) + right_g**2 / np.maximum(right_h + l2, 1e-12)
    gain = np.where(ok, score - total_g**2 / (total_h + l2), -np.inf)
    column, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[column, at]), int(columns[column]), int(at)) if gain[column, at] > 1e-12 else None


def best_first(grown: Tree, gains: dict[int, float], leaves: int) -> Tree:
    """The part of a tree that splitting the leaf of largest gain next, up to so many leaves, would have made.

    A node's best split doesn't depend on other nodes, so growing first and choosing then is the same.
    """
    out, made = Tree(), {0: 0}
    out.value[0] = grown.value[0]
    for _ in range(leaves - 1):
        ready = [n for n in made if n in gains]
        if not ready:
            break
        node = max(ready, key=lambda n: (gains[n], -made[n]))
        kids = out.split(made.pop(node), grown.feature[node], grown.at[node])
        for old, new in zip((grown.left[node], grown.right[node]), kids, strict=True):
            made[old], out.value[new] = new, grown.value[old]
    return out


def binned(pdf: pd.DataFrame, features: list[str], edges: list[np.ndarray]) -> list[bytes]:
    x = pdf[features].to_numpy(dtype=float)
    b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
    return [r.tobytes() for r in b]


def unpacked(b: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b), dtype=np.uint8).reshape(-1, width)


def node_sums(b: np.ndarray, y: np.ndarray, rid: np.ndarray, p: np.ndarray, tree: Tree, nodes: list[int], model: object, turn: int, at: Scale, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(node, gradients, rows)`` by feature * BINS + bin for the rows drawn for this turn, as whole numbers."""
    times, width = model.drawn(rid, p, turn, share), b.shape[1]
    use = times > 0
    b, miss, times = b[use], model.aim(y[use], p[use], at), times[use]
    if len(miss) and np.abs(miss).max() > 8 * at.span:
        raise ValueError("gradients beyond their unit")
    g, leaf = np.rint(miss * at.unit) * times, tree.leaf_of(b)
    for node in nodes:
        here = leaf == node
        flat = (b[here].astype(np.int64) + np.arange(width) * BINS).ravel()
        sums = [np.bincount(flat, weights=np.repeat(x[here], width), minlength=width * BINS).astype(np.int64) for x in (g, times)]
        yield node, *sums


def weighed(b: np.ndarray, y: np.ndarray, p: np.ndarray, tree: Tree, at: Scale) -> tuple[float, int, int]:
    """Largest miss of a tree, its misses as parts of the range times weights, and the weights; the sums as whole numbers."""
    weight, miss = np.rint(np.exp(p) * at.heavy), np.abs(at.base + tree.predict(b) - y)
    return float(miss.max()), int(np.rint(weight * miss / (at.span or 1.0)).sum()), int(weight.sum())


def judged(params: list, grown: dict[At, Tree], every: dict[At, list[Tree]], scales: dict[int, Scale], found: dict[At, tuple[float, int, int]]) -> tuple[dict[At, Tree], set[At]]:
    """Of the new trees those that stay, and the models and folds that grow no more."""
    kept, done = dict(grown), set()
    for (m, f), (top, missed, weight) in found.items():
        loss = missed / weight * scales[f].span / top if top > 0 else 0.0
        stays, goes_on = params[m].judge(grown[m, f], not every[m, f], top, loss)
        if not stays:
            del kept[m, f]
        if not goes_on:
            done.add((m, f))
    return kept, done


def whole_fold(params: list, fold: int, at: Scale, b: np.ndarray, y: np.ndarray, rid: np.ndarray, train: np.ndarray) -> tuple[list[np.ndarray], dict[At, list[Tree]]]:
    """All trees of a fold whose rows are at hand: a prediction of each row by model, and the trees."""
    p, every, done = [np.full(len(y), x.start(at)) for x in params], {(m, fold): [] for m in range(len(params))}, set()
    tb, ty, tr = b[train], y[train], rid[train]
    for turn in range(max(x.trees for x in params)):
        growing = [(m, fold) for m, x in enumerate(params) if turn < x.trees and (m, fold) not in done]
        heavy = [m for m, _ in growing if params[m].weighs]
        share = {m: at.n * at.heavy / weighed(tb, ty, p[m][train], Tree(), at)[2] for m in heavy}

        def sums_of(trees: dict[At, Tree], wanted: list, turn: int = turn, share: dict = share) -> Sums:
            made = {}
            for m in {m for m, _, _ in wanted}:
                nodes = [node for k, _, node in wanted if k == m]
                for node, g, h in node_sums(tb, ty, tr, p[m][train], trees[m, fold], nodes, params[m], turn, at, share.get(m, 1.0)):
                    made[m, fold, node] = (g.astype(float).reshape(-1, BINS), h.astype(float).reshape(-1, BINS))
            return made

        grown = grow(params, growing, b.shape[1], {fold: at}, turn, sums_of)
        kept, over = judged(params, grown, every, {fold: at}, {(m, fold): weighed(tb, ty, p[m][train], grown[m, fold], at) for m in heavy})
        done |= over
        for (m, _), tree in kept.items():
            every[m, fold].append(tree)
            p[m] = params[m].step(p[m], y, b, [tree], at)
    return [x.final(p[m], b, every[m, fold], at) for m, x in enumerate(params)], every


def grow(params: list, growing: list[At], width: int, scales: dict[int, Scale], turn: int, sums_of: Callable[[dict[At, Tree], list], Sums]) -> dict[At, Tree]:
    """The next tree of each model and fold, level by level; ``sums_of(trees, wanted)`` gives the histograms of new nodes."""
    trees, gains = {at: Tree() for at in growing}, {at: {} for at in growing}
    wanted, parents = [(m, f, 0) for m, f in growing if params[m].depth > 0], {}
    level = 0
    while wanted:
        sums = sums_of(trees, wanted)
        for (m, f, node), (sibling, g, h) in parents.items():
            sums[m, f, sibling] = (g - sums[m, f, node][0], h - sums[m, f, node][1])
        parents, wanted = {}, []
        for (m, f, node), (g, h) in sorted(sums.items(), key=lambda x: x[0]):
            p, tree = params[m], trees[m, f]
            value = lambda g, h, l2=p.l2, f=f: float(g / (h + l2) / scales[f].unit) if h + l2 > 0 else 0.0
            if node == 0:
                tree.value[0] = value(g[0].sum(), h[0].sum())
            if not (found := best_split(g, h, p.leaf, p.l2, p.columns_of(width, turn, node))):
                continue
            gains[m, f][node], feature, cut = found
            kids = tree.split(node, feature, cut)
            left = np.array([g[feature, : cut + 1].sum(), h[feature, : cut + 1].sum()])
            sizes = [left, np.array([g[feature].sum(), h[feature].sum()]) - left]
            for kid, size in zip(kids, sizes, strict=True):
                tree.value[kid] = value(*size)
            if level + 1 < p.depth and max(s[1] for s in sizes) >= 2 * p.leaf:
                small = int(sizes[1][1] < sizes[0][1])
                wanted.append((m, f, kids[small]))
                parents[m, f, kids[small]] = (kids[1 - small], g, h)
        level += 1
    return {(m, f): best_first(t, gains[m, f], params[m].leaves) if params[m].leaves else t for (m, f), t in trees.items()}


class Fit:
    """Models that grow their trees together: ``params[m]`` for model m, on each fold's training rows.

    ``rows`` holds fold, train (boolean), rid (the row's key), y, the features and
    columns that are only passed on.  A model has the attributes trees, depth,
    leaf, l2, leaves and weighs, and the methods named above.  Rows of one rid are
    drawn together; values that are null or not finite are an error, and so is a
    fold without training rows; no rows at all give none.
    """

    def __init__(self, rows: DataFrame, features: list[str], params: list, whole: int = WHOLE_ROWS) -> None:
        self.spark, self.features, self.params, self.whole = rows.sparkSession, features, params, whole
        self.raw_schema, self.raw = rows.schema, tables.write(rows)
        self._measure()

    def _measure(self) -> None:
        """Range, mean and bin edges of each fold's training rows."""
        rows = self.spark.read.schema(self.raw_schema).parquet(self.raw)
        wrong = F.lit(False)
        for c in ["y", *self.features]:
            wrong = wrong | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        mine = F.when(F.col("train"), F.col("y"))
        found = rows.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if("train").alias("n"), F.count_if(F.col("train") & wrong).alias("wrong"), F.min(mine).alias("lo"), F.max(mine).alias("hi")).collect()  # a row for each fold
        if any(r["wrong"] or not r["n"] for r in found):
            raise ValueError("no or not finite training rows")
        self.folds, self.most = sorted(r["fold"] for r in found), max((r["rows"] for r in found), default=0)
        spans = {r["fold"]: r["hi"] - r["lo"] for r in found}
        self.scales, self.edges = {}, {}
        if not found:
            return
        lows = {r["fold"]: r["lo"] for r in found}
        low, scale = self._of(lows), self._of({f: _STEP / s if s else 0.0 for f, s in spans.items()})
        share = self._of({r["fold"]: min(1.0, EDGE_ROWS / r["n"]) for r in found})
        seen = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share * (1 << 30)
        cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        steps = F.round((F.col("y") - low) * scale).cast("decimal(20,0)")
        made = rows.where("train").groupBy("fold").agg((F.sum(steps) / F.count("*")).cast("double").alias("mean"), *[F.percentile(F.when(seen, F.col(c)), cuts).alias(f"e{i}") for i, c in enumerate(self.features)]).collect()  # a row for each fold
        base = {r["fold"]: lows[r["fold"]] + r["mean"] * spans[r["fold"]] / _STEP for r in made}
        self.scales = {r["fold"]: Scale(r["n"], base[f], spans[f], 2.0 ** np.floor(EXACT - np.log2(r["n"] * spans[f])) if spans[f] > 0 else 1.0) for r in found for f in [r["fold"]]}
        self.edges = {r["fold"]: [np.unique(np.array(r[f"e{i}"] or [], dtype=float)) for i in range(len(self.features))] for r in made}

    @staticmethod
    def _of(values: dict[int, float]) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])[F.col("fold")]

    def run(self) -> DataFrame:
        """The rows without features, with ``p0``, ``p1``, .. (a column for each model)."""
        features, edges, params, scales, models = self.features, self.edges, self.params, self.scales, range(len(self.params))
        kept = [f"`{c.name}` {c.dataType.simpleString()}" for c in self.raw_schema if c.name not in features]
        self.schema = ", ".join([*kept, "b binary", *[f"p{m} double" for m in models]])

        def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, part in pdf.groupby("fold"):
                    yield part.drop(columns=features).assign(b=binned(part, features, edges[fold]), **{f"p{m}": params[m].start(scales[fold]) for m in models})

        rows = self.spark.read.schema(self.raw_schema).parquet(self.raw).mapInPandas(start, self.schema)
        made = tables.write(self._in_tasks(rows)) if self.most <= self.whole else self._in_rounds(tables.write(rows))
        tables.drop(self.spark, self.raw)
        return self._table(made).drop("b")

    def _table(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def _in_tasks(self, rows: DataFrame) -> DataFrame:
        """A task for each fold, all its models and trees."""
        params, width, scales = self.params, len(self.features), self.scales

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            fold = int(pdf["fold"].iloc[0])
            p, _ = whole_fold(params, fold, scales[fold], unpacked(pdf["b"], width), *(pdf[c].to_numpy() for c in ("y", "rid", "train")))
            return pdf.assign(**{f"p{m}": x for m, x in enumerate(p)})

        return rows.groupBy("fold").applyInPandas(whole, self.schema)

    def _in_rounds(self, state: str) -> str:
        """A job for each level of the trees, all models and folds; no task holds more than its share of the rows.

        Models that weigh their trees take two more jobs a tree: all weights before, its misses after.
        """
        every: dict[At, list[Tree]] = {(m, f): [] for m in range(len(self.params)) for f in self.folds}
        since, done = {at: [] for at in every}, set()
        for turn in range(max(p.trees for p in self.params)):
            growing = [(m, f) for m, f in every if turn < self.params[m].trees and (m, f) not in done]
            heavy = [at for at in growing if self.params[at[0]].weighs]
            share = {at: self.scales[at[1]].n * self.scales[at[1]].heavy / found[2] for at, found in self._weights(state, since, {at: Tree() for at in heavy}).items()}
            sums_of = lambda trees, wanted, turn=turn, share=share: self._histograms(state, since, trees, wanted, turn, share)  # noqa: B023, E731
            grown = grow(self.params, growing, len(self.features), self.scales, turn, sums_of)
            kept, over = judged(self.params, grown, every, self.scales, self._weights(state, since, {at: grown[at] for at in heavy}))
            done |= over
            for at, tree in kept.items():
                since[at].append(tree)
                every[at].append(tree)
            if turn % KEEP == KEEP - 1:
                state, since = self._advance(state, since), {at: [] for at in since}
        return self._advance(state, since, every)

    def _advance(self, state: str, since: dict[At, list[Tree]], every: dict[At, list[Tree]] | None = None) -> str:
        """The state with the trees since the last write; with all trees, the predictions."""
        params, width, scales = self.params, len(self.features), self.scales

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, part in pdf.groupby("fold"):
                    b, y, at, after = unpacked(part["b"], width), part["y"].to_numpy(), scales[fold], {}
                    for m, model in enumerate(params):
                        p = model.step(part[f"p{m}"].to_numpy(), y, b, since[m, fold], at)
                        after[f"p{m}"] = model.final(p, b, every[m, fold], at) if every else p
                    yield part.assign(**after)

        after = tables.write(self._table(state).mapInPandas(add, self.schema))
        tables.drop(self.spark, state)
        return after

    def _weights(self, state: str, since: dict[At, list[Tree]], trees: dict[At, Tree]) -> dict[At, tuple[float, int, int]]:
        """``weighed`` of each tree over its fold's training rows."""
        if not trees:
            return {}
        width, params, scales, used = len(self.features), self.params, self.scales, sorted({m for m, _ in trees})

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for fold, part in pdf.groupby("fold"):
                    b, y, at = unpacked(part["b"], width), part["y"].to_numpy(), scales[fold]
                    mine = [m for m in used if (m, fold) in trees]
                    found = [weighed(b, y, params[m].step(part[f"p{m}"].to_numpy(), y, b, since[m, fold], at), trees[m, fold], at) for m in mine]
                    yield pd.DataFrame([(m, fold, *x) for m, x in zip(mine, found, strict=True)], columns=["m", "fold", "top", "missed", "weight"])

        rows = self._table(state).where("train").select("fold", "b", "y", *[f"p{m}" for m in used])
        parts = rows.mapInPandas(partial, "m int, fold int, top double, missed long, weight long")
        sums = parts.groupBy("m", "fold").agg(F.max("top").alias("top"), F.sum("missed").alias("missed"), F.sum("weight").alias("weight"))
        return {(r["m"], r["fold"]): (r["top"], r["missed"], r["weight"]) for r in sums.collect()}  # a row for each model and fold

    def _histograms(self, state: str, since: dict[At, list[Tree]], trees: dict[At, Tree], wanted: list, turn: int, share: dict[At, float]) -> Sums:
        """Sums of each wanted (model, fold, node): partial ones by the tasks that read the rows, added up by a shuffle."""
        width, scales, params = len(self.features), self.scales, self.params
        cells, place = width * BINS, {at: i for i, at in enumerate(wanted)}
        nodes: dict[int, dict[int, list[int]]] = {}
        for m, f, node in wanted:
            nodes.setdefault(f, {}).setdefault(m, []).append(node)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, list] = {}
            for pdf in batches:
                for fold, part in pdf.groupby("fold"):
                    b, y, rid = unpacked(part["b"], width), part["y"].to_numpy(), part["rid"].to_numpy()
                    for m, open_ in nodes.get(fold, {}).items():
                        p = params[m].step(part[f"p{m}"].to_numpy(), y, b, since[m, fold], scales[fold])
                        for node, g, h in node_sums(b, y, rid, p, trees[m, fold], open_, params[m], turn, scales[fold], share.get((m, fold), 1.0)):
                            before = total.get(place[m, fold, node], (0, 0))
                            total[place[m, fold, node]] = (before[0] + g, before[1] + h)
            for key, (g, h) in total.items():
                some = np.flatnonzero(h)
                yield pd.DataFrame({"cell": key * cells + some, "g": g[some], "h": h[some]})

        used = sorted({m for m, _, _ in wanted})
        rows = self._table(state).where("train").select("fold", "rid", "b", "y", *[f"p{m}" for m in used])
        got = rows.mapInPandas(partial, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        g, h, cell = np.zeros(len(wanted) * cells), np.zeros(len(wanted) * cells), got["cell"].to_numpy()
        g[cell], h[cell] = got["g"].to_numpy(), got["h"].to_numpy()
        g, h = g.reshape(-1, width, BINS), h.reshape(-1, width, BINS)
        return {at: (g[i], h[i]) for at, i in place.items()}

    def train_error(self, made: DataFrame) -> DataFrame:
        """``(fold, e0, e1, ..)``: mean absolute error on the training rows, the same in any order of rows."""
        error = lambda m: F.sum(F.round(F.abs(F.col("y") - F.col(f"p{m}")) * steps).cast("decimal(28,0)")) / F.count("*")
        if not self.folds:
            return made.select("fold", *[F.col(f"p{m}").alias(f"e{m}") for m in range(len(self.params))])
        steps = self._of({f: _STEP / s.span if s.span else 0.0 for f, s in self.scales.items()})
        size = self._of({f: s.span / _STEP for f, s in self.scales.items()})
        found = made.where("train").groupBy("fold").agg(*[error(m).cast("double").alias(f"e{m}") for m in range(len(self.params))])
        return found.select("fold", *[(F.col(f"e{m}") * size).alias(f"e{m}") for m in range(len(self.params))])
