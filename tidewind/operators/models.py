"""Fold trainers: every model is fitted on each fold's training rows and predicts its test rows.

All models and folds grow their trees together on Spark (``trees``), which says
what the classes' methods are for.  They are analogues over quantile bins with the
parameters of the studied models: depth, leaf size, row and column sampling, L2
leaf penalty, seed; equal in contract but not in digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.config import Config, feature_names
from tidewind.operators import trees
from tidewind.operators.features import keys
from tidewind.operators.folds import fold_rows

#: Keep the draws of the forest and of AdaBoost apart from one another and from the boosters', which use their leaves.
FOREST, R2 = 1 << 20, 1 << 21
#: Rows that the weighted median looks at together.
MEDIAN_ROWS = 1 << 14


@dataclass
class Boosting:
    """Gradient boosting of squared loss; trees of at most ``leaves`` leaves grow leaf by leaf, with 0 level by level."""

    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    leaf: float = 30
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    leaves: int = 0
    seed: int = 42
    weighs = False

    def start(self, at: trees.Scale) -> float:
        return at.base

    def columns_of(self, width: int, turn: int, node: int) -> np.ndarray:
        """One draw for a tree."""
        return np.sort(np.random.default_rng([self.seed, self.leaves, turn]).permutation(width)[: max(1, int(self.columns * width))])

    def drawn(self, rid: np.ndarray, p: np.ndarray, turn: int, share: float) -> np.ndarray:
        return (trees.uniform(rid, self.seed, self.leaves, turn) < self.rows).astype(np.int64)

    def aim(self, y: np.ndarray, p: np.ndarray, at: trees.Scale) -> np.ndarray:
        return y - p

    def step(self, p: np.ndarray, y: np.ndarray, b: np.ndarray, grown: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        for tree in grown:
            p = p + self.rate * tree.predict(b)
        return p

    def final(self, p: np.ndarray, b: np.ndarray, every: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        return p


@dataclass
class Forest:
    """Bagged trees with a draw of the columns for each split; the mean of their values.

    A row is in a tree's sample as often as a Poisson draw of mean one says, which
    is what drawing as many rows as there are with replacement comes to.
    """

    trees: int = 200
    depth: int = 4
    leaf: float = 30
    columns: float = 0.8
    seed: int = 42
    l2, leaves, weighs = 0.0, 0, False

    def start(self, at: trees.Scale) -> float:
        return at.base

    def columns_of(self, width: int, turn: int, node: int) -> np.ndarray:
        return np.sort(np.random.default_rng([self.seed, FOREST, turn, node]).permutation(width)[: max(1, int(self.columns * width))])

    def drawn(self, rid: np.ndarray, p: np.ndarray, turn: int, share: float) -> np.ndarray:
        return trees.poisson(trees.uniform(rid, self.seed, FOREST, turn), 1.0)

    def aim(self, y: np.ndarray, p: np.ndarray, at: trees.Scale) -> np.ndarray:
        return y - at.base

    def step(self, p: np.ndarray, y: np.ndarray, b: np.ndarray, grown: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        for tree in grown:
            p = p + tree.predict(b) / self.trees
        return p

    def final(self, p: np.ndarray, b: np.ndarray, every: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        return p


@dataclass
class BoostR2:
    """AdaBoost.R2 (Drucker 1997) with linear loss: reweighted resampling and a weighted median.

    A row's number is the logarithm of its weight, none above zero; a row is drawn by a
    Poisson law whose mean is its share of the weights times the rows.  Growing ends
    with a tree that misses nothing and before one whose mean miss is half the largest.
    """

    trees: int = 100
    depth: int = 3
    rate: float = 0.05
    leaf: float = 30
    seed: int = 42
    l2, leaves, weighs = 0.0, 0, True

    def start(self, at: trees.Scale) -> float:
        return 0.0

    def columns_of(self, width: int, turn: int, node: int) -> np.ndarray:
        return np.arange(width)

    def drawn(self, rid: np.ndarray, p: np.ndarray, turn: int, share: float) -> np.ndarray:
        return trees.poisson(trees.uniform(rid, self.seed, R2, turn), np.exp(p) * share)

    def aim(self, y: np.ndarray, p: np.ndarray, at: trees.Scale) -> np.ndarray:
        return y - at.base

    def judge(self, tree: trees.Tree, first: bool, top: float, loss: float) -> tuple[bool, bool]:
        """Whether the tree stays and whether others follow."""
        tree.top = top
        if top <= 0 or loss >= 0.5:
            return top <= 0 or first, False
        tree.beta = max(loss, 1e-12) / (1 - loss)
        tree.say = self.rate * float(np.log(1 / tree.beta))
        return True, True

    def step(self, p: np.ndarray, y: np.ndarray, b: np.ndarray, grown: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        """Log weights; only those of training rows are ever used."""
        for tree in grown:
            if tree.beta < 1:
                p = p - tree.say * (1 - np.abs(at.base + tree.predict(b) - y) / tree.top)
        return p

    def final(self, p: np.ndarray, b: np.ndarray, every: list[trees.Tree], at: trees.Scale) -> np.ndarray:
        say, out = np.array([t.say for t in every]), [np.zeros(0)]
        for low in range(0, len(b), MEDIAN_ROWS):
            each = np.stack([t.predict(b[low : low + MEDIAN_ROWS]) for t in every], axis=1)
            order = np.argsort(each, axis=1, kind="stable")
            upto = np.cumsum(say[order], axis=1)
            middle = (upto >= 0.5 * upto[:, -1:]).argmax(axis=1)[:, None]
            out.append(at.base + np.take_along_axis(each, np.take_along_axis(order, middle, 1), 1)[:, 0])
        return np.concatenate(out)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    build: Callable
    params: dict = field(default_factory=dict)


REGISTRY: dict[str, ModelSpec] = {}


def register(spec: ModelSpec) -> None:
    REGISTRY[spec.name] = spec


register(ModelSpec("lightgbm", Boosting, {"leaves": 15}))
register(ModelSpec("random_forest", Forest))
register(ModelSpec("adaboost", BoostR2))
register(ModelSpec("xgboost", Boosting, {"columns": 0.8, "l2": 1.0, "rows": 0.8, "leaf": 30.0}))


def model_predictions(rows: DataFrame, names: list[str], cfg: Config = Config()) -> DataFrame:
    """``(model, fold, Date, regime, y_true, y_pred, train_mae_diagnostic_only)`` of every test row, and its symbol if there is one.

    The seed always comes from the configuration.  Trees are grown when this is
    called.  Symbols are fitted together.
    """
    features, target = feature_names(cfg.features), cfg.target.column
    use = fold_rows(rows, cfg).where("role in ('train', 'test')").select("fold", "role", *keys(rows), "Date", "regime", F.col(target).alias("y"), *features)
    made = [REGISTRY[n].build(**{**REGISTRY[n].params, **cfg.model.params.get(n, {}), "seed": cfg.model.seed}) for n in names]
    rid = F.xxhash64(*keys(use), "Date")
    fit = trees.Fit(use.withColumn("train", F.col("role") == "train").withColumn("rid", rid).drop("role"), features, made)
    found = fit.run()
    each = [F.struct(F.lit(n).alias("model"), F.col(f"p{i}").alias("y_pred"), F.col(f"e{i}").alias("train_mae_diagnostic_only")) for i, n in enumerate(names)]
    tests = found.where("not train").join(F.broadcast(fit.train_error(found)), "fold").withColumn("_m", F.explode(F.array(*each)))  # a row for each fold
    return tests.select("_m.model", "fold", *keys(use), "Date", "regime", F.col("y").alias("y_true"), "_m.y_pred", "_m.train_mae_diagnostic_only")
