"""Trees on Spark: against a search over all splits, in tasks and in rounds, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewind.operators import trees
from tidewind.operators.models import BoostR2, Boosting, Forest

FEATURES = ["a", "b", "c"]


def table(n=900, folds=2, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for fold in range(folds):
        x = rng.normal(size=(n, 3)).round(2)
        y = np.where(x[:, 0] > 0.3, 1.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + 0.2 * rng.normal(size=n)
        parts.append(pd.DataFrame({"fold": fold, "train": np.arange(n) < n * 3 // 4, "rid": rng.integers(-(2**62), 2**62, n), "y": y, **dict(zip(FEATURES, x.T))}))
    return pd.concat(parts, ignore_index=True)


def rows_of(spark, pdf):
    return spark.createDataFrame(pdf, "fold int, train boolean, rid long, y double, a double, b double, c double")


def brute(train, test, p):
    """Boosting where every node tries every cut of every column by itself; splits of the largest gain first."""
    x, y = train[FEATURES].to_numpy(), train["y"].to_numpy()
    cuts = [np.unique(np.quantile(c, np.arange(1, trees.BINS) / trees.BINS)) for c in x.T]
    made, f, out = [], np.full(len(y), y.mean()), np.full(len(test), y.mean())
    for turn in range(p.trees):
        drawn = trees.uniform(train["rid"].to_numpy(), p.seed, p.leaves, turn) < p.rows
        n = len(FEATURES)
        columns = np.sort(np.random.default_rng([p.seed, p.leaves, turn]).permutation(n)[: max(1, int(p.columns * n))])
        miss = y - f

        def best(at):
            own, found = miss[at].sum() ** 2 / (at.sum() + p.l2), (1e-12, None)
            for c in columns:
                for cut in cuts[c]:
                    left, right = at & (x[:, c] <= cut), at & (x[:, c] > cut)
                    if min(left.sum(), right.sum()) >= p.leaf:
                        gain = sum(miss[s].sum() ** 2 / (s.sum() + p.l2) for s in (left, right)) - own
                        if gain > found[0] + 1e-9:
                            found = (gain, (c, cut))
            return found

        leaves = [(drawn, 0, [], best(drawn))]
        while len(leaves) < (p.leaves or 1 << p.depth):
            ready = [i for i, (_, level, _, (_, choice)) in enumerate(leaves) if choice and level < p.depth]
            if not ready:
                break
            at, level, way, (_, (c, cut)) = leaves.pop(max(ready, key=lambda i: leaves[i][3][0]))
            for side in (True, False):
                kid = at & ((x[:, c] <= cut) == side)
                leaves.append((kid, level + 1, [*way, (c, cut, side)], best(kid)))
        for at, _, way, _ in leaves:
            value = miss[at].sum() / (at.sum() + p.l2)
            for z, into in ((x, f), (test[FEATURES].to_numpy(), out)):
                reach = np.ones(len(z), dtype=bool)
                for c, cut, side in way:
                    reach &= (z[:, c] <= cut) == side
                into[reach] += p.rate * value
        made.append(len(leaves))
    return out, made


@pytest.mark.parametrize("leaves", [0, 6])
def test_trees_are_those_of_a_search_over_all_splits(spark, leaves):
    pdf = table()
    p = Boosting(trees=4, depth=3, rate=0.3, leaf=20, rows=0.8, columns=0.7, leaves=leaves, seed=5)
    fit = trees.Fit(rows_of(spark, pdf), FEATURES, [p])
    got = fit.run().where("not train").toPandas().set_index(["fold", "rid"])["p0"]
    for fold, part in pdf.groupby("fold"):
        test = part[~part["train"]]
        want, sizes = brute(part[part["train"]], test, p)
        assert max(sizes) > 3 and (not leaves or max(sizes) == leaves)
        np.testing.assert_allclose(got.loc[fold].loc[test["rid"]].to_numpy(), want, rtol=1e-9, atol=1e-9)


def search(x, y, times, cuts, p, turn):
    """A tree fitted to rows that count several times, level by level: a function from rows to values.

    Nodes are numbered level by level, left before right.
    """
    open_, made, leaves = [(0, [])], 1, []
    total = lambda at: (times[at].sum(), (times[at] * y[at]).sum())
    reach = lambda z, way: np.logical_and.reduce([np.ones(len(z), dtype=bool), *[(z[:, c] <= cut) == side for c, cut, side in way]])
    while open_:
        node, way = open_.pop(0)
        at = reach(x, way)
        n, s = total(at)
        found = (1e-9, None)
        if len(way) < p.depth and n >= 2 * p.leaf:
            for c in p.columns_of(x.shape[1], turn, node):
                for cut in cuts[c]:
                    sides = [total(at & (x[:, c] <= cut)), total(at & (x[:, c] > cut))]
                    if min(k for k, _ in sides) >= p.leaf and (gain := sum(v * v / k for k, v in sides) - s * s / n) > found[0] + 1e-9:
                        found = (gain, (c, cut))
        if found[1]:
            open_ += [(made, [*way, (*found[1], True)]), (made + 1, [*way, (*found[1], False)])]
            made += 2
        else:
            leaves.append((way, s / n))
    return lambda z: sum(reach(z, way) * value for way, value in leaves)


def parts_of(part):
    train, test = part[part["train"]], part[~part["train"]]
    x = train[FEATURES].to_numpy()
    return x, train["y"].to_numpy(), train["rid"].to_numpy(), test, [np.unique(np.quantile(c, np.arange(1, trees.BINS) / trees.BINS)) for c in x.T]


def test_forest_is_the_mean_of_searched_trees(spark):
    pdf, p = table(600), Forest(trees=5, depth=3, leaf=20, columns=0.7, seed=5)
    got = trees.Fit(rows_of(spark, pdf), FEATURES, [p]).run().where("not train").toPandas().set_index(["fold", "rid"])["p0"]
    for fold, part in pdf.groupby("fold"):
        x, y, rid, test, cuts = parts_of(part)
        want = np.mean([search(x, y, p.drawn(rid, None, t, 1.0), cuts, p, t)(test[FEATURES].to_numpy()) for t in range(p.trees)], axis=0)
        np.testing.assert_allclose(got.loc[fold].loc[test["rid"]].to_numpy(), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("whole", [0, trees.WHOLE_ROWS])
def test_adaboost_is_drucker_s_with_searched_trees(spark, whole):
    """Weights, losses, the end of growing and the weighted median by their definitions."""
    pdf, p = table(600), BoostR2(trees=4, depth=2, leaf=20, rate=0.8, seed=5)
    got = trees.Fit(rows_of(spark, pdf), FEATURES, [p], whole).run().where("not train").toPandas().set_index(["fold", "rid"])["p0"]
    for fold, part in pdf.groupby("fold"):
        x, y, rid, test, cuts = parts_of(part)
        w, say, each = np.full(len(y), 1 / len(y)), [], []
        for t in range(p.trees):
            tree = search(x, y, trees.poisson(trees.uniform(rid, p.seed, 1 << 21, t), w * len(y)), cuts, p, t)
            miss = np.abs(tree(x) - y) / np.abs(tree(x) - y).max()
            if (loss := (w * miss).sum()) >= 0.5:
                break
            beta = loss / (1 - loss)
            w = w * beta ** (p.rate * (1 - miss))
            w /= w.sum()
            say.append(p.rate * np.log(1 / beta))
            each.append(tree(test[FEATURES].to_numpy()))
        assert len(say) > 1
        want = [min(v for v in column if sum(s for s, u in zip(say, column) if u <= v) >= sum(say) / 2) for column in zip(*each)]
        np.testing.assert_allclose(got.loc[fold].loc[test["rid"]].to_numpy(), want, rtol=1e-9, atol=1e-9)


def test_adaboost_ends_with_no_miss_or_too_large_ones(spark):
    p, tree = BoostR2(), trees.Tree()
    assert p.judge(tree, True, 0.0, 0.0) == (True, False) and tree.say == 1.0
    assert p.judge(trees.Tree(), True, 1.0, 0.5) == (True, False)
    assert p.judge(trees.Tree(), False, 1.0, 0.5) == (False, False)
    assert p.judge(tree, False, 1.0, 0.25) == (True, True) and tree.say == pytest.approx(0.05 * np.log(3))
    pdf = table(200, 1)
    perfect = pdf.assign(y=np.where(pdf["a"] > 0, 1.0, -1.0), a=np.sign(pdf["a"]) + 0.0)
    got = trees.Fit(rows_of(spark, perfect[perfect["a"] != 0]), FEATURES, [p], 0).run().toPandas()
    np.testing.assert_allclose(got["p0"], got["y"], atol=1e-9)


def test_poisson_counts_have_their_mean():
    u = trees.uniform(np.arange(200_000), 1)
    for mean in (0.01, 1.0, 7.5, 64.0, 500.25):
        drawn = trees.poisson(u, mean)
        assert abs(drawn.mean() - mean) < 6 * np.sqrt(min(mean, 65) / len(u)) and drawn.min() >= 0
    assert trees.poisson(u, 1.0).var() == pytest.approx(1.0, rel=0.02)
    assert not trees.poisson(u, 0.0).any() and trees.poisson(np.array([1 - 2**-53]), 1.0) < 30


def test_rounds_and_tasks_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(trees, "KEEP", 2)
    pdf = table(600)
    both = [Boosting(trees=3, depth=3, leaf=20, rate=0.3, leaves=5), Boosting(trees=2, depth=2, leaf=20, rate=0.3), Forest(trees=3, depth=2, leaf=20), BoostR2(trees=3, depth=2, leaf=20, rate=0.5)]
    once = trees.Fit(rows_of(spark, pdf), FEATURES, both)
    found = [trees.Fit(rows_of(spark, pdf.sample(frac=1, random_state=1)).repartition(5), FEATURES, both, whole=0), once]
    rows = [sorted(map(tuple, f.run().select("fold", "rid", "p0", "p1", "p2", "p3").collect())) for f in found]
    assert rows[0] == rows[1]
    assert len({r[2] for r in rows[0]}) > 10 and len({r[3] for r in rows[0]}) > 4
    assert len({r[4] for r in rows[0]}) > 10 and len({r[5] for r in rows[0]}) > 4


def test_train_error_is_the_mean(spark):
    fit = trees.Fit(rows_of(spark, table(400)), FEATURES, [Boosting(trees=3)])
    made = fit.run()
    got = {r["fold"]: r["e0"] for r in fit.train_error(made).collect()}
    want = {r["fold"]: r["e"] for r in made.where("train").groupBy("fold").agg(F.avg(F.abs(F.col("y") - F.col("p0"))).alias("e")).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("whole", [0, trees.WHOLE_ROWS])
def test_constant_targets_few_rows_and_none(spark, whole):
    pdf = table(80, 1)
    p = [Boosting(trees=2), Forest(trees=2), BoostR2(trees=2)]
    flat = trees.Fit(rows_of(spark, pdf.assign(y=7.0)), FEATURES, p, whole).run()
    assert {r[f"p{m}"] for r in flat.collect() for m in range(3)} == {7.0}
    few = pdf.head(45).assign(train=True)
    assert len({r["p0"] for r in trees.Fit(rows_of(spark, few), FEATURES, p, whole).run().collect()}) == 1
    none = trees.Fit(rows_of(spark, pdf).limit(0), FEATURES, p, whole)
    made = none.run()
    assert made.count() == 0 and none.train_error(made).count() == 0


def test_wrong_rows_are_errors(spark):
    for wrong in (table(50, 1).assign(a=np.nan), table(50, 1).assign(y=np.inf), table(50, 1).assign(train=False)):
        with pytest.raises(ValueError, match="training rows"):
            trees.Fit(rows_of(spark, wrong), FEATURES, [Boosting()])


def test_draws_are_even_and_change_with_the_salt():
    rid = np.arange(100_000) - 50_000
    one, other = trees.uniform(rid, 42, 0), trees.uniform(rid, 42, 1)
    assert abs((one < 0.8).mean() - 0.8) < 0.01 and abs(np.corrcoef(one, other)[0, 1]) < 0.02
    assert np.array_equal(one, trees.uniform(rid, 42, 0))
