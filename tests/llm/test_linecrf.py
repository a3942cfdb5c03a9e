"""The field against sums over all labellings, and the classifier on rows that it hasn't seen."""

import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tidewind.llm import linecrf
from tidewind.llm.queries import op11_line_quality


def by_enumeration(score, ties):
    """Marginals and pair counts of one chain, every labelling weighed."""
    total, good, pairs = 0.0, np.zeros(len(score)), np.zeros((2, 2))
    for labels in product((0, 1), repeat=len(score)):
        weight = np.exp(sum(s for s, y in zip(score, labels) if y) + sum(ties[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += weight
    return good / total, pairs / total, np.log(total)


def test_marginals_are_sums_over_labellings():
    rng = np.random.default_rng(0)
    text = np.repeat([0, 2, 5, 6], [3, 7, 1, 5])
    score, ties = rng.normal(size=len(text)) * 3, rng.normal(size=(2, 2))
    chains = linecrf.Chains(text)
    p, pairs = chains.marginals(score, ties)
    sizes = []
    for i in np.unique(text):
        at = text == i
        good, both, _ = by_enumeration(score[at], ties)
        assert np.allclose(p[at], good)
        assert np.allclose(pairs[chains.rows[0] == np.flatnonzero(at)[0]], both)
        sizes.append(at.sum())
    assert chains.n.tolist() == sorted(sizes, reverse=True)


def test_fit_climbs_the_likelihood():
    rng = np.random.default_rng(1)
    text = np.repeat(np.arange(40), rng.integers(1, 7, 40))
    label = np.repeat(rng.integers(0, 2, 40), np.unique(text, return_counts=True)[1])
    x = np.concatenate([rng.normal(size=(len(text), 2)) + label[:, None], np.ones((len(text), 1))], axis=1)

    def likelihood(w, ties):
        out = 0.0
        for i in np.unique(text):
            s, y = x[text == i] @ w, label[text == i]
            out += (s @ y + sum(ties[a, b] for a, b in zip(y, y[1:])) - by_enumeration(s, ties)[2]) / len(y)
        return out

    w, ties = linecrf.fit(x, text, label.astype(float))
    best = likelihood(w, ties)
    assert best > likelihood(np.zeros(3), np.zeros((2, 2)))
    for i in range(3):  # a maximum: no step along one weight is better
        for step in (-0.3, 0.3):
            assert likelihood(w + step * np.eye(3)[i], ties) < best


def test_lines_and_neighbours(monkeypatch):
    texts = ["One line here.\n\nTwo TWO two two | |\nOne line here.", "", " \n\t\n", "x", "é 日本 42 $$$!!"]
    text, rows, size = linecrf.line_rows(texts)
    assert text.tolist() == [0, 0, 0, 3, 4] and size.tolist() == [12, 14, 12, 1, 10]
    n = linecrf.N_COUNTS + 1
    assert rows.shape[1] == linecrf.N_FEATURES
    assert rows[:, n - 1].tolist() == [0, 0, 1, 0, 0]  # equal to an earlier line
    assert np.array_equal(rows[1, n : 2 * n], rows[0, :n]) and np.array_equal(rows[1, 2 * n : 3 * n], rows[2, :n])
    assert not rows[3, n : 3 * n].any() and not rows[0, n : 2 * n].any()
    assert rows[1, 7] == 2 / 6  # "two two" and "| |"
    # In pieces, and one text at a time.
    whole = linecrf.line_rows(texts)
    monkeypatch.setattr(linecrf, "PIECE", 8)
    again = linecrf.line_rows(texts)
    assert all(np.allclose(a, b) for a, b in zip(whole, again, strict=True))


def test_odd_rows(spark):
    docs = [(1, None, "x"), (2, "", "x"), (None, "A fine line.", "x"), (4, "A fine line.", "x"), (4, "A fine line.", "x"), (5, "### $$$ " * 60_000, "x"), (6, "\n".join(["fine words here"] * 20_000), "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 0), (4, 1), (5, 0), (5, 1), (6, 1), (None, 1), (1, None), (99, 0)], "doc_id long, quality int")
    for known in (labels, labels.where("quality = 1"), labels.where("false")):
        got = linecrf.score(table, linecrf.train(table, known)).collect()
        assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert linecrf.score(table.where("false"), linecrf.train(table.where("false"), labels)).count() == 0


def test_unseen_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op11_line_quality(spark, folder).collect()}
    known = spark.read.parquet(f"{folder}/labels.parquet").where(F.col("quality").isNotNull()).collect()
    test = [r for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in test)
    bad = [r for r in test if r["quality"] == 0]
    assert len(bad) > 10
    assert sum(got[r["doc_id"]]["predicted"] == 0 for r in bad) >= 0.95 * len(bad)
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in test) >= 0.98 * len(test)
