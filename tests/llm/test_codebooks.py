"""Codebooks of exact integers: groups that are skipped change nothing, odd rows have a defined result."""

import math

import numpy as np
import pytest

from tidewind.llm.codebooks import codebooks_sha256, compress, grouped, integers, nearest


def brute(x, book):
    d = ((x[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(axis=2)
    best = d.min(axis=1)
    return np.array([int(np.flatnonzero(r == m)[0]) for r, m in zip(d, best, strict=True)]), best


def lloyd(vectors, parts, entries, rounds):
    """Codes, errors and codebooks as the definition says, in Python's integers."""
    x = np.array(vectors, dtype=object)
    cut = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in cut]
    for _ in range(rounds):
        for p in range(parts):
            own, _ = brute(cut[p], books[p])
            for j in set(own):
                mine = cut[p][own == j]
                books[p][j] = [int(sum(c)) // len(mine) for c in mine.T]
    found = [brute(cut[p], books[p]) for p in range(parts)]
    return np.array([f[0] for f in found]).T, sum(f[1] for f in found), books


@pytest.mark.parametrize("spread", [40, 3, 1 << 28, 1 << 40])
def test_bounds_skip_groups_and_keep_the_nearest(spread):
    rng = np.random.default_rng(3)
    x = rng.integers(-spread, spread, (600, 4))
    x[:50] = x[50:100]
    book = x[rng.choice(600, 64)]
    book[7] = book[3]  # ties
    members = grouped(book, 8)
    assert sorted(np.concatenate(members)) == list(range(64))
    code, best, bounds, every = nearest(x, book, members)
    assert np.array_equal(code, brute(x, book)[0])
    spent = []
    for step in (max(1, spread // 50), 1, 0, 1, 0):
        new = book + rng.integers(-step, step + 1, book.shape)
        drift = np.sqrt(((new - book).astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        code, best, bounds, n = nearest(x, new, members, code, bounds, drift)
        own, far = brute(x, new)
        assert np.array_equal(code, own) and [int(b) for b in best] == list(far)
        book, spent = new, [*spent, n]
    if spread > 3:
        assert min(spent) < every / 3


def test_compress_is_lloyd_in_integers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(2)
    x[200:210] = x[0]
    rows = [(i, [float(v) for v in r], i % 3 or None) for i, r in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found, books = compress(docs, ("vec_id", "label"), entries=16, groups=4)
    got = sorted(found.collect())
    codes, errors, wanted = lloyd([[math.floor(1024 * v) for v in r] for r in x], 4, 16, 4)
    assert [r["code"] for r in got] == codes.tolist() and [r["error"] for r in got] == list(errors)
    assert books.tolist() == [b.tolist() for b in wanted]
    assert len(codebooks_sha256(books)) == 64 and {r["label"] for r in got} == {None, 1, 2}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 2.0]), (6, []), (1, [0.5, -0.5]), (7, [1e30, 1.0, 2.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string")
    found, books = compress(docs, ("vec_id", "code"))
    assert found.columns == ["vec_id", "code", "error"]
    got = found.collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got) == [(False, 1), (False, 1), (False, 6), (False, 7), (True, None)]
    assert {r["error"] for r in got} == {0} and books.shape == (4, 5, 1)
    assert compress(docs.where("vec_id = 6"))[0].first()["code"] == [0, 0, 0, 0]
    for nothing in (docs.where("false"), docs.where("vec_id = 2")):
        found, books = compress(nothing, ("vec_id", "code"))
        assert found.columns == ["vec_id", "code", "error"] and found.count() == 0 and books.size == 0


def test_floor_goes_down_and_is_held():
    assert integers(np.array([-0.5, 0.5, -1024.0, 1e30, -1e30])).tolist() == [-1, 0, -1024, 1 << 62, -(1 << 62)]
