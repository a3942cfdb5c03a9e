"""Hashed word and character n-grams and a logistic regression on them, in numpy.

A text's features are the relative frequencies of its hashed n-grams, so a text
of any length is read whole and needs no more room than its code points.
"""

from __future__ import annotations

import numpy as np

BITS = 18
ORDERS = (("word", 1), ("word", 2), ("char", 3), ("char", 4))
STEP = np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(0x110000, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
PART = 1 << 20


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(chars: np.ndarray) -> np.ndarray:
    """A hash of each word, by prefix sums of a polynomial in its characters and their places."""
    solid = ~SPACE[chars]
    if not solid.any():
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(solid)
    place = (at - np.repeat(start, end - start)).astype(np.uint64)
    h = _mixed((chars[at].astype(np.uint64) << np.uint64(32)) + place + np.uint64(1))
    return _mixed(np.add.reduceat(h, np.concatenate([[0], np.cumsum(end - start)[:-1]])) + (end - start).astype(np.uint64))


def hashed(chars: np.ndarray, words: np.ndarray, kind: str, n: int) -> np.ndarray:
    """Feature numbers of all n-grams of one order."""
    base = words if kind == "word" else chars.astype(np.uint64)
    if len(base) < n:
        return np.empty(0, dtype=np.int64)
    h = np.full(len(base) - n + 1, (n << 8) + (kind == "word"), dtype=np.uint64)
    for i in range(n):
        h *= STEP
        h += base[i : len(base) - n + 1 + i]
    h ^= h >> np.uint64(32)
    h *= MIX
    h >>= np.uint64(64 - BITS)
    return h.view(np.int64)


def sparse_row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and relative frequencies of one text."""
    chars = code_points(text)
    words = word_hashes(chars)
    at, value = [], []
    for kind, n in ORDERS:
        found = hashed(chars, words, kind, n)
        if len(found):
            number, times = np.unique(found, return_counts=True)
            at.append(number)
            value.append(times / len(found))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.empty(0, dtype=np.int64), np.empty(0))


def raw_score(text: str | None, weights: np.ndarray, bias: float) -> float:
    """The regression's sum for one text: the mean weight of its n-grams of each order, over the whole text."""
    chars = code_points(text)
    words = word_hashes(chars)
    total = bias
    for kind, n in ORDERS:
        count, summed = 0, 0.0
        base = words if kind == "word" else chars
        for at in range(0, max(0, len(base) - n + 1), PART):
            upto = at + PART + n - 1
            found = hashed(chars if kind == "word" else chars[at:upto], words[at:upto] if kind == "word" else words, kind, n)
            count, summed = count + len(found), summed + float(weights[found].sum())
        if count:
            total += summed / count
    return total


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 8, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps over the rows in order; targets may be probabilities."""
    weights, square, bias, bias_square = np.zeros(1 << BITS, dtype=np.float32), np.full(1 << BITS, 1e-8, dtype=np.float32), 0.0, 1e-8
    share = float(np.mean(target)) if len(target) else 0.5
    balance = {1: 0.5 / max(share, 1e-3), 0: 0.5 / max(1 - share, 1e-3)}
    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            at, value = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + float(weights[at] @ value), -30, 30)))
            slope = (p - target[i]) * (target[i] * balance[1] + (1 - target[i]) * balance[0])
            step = slope * value
            square[at] += step * step
            weights[at] -= rate * (step / np.sqrt(square[at]) + decay * weights[at])
            bias_square += slope * slope
            bias -= rate * slope / np.sqrt(bias_square)
    return weights, bias


def calibrate(raw: np.ndarray, target: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Platt scaling: a, b such that 1 / (1 + exp(-(a * raw + b))) is the probability of the target."""
    if len(raw) == 0 or target.min() == target.max():
        return 1.0, 0.0
    high, low = (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2)
    goal = np.where(target > 0.5, high, low)
    scale = max(float(np.std(raw)), 1e-9)
    x, a, b = raw / scale, 1.0, 0.0
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-6, p - goal
        ga, gb, haa, hab, hbb = (g * x).sum() + 1e-3 * a, g.sum(), (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a / scale), float(b)
