"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad.  What speaks for a label are counts of
the line (kinds of characters, word lengths, repeated words, whether an earlier
line is equal) and those of the line before and after; a transition score ties
neighbours together.  The field is fitted by the gradient of its exact
likelihood, the lines of a labelled document having its label.  Forward and
backward sums give each line's probability, and their mean, weighted by the
lines' characters, is the document's quality, calibrated on held back rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.llm.common import bounded, chunks, tidy
from tidewind.llm.langid import hash_share
from tidewind.llm.ngram_lr import calibrate, code_points, word_hashes

BLANK, LOWER, UPPER, DIGIT, STOP, SIGN, MARK = range(7)
#: The blanks, and the marks of ordinary prose.
BLANKS, PROSE = " \t\n\v\f\r", ".,;:'\"()-?¿¡’“”«»"
#: Characters of a text whose counts are held at once, cut at line breaks.
PIECE = 1 << 20
N_COUNTS = 12


@cache
def kinds() -> np.ndarray:
    """The kind of each code point: blank, letter or other (two cases), digit, mark of prose, exclamation, other mark."""
    of = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Zs": STOP, "Cc": MARK}
    first = {"L": LOWER, "M": LOWER, "N": DIGIT, "P": MARK, "S": MARK, "Z": STOP, "C": LOWER}
    out = np.fromiter((of.get(k := unicodedata.category(chr(i)), first[k[0]]) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[[ord(c) for c in PROSE]], out[ord("!")] = STOP, SIGN
    out[[ord(c) for c in BLANKS]] = BLANK
    return out


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of whole lines."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find("\n", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, counts, characters) of each line with a word, without regard to other lines."""
    chars = code_points("\n".join(texts))
    kind = kinds()[chars]
    line_at = np.concatenate([[0], np.flatnonzero(chars == 10) + 1])
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    words = word_hashes(chars)
    solid = np.diff((kind != BLANK).view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(solid == 1), np.flatnonzero(solid == -1)
    of = np.searchsorted(line_at, start, side="right") - 1
    lines, first, n = np.unique(of, return_index=True, return_counts=True)
    if not len(lines):
        return np.empty(0, dtype=np.int64), np.empty((0, N_COUNTS)), np.empty(0)
    last = first + n - 1
    low, high = line_at[lines], np.append(line_at[1:], len(chars) + 1)[lines] - 1

    def share(mask: np.ndarray, per: np.ndarray) -> np.ndarray:
        sums = np.cumsum(np.pad(mask, (1, 0)), dtype=np.int64)
        return (sums[high] - sums[low]) / np.maximum(per, 1)

    size = share(kind != BLANK, np.ones(len(lines)))
    letters = share((kind == LOWER) | (kind == UPPER), np.ones(len(lines)))
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, of))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    bare = np.add.reduceat((end - start == 1) & (kind[start] == MARK), first, dtype=np.int64)
    counts = np.stack(
        [
            np.log1p(n) / 4,
            letters / size,
            share(kind == UPPER, letters),
            share(kind == DIGIT, size),
            share(kind == STOP, size),
            share(kind == SIGN, size),
            share(kind == MARK, size),
            np.add.reduceat(same, first, dtype=np.int64) / n,
            np.add.reduceat(fresh, first, dtype=np.int64) / n,  # order keeps lines together
            bare / n,
            np.minimum(size / n, 30) / 10,
            kind[end[last] - 1] == STOP,
        ],
        axis=1,
    )
    return np.searchsorted(text_at, low, side="right") - 1, counts, size


def line_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, features, characters) of each line with a word; features hold the counts of the line and its neighbours."""
    long = [t for t in texts if len(t) > PIECE]
    if long and len(texts) > 1:
        found = [line_rows([t]) for t in texts]
        return np.concatenate([np.full(len(f[0]), i) for i, f in enumerate(found)]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
    parts = [_counted(list(p)) for p in ([[x] for x in _pieces(texts[0])] if long else [texts])]
    text, counts, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    again = np.zeros(len(text))
    at = 0
    for t in texts:
        seen: set[str] = set()
        for line in t.split("\n"):
            if line.strip(BLANKS):
                again[at] = line in seen
                seen.add(line)
                at += 1
    counts = np.concatenate([counts, again[:, None]], axis=1)
    inner = np.zeros((len(text) + 1, 1))
    inner[1:-1, 0] = text[1:] == text[:-1]  # whether line i belongs to the text of the line before
    before, after = np.zeros_like(counts), np.zeros_like(counts)
    before[1:], after[:-1] = counts[:-1], counts[1:]
    features = np.concatenate([counts, before * inner[:-1], after * inner[1:], inner[:-1], inner[1:], np.ones((len(text), 1))], axis=1)
    return text, features, size


N_FEATURES = 3 * (N_COUNTS + 1) + 3


class Chains:
    """The lines of several texts as columns of steps: longer texts first, so each step is a stretch of rows."""

    def __init__(self, text: np.ndarray) -> None:
        _, first, n = np.unique(text, return_index=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        self.n, first = n[order], first[order]
        steps = int(self.n[0]) if len(n) else 0
        self.live = np.searchsorted(-self.n, -np.arange(1, steps + 1), side="right")
        self.rows = [first[:k] + t for t, k in enumerate(self.live)]

    def marginals(self, score: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good of each line, and the expected number of each pair of neighbours' labels [chain, from, to].

        ``score`` is the line's score of good over bad, ``ties[from, to]`` the transitions.
        """
        e = np.stack([np.zeros(len(score)), score], axis=1)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        m = np.exp(ties - ties.max())
        forward, backward = np.empty_like(e), np.ones_like(e)
        for t, rows in enumerate(self.rows):
            a = e[rows] if t == 0 else (forward[self.rows[t - 1][: len(rows)]] @ m) * e[rows]
            forward[rows] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((len(self.n), 2, 2))
        for t in range(len(self.rows) - 1, 0, -1):
            rows = self.rows[t]
            up = self.rows[t - 1][: len(rows)]
            right = e[rows] * backward[rows]
            joint = forward[up][:, :, None] * m * right[:, None, :]
            pairs[: len(rows)] += joint / joint.sum(axis=(1, 2), keepdims=True)
            left = right @ m.T
            backward[up] = left / left.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), pairs


def fit(features: np.ndarray, text: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.2, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the field, by adaptive steps along the exact gradient; ``good`` is each line's label.

    A text counts with its mean line, so long ones don't outweigh the others.
    """
    chains = Chains(text)
    _, of, n = np.unique(text, return_inverse=True, return_counts=True)
    weight = 1 / n[of]
    per_chain = 1 / chains.n
    told = np.zeros((len(chains.n), 2, 2))
    for t in range(1, len(chains.rows)):
        rows = chains.rows[t]
        np.add.at(told, (np.arange(len(rows)), good[rows - 1].astype(int), good[rows].astype(int)), 1)
    theta = np.zeros(features.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, ties = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = chains.marginals(features @ w, ties)
        grad = np.concatenate([features.T @ (weight * (good - p)), ((told - pairs) * per_chain[:, None, None]).sum(axis=0).ravel()]) / len(n) - l2 * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def qualities(texts: list[str], model: dict) -> np.ndarray:
    """The probability that each text is good, before calibration; a text without a word has NaN."""
    text, features, size = line_rows(texts)
    total, summed = np.zeros(len(texts)), np.zeros(len(texts))
    if len(text):
        p, _ = Chains(text).marginals(features @ model["weights"], model["ties"])
        np.add.at(total, text, size)
        np.add.at(summed, text, size * p)
    return np.where(total > 0, summed / np.maximum(total, 1), np.nan)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_lines: int = 400) -> dict:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    About ``max_rows`` labelled documents at most are used, chosen by a hash of
    doc_id before texts are read, of each a stretch of at most ``max_lines`` lines from
    a place that its length decides; a fifth calibrates.  Rows without a label or
    doc_id are left out, of several labels of a document the lowest counts.
    Without labels of both kinds, or without rows, every text is as good as any.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = hash_share(F.col("doc_id"), F.lit("line quality")) < share
    rows = docs.where(chosen).select("doc_id", "text").join(known.where(chosen), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf):
                text, features, size = line_rows([t or "" for t in part["text"]])
                found = []
                for i, (doc_id, quality) in enumerate(zip(part["doc_id"], part["quality"], strict=True)):
                    low, high = np.searchsorted(text, [i, i + 1])
                    if high - low > max_lines:
                        low += (7919 * (high - low)) % (high - low - max_lines)
                        high = low + max_lines
                    found.append((doc_id, quality, features[low:high].astype("<f4").tobytes(), size[low:high].astype("<f4").tobytes()))
                yield pd.DataFrame(found, columns=["doc_id", "y", "x", "size"])

    got = sorted(map(tuple, bounded(rows).mapInPandas(tidy(cut), "doc_id long, y int, x binary, size binary").collect()))
    x = [np.frombuffer(r[2], dtype="<f4").reshape(-1, N_FEATURES).astype(float) for r in got]
    y = np.array([r[1] == 1 for r in got], dtype=float)
    full = np.array([len(f) > 0 for f in x], dtype=bool)
    back = full & (np.arange(len(got)) % 5 == 0)
    use = np.flatnonzero(full & ~back)
    empty = float((y[~full].sum() + 0.1) / ((~full).sum() + 1))
    if len(use) == 0 or y[use].min() == y[use].max():
        return {"weights": np.zeros(N_FEATURES), "ties": np.zeros((2, 2)), "a": 1.0, "b": 0.0, "empty": empty}
    text = np.repeat(np.arange(len(use)), [len(x[i]) for i in use])
    w, ties = fit(np.concatenate([x[i] for i in use]), text, y[use][text])
    raw = []
    for i in np.flatnonzero(back):
        p, _ = Chains(np.zeros(len(x[i]), dtype=int)).marginals(x[i] @ w, ties)
        raw.append(np.average(p, weights=np.frombuffer(got[i][3], dtype="<f4")))
    a, b = calibrate(np.array(raw), y[back])
    return {"weights": w, "ties": ties, "a": a, "b": b, "empty": empty}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``, one row per row, higher for better texts.

    A null text or one without a word gets the share of good ones among such
    labelled rows, near 0 where there are none.  Texts of any length are read
    whole; repeated rows stay and fare alike, no rows give no rows.  Other columns
    are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf):
                raw = qualities([t or "" for t in part["text"]], model)
                p = 1 / (1 + np.exp(-np.clip(model["a"] * raw + model["b"], -30, 30)))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": np.where(np.isnan(raw), model["empty"], p)})

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, score double")
