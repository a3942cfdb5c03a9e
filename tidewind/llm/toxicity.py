"""Toxicity by weak supervision.

Many weak voters look at a text: words and word beginnings or ends that are
more frequent in labelled toxic rows, and fixed patterns.  A generative label
model estimates by expectation maximization how often each voter fires on toxic
and on other texts, how voters are correlated given the class, and how often
labels are right.  Its posterior labels, of rows with and without a label,
train the linear classifier that scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.llm.common import bounded, tidy
from tidewind.llm.langid import hash_share

WORDS = re.compile(r"[^\W_]+")
CACHE_WORDS = 200_000
# Digits and signs written for letters, and common insults.
LETTER_FOR = str.maketrans("013457@$", "oieastas")
INSULTS = frozenset(
    "idiot idiots moron morons imbecile stupid dumb loser losers scum trash pathetic worthless disgusting "
    "dummkopf trottel arschloch abschaum connard salaud imbécile crétin estúpido imbécil basura escoria".split()
)
PATTERNS = ("seed insult", "two seed insults", "shouted words", "marks in a row")


def terms(word: str) -> tuple[str, ...]:
    """A word's voters: itself, its beginnings and its end."""
    plain = word.translate(LETTER_FOR) if not word.isalpha() else word
    out = [f"={plain}"]
    out += [f"{plain[:k]}*" for k in range(4, 9) if len(plain) > k]
    if len(plain) > 4:
        out.append(f"*{plain[-4:]}")
    return tuple(out)


def patterns(text: str, words: set[str]) -> list[bool]:
    seeds = len(INSULTS & words)
    letters = sum(map(str.isupper, text))
    return [seeds > 0, seeds > 1, letters > 0.5 * len(text), "!!!" in text or "?!?" in text]


class Voters:
    """Which voters fire on a text; what a word fires is kept for when it comes again."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.at = {t: i + len(PATTERNS) for i, t in enumerate(names)}
        self.words: dict[str, tuple[int, ...]] = {}

    def fire(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = set(WORDS.findall(text.lower()))
        out = np.zeros(len(PATTERNS) + len(self.at), dtype=bool)
        out[: len(PATTERNS)] = patterns(text, words)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(self.at[t] for t in terms(w) if t in self.at)
            for i in hit:
                out[i] = True
        return out


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 30, power: float = 3.0, trust: float = 50.0) -> np.ndarray:
    """Posterior probability of the class 1 for each row; ``y`` is 0, 1 or -1 where unknown.

    The generative model, fitted by expectation maximization: a class has a share
    of the rows, each voter fires at a rate of its own for each class, any two
    voters are correlated given the class, and a label, where there is one, is a
    vote that is right at a rate of its own (``trust`` rows of a nearly sure one
    come first).  A voter's evidence counts with the reciprocal of the sum of its
    correlations to ``power``, itself included, so that copies count as one
    together.  Correlations and the first rates come from labelled rows if both
    labels occur, else from whether any voter fires.
    """
    v, known = votes.astype(np.float32), y >= 0
    both = bool(known.any()) and y[known].min() != y[known].max()
    use = known if both else np.ones(len(y), dtype=bool)
    p = np.where(known, np.clip(y, 0.01, 0.99), 0.9 * votes.any(axis=1) + 0.05).astype(float)
    share = None
    for _ in range(rounds):
        yes_rows, no_rows = (p * use).astype(np.float32), ((1 - p) * use).astype(np.float32)
        n_yes, n_no = float(yes_rows.sum()), float(no_rows.sum())
        prior = np.clip(n_yes / use.sum(), 1e-4, 1 - 1e-4)
        on = np.clip((yes_rows @ v + prior) / (n_yes + 1), 1e-5, 1 - 1e-5)
        off = np.clip((no_rows @ v + 0.01) / (n_no + 1), 1e-5, 1 - 1e-5)
        if share is None:
            covariance = (v.T * use) @ v - n_yes * np.outer(on, on) - n_no * np.outer(off, off)
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            correlation = np.clip(covariance / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(correlation, 1)
            share = 1 / (correlation**power).sum(axis=1)
        yes, no = np.log(on / off) * share, np.log((1 - on) / (1 - off)) * share
        logit = np.log(prior / (1 - prior)) + v @ (yes - no) + no.sum()
        hit = (yes_rows @ (y == 1) + 0.99 * trust) / (yes_rows @ known + trust)
        alarm = (no_rows @ (y == 1) + 0.001 * trust) / (no_rows @ known + trust)
        logit += (y == 1) * np.log(hit / alarm) + (y == 0) * np.log((1 - hit) / (1 - alarm))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, p, use = np.abs(new - p).max(), new, np.ones(len(y), dtype=bool)
        if moved < 1e-4:
            break
    return p


def linear_fit(x: np.ndarray, p: np.ndarray, miss_cost: float = 2.0, l2: float = 1e-4, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; a miss costs ``miss_cost`` false alarms."""
    x = np.concatenate([x.astype(np.float32), np.ones((len(x), 1), dtype=np.float32)], axis=1)
    w, look = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 4.0 / max(1.0, miss_cost) / (float((x**2).sum(axis=1).mean()) + 1e-9)
    for t in range(rounds):
        hat = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        grad = x.T @ ((1 - p) * hat - miss_cost * p * (1 - hat)) / max(1, len(x)) + l2 * look
        new = look - rate * grad
        look, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_voters: int = 512) -> dict:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    About ``max_rows`` documents at most, with or without a label, are chosen by a
    hash of doc_id; equal texts count once.  At most ``max_voters`` terms vote.
    Null labels and rows without a doc_id are left out; of several labels of a
    document the highest counts.  Without toxic labels only the patterns vote.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_docs, n_known = bounded(docs).count(), known.count()
    draw = hash_share(F.col("doc_id"), F.lit("toxicity"))
    with_label = docs.join(known.where(draw * n_known < max_rows // 2), "doc_id").select("text", "toxic", "doc_id")
    others = docs.where(draw * n_docs < max_rows // 2).join(known, "doc_id", "left_anti").select("text", F.lit(-1).alias("toxic"), "doc_id")
    # Rows are chosen before the join, so what is gathered here stays bounded.
    sample = with_label.unionByName(others).groupBy(F.xxhash64("text").alias("of")).agg(F.max_by(F.struct("text", "toxic", "doc_id"), F.struct("toxic", "doc_id")).alias("r")).select("r.*")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                found: set[str] = set()
                for w in set(WORDS.findall((text or "").lower())):
                    found.update(terms(w))
                seen[int(toxic > 0)].update(found)
            names = list(set(seen[0]) | set(seen[1]))
            yield pd.DataFrame({"term": names, "bad": [seen[1][t] for t in names], "good": [seen[0][t] for t in names]})

    marked = sample.where("toxic >= 0")
    n_bad = marked.where("toxic > 0").count()
    sums = marked.mapInPandas(tidy(count), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    good_share = F.col("bad") / (F.col("bad") + F.col("good"))
    best = sums.where((F.col("bad") >= max(3, n_bad // 100)) & (good_share >= 0.5)).orderBy((F.col("bad") * good_share).desc(), "term").limit(max_voters)
    names = sorted(r["term"] for r in best.collect())

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(names)
        for pdf in batches:
            packed = [np.packbits(voters.fire(t)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "votes": packed})

    got = sorted((r["doc_id"] or 0, r["toxic"], bytes(r["votes"])) for r in sample.mapInPandas(tidy(vote), "doc_id long, toxic int, votes binary").collect())
    size = len(PATTERNS) + len(names)
    if not got:
        return {"names": names, "weights": np.zeros(size), "bias": -3.0}
    votes = np.unpackbits(np.frombuffer(b"".join(g[2] for g in got), dtype=np.uint8).reshape(len(got), -1), axis=1)[:, :size]
    p = label_model(votes, np.array([g[1] for g in got]))
    weights, bias = linear_fit(votes, p)
    return {"names": names, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``, one row per row.

    A null or empty text fires no voter and gets the score of that.  Texts of any
    length are read whole; repeated rows stay and fare alike, no rows give no
    rows.  Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(model["names"])
        for pdf in batches:
            raw = np.array([model["weights"][voters.fire(t)].sum() for t in pdf["text"]]) + model["bias"]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(raw, -30, 30)))})

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, score double")
