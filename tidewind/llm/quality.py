"""Quality rules: base counts, then a calibrated n-gram classifier against a fixed threshold.

The classifier is a logistic regression on hashed word and character n-grams,
trained on a bounded sample of labelled rows, calibrated on a part of the sample
that it wasn't trained on, and applied to whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewind.llm import ngram_lr
from tidewind.llm.common import bounded, tidy, trim
from tidewind.llm.langid import hash_share

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated 3-word windows)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six blanks only
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    n, solid = len(words), len(text) - sum(map(text.count, BLANK))
    return n, solid, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=n)
    size = len(number)
    first = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 21:  # three numbers don't fit in 63 bits
        first = np.unique(first, return_inverse=True)[1]
    window = first * size + ids[2:]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    start = np.zeros(n - 2, dtype=bool)
    start[order[1:][same]] = True
    start[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= start
    return int(covered.sum())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2400) -> dict:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    At most about ``max_rows`` labelled rows are used, chosen by a hash of doc_id
    before texts are read, so the driver gathers some 40 MB of features; rows with a null label are left out and of several
    labels of a document the lowest counts.  A fifth of the sample calibrates.
    Without labels of both kinds the model keeps everything.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = hash_share(F.col("doc_id"), F.lit("quality")) < share
    rows = docs.where(chosen).select("doc_id", "text").join(known.where(chosen), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                found = [ngram_lr.sparse_row(t) for t in part["text"]]
                packed = [(a.astype("<i4").tobytes(), v.astype("<f2").tobytes()) for a, v in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["quality"].to_numpy(), "at": [p[0] for p in packed], "v": [p[1] for p in packed]})

    got = bounded(rows).mapInPandas(tidy(cut), "doc_id long, y int, at binary, v binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["at"], r["v"]))
    features = [(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["v"], dtype="<f2").astype(np.float32)) for r in got]
    y = np.array([r["y"] for r in got], dtype=float)
    test = np.array([i % 5 == 0 for i in range(len(got))], dtype=bool)
    if len(y) == 0 or y[~test].min(initial=1) == y[~test].max(initial=0):
        return {"weights": None, "bias": 0.0, "a": 1.0, "b": 0.0}
    weights, bias = ngram_lr.fit([features[i] for i in np.flatnonzero(~test)], y[~test])
    raw = np.array([bias + float(weights[features[i][0]] @ features[i][1]) for i in np.flatnonzero(test)])
    a, b = ngram_lr.calibrate(raw, y[test])
    # The driver outlives the sample; else it would keep the room of it beside all later stages.
    del got, features
    trim()
    return {"weights": weights, "bias": bias, "a": a, "b": b}


def judge(docs: DataFrame, model: dict, threshold: float = 0.3, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Adds to all columns of ``docs`` the counts, base_failed, quality_score and kept.

    base_failed: fewer than ``min_words`` words or over ``max_repeat`` % of them in
    repeated windows.  kept: not base_failed and a probability of good quality of
    at least ``threshold``.  A null or empty text has no words, so it fails.
    Columns of these names that ``docs`` has already are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    weights, bias, a, b = model["weights"], model["bias"], model["a"], model["b"]

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            raw = 0.0 if weights is None else ngram_lr.raw_score(text, weights, bias)
            good = 1.0 if weights is None else float(1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30))))
            rows.append((*base_counts(text), good))
        return pd.DataFrame(rows, columns=[*names, "quality_score"])

    made = [*names, "quality_score", "base_failed", "kept"]
    out = bounded(docs).drop(*made).withColumn("_tw_q", score(F.col("text")))
    out = out.select("*", *[F.col(f"_tw_q.{c}").alias(c) for c in [*names, "quality_score"]]).drop("_tw_q")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= threshold))
