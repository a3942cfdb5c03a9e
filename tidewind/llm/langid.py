"""Language identification: known words first, then shorter and shorter character n-grams.

A word of the model scores its log relative frequency in each language.  A word
that no language knows is scored by its longest known character n-grams, falling
back one character at a time with a penalty for each step.  The model is counted
on a bounded sample of labelled rows and has a bounded number of entries.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewind.llm.common import bounded, discard, materialize, tidy

LETTERS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000
#: Cells of a model table that a task spreads out to a matrix, 16 MB.
DENSE_CELLS = 4_000_000
#: Languages whose counts are broadcast; more of them go through the shuffle.
MOST_BROADCAST = 100_000


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def hash_share(*cols: Column) -> Column:
    """A number in [0, 1) from the content of a row."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def train(docs: DataFrame, max_rows: int = 3000, top_words: int = 30_000, top_grams: int = 8_000, longest: int = 4) -> dict:
    """Model from ``docs(doc_id, text, lang)``, rows with a null lang or text left out.

    At most about ``max_rows`` documents of each language are counted, chosen by a
    hash of doc_id before a text moves; repeated rows count each.  The most
    frequent words and n-grams of each language are kept.  No rows give a model
    that knows no language.
    """
    rows = bounded(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = materialize(rows.groupBy("lang").count())
    few = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    rows = rows.join(few, "lang").where(hash_share(F.col("doc_id"), F.lit("langid")) * F.col("count") < max_rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                seen[lang].update(LETTERS.findall(text.lower()))
            out = []
            for lang, found in seen.items():
                parts: list[Counter] = [Counter() for _ in range(longest)]
                for word, n in found.items():
                    for k in range(1, longest + 1):
                        for g in grams(word, k):
                            parts[k - 1][g] += n
                out += [(lang, 0, w, n) for w, n in found.items()]
                out += [(lang, k, g, n) for k, c in enumerate(parts, 1) for g, n in c.items()]
            yield pd.DataFrame(out, columns=["lang", "kind", "gram", "n"])

    sums = materialize(rows.select("text", "lang").mapInPandas(tidy(count), "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    # The sample bounds what a language and kind holds.
    order = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "gram")
    kept = sums.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.when(F.col("kind") == 0, top_words).otherwise(top_grams))
    kept = kept.join(totals, ["lang", "kind"]).select("lang", "kind", "gram", "n", "total").collect()
    discard(sizes, sums)
    langs = sorted({r["lang"] for r in kept})
    place = {lang: i for i, lang in enumerate(langs)}
    floor = np.full((longest + 1, len(langs)), np.log(1e-9))
    for r in kept:
        floor[r["kind"], place[r["lang"]]] = np.log(0.3 / r["total"])
    # What an entry has above the floor, for the languages that know it only.
    above: list[dict[str, list]] = [defaultdict(list) for _ in range(longest + 1)]
    for r in sorted(kept, key=lambda r: (r["kind"], r["gram"], r["lang"])):
        at = place[r["lang"]]
        above[r["kind"]][r["gram"]].append((at, np.log(r["n"] / r["total"]) - floor[r["kind"], at]))
    tables = []
    for known in above:
        ends = np.cumsum([0, *map(len, known.values())]).astype(np.int32)
        flat = [x for entries in known.values() for x in entries]
        tables.append(({g: i for i, g in enumerate(known)}, ends, np.array([i for i, _ in flat], dtype=np.int32), np.array([v for _, v in flat], dtype=np.float32)))
    return {"langs": langs, "floor": floor, "tables": tables, "longest": longest}


class Scorer:
    """Scores texts; a word's scores are kept for when it comes again."""

    def __init__(self, model: dict, step: float = 0.4) -> None:
        self.langs, self.floor, self.tables, self.longest = model["langs"], model["floor"], model["tables"], model["longest"]
        self.step = np.log(step)
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)))
        # A table of few languages is read as a matrix, one of many as it is; the scores are the same.
        self.dense = [self._matrix(k) if len(t[0]) * len(self.langs) <= DENSE_CELLS else None for k, t in enumerate(self.tables)]

    def _matrix(self, kind: int) -> np.ndarray:
        known, ends, langs, above = self.tables[kind]
        out = np.tile(self.floor[kind].astype(np.float32), (len(known), 1))
        out[np.repeat(np.arange(len(known)), np.diff(ends)), langs] += above
        return out

    def _entries(self, kind: int, rows: list[int]) -> np.ndarray:
        """Mean log frequency of some entries in each language."""
        if self.dense[kind] is not None:
            return self.dense[kind][rows[0]] if len(rows) == 1 else self.dense[kind][rows].mean(axis=0)
        _, ends, langs, above = self.tables[kind]
        out = np.zeros(len(self.langs))
        for row in rows:
            low, high = ends[row], ends[row + 1]
            out[langs[low:high]] += above[low:high]
        return self.floor[kind] + out / len(rows)

    def _score(self, word: str) -> np.ndarray:
        at = self.tables[0][0].get(word)
        if at is not None:
            return self._entries(0, [at])
        for k in range(self.longest, 0, -1):
            table = self.tables[k][0]
            found = [table[g] for g in grams(word, k) if g in table]
            if found:
                return self._entries(k, found) + (self.longest - k + 1) * self.step
        return np.zeros(len(self.langs))

    def _place(self, word: str) -> int:
        at = len(self.seen)
        if at >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at] = self._score(word)
        self.seen[word] = at
        return at

    def text(self, text: str | None) -> tuple[str, float]:
        """(language, share of its likelihood); ``und`` and 0 for a text without letters."""
        words = LETTERS.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, place = self.seen, self._place
        at = [seen[w] if w in seen else place(w) for w in words]
        logs = self.scores[at].sum(axis=0) / np.sqrt(len(words))
        best = int(np.argmax(logs))
        return self.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, lang_pred, score)``, one row per row.

    A null text, or one without a letter, is ``und`` with score 0, and so is every
    text where the model knows no language.  Texts of any length are read whole;
    of equal scores the language first in code point order wins.  Repeated rows
    stay and fare alike, no rows give no rows.  Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            done = [scorer.text(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [d[0] for d in done], "score": [d[1] for d in done]})

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, lang_pred string, score double")
