"""The audit's counts against a run of every order over the rows themselves."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tidewind.llm.audit import audit, with_masks

DOCS = "doc_id long, text string, lang string, source string, part string, mask int, key string"
LABELS = "doc_id long, quality int, toxic int, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simple(text):
    """Filters with small bounds, so that short texts meet all of them."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {"A": F.size(words) < 3, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def brute(docs, labels, least=3):
    first = {}
    for d, t, *_ in docs:
        d = 1 << 63 if d is None else d
        first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, lang, *_ in docs:
        text, w = t or "", WORDS.findall(t or "")
        fails = {"A": len(w) < least, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": (1 << 63 if d is None else d) > first[text]}
        marks = [x for x in labels if d is not None and x[0] == d]
        rows.append((lang or "", fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out, removals = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, c in enumerate(order, 1):
                here = [r for r in left if r[1][c]]
                redundant = sum(r[1][c] for r in gone)
                left = [r for r in left if not r[1][c]]
                gone += here
                unique = sum(r[0] == part and [k for k, v in r[1].items() if v] == [c] for r in rows)
                out[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(r[2] for r in here), sum(r[3] for r in here)]
                removals[part, c] = removals.get((part, c), 0) + len(here)
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def rows():
    texts = ["a b c", "a b c", "A b c", "a a a a a", "# x y z", "", None, " \t\n", "a  b c", "ä b c d", "Ä B C D#"]
    docs = [(i, t, ("en", "de", None)[i % 3], "s", "p", 1, "k") for i, t in enumerate(texts)]
    long = " ".join(f"w{i}" for i in range(30_000))
    docs += [(20, long, "en"), (21, long, "en"), (22, long[:-1] + "x", "en"), (23, "x" + long[1:], ""), (25, "a b c", "en"), (25, "a b c", "en"), (None, long, "en"), (None, "only here now", "de"), (None, "only here now", "de")]
    docs += [(i, "many copies of one text", "fr") for i in range(40, 80)]
    return [(*d, *[None] * (7 - len(d))) for d in docs]


LABEL_ROWS = [(1, 1, 0, "t"), (1, 0, 1, "t"), (3, None, None, "t"), (4, 1, 1, "t"), (None, 1, 1, "t"), (21, 1, 0, "t"), (41, 1, 0, "t"), (99, 1, 1, "t")]


def test_audit_is_every_order_run(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS).repartition(4), spark.createDataFrame(LABEL_ROWS, LABELS)
    wanted = brute(rows(), LABEL_ROWS)
    assert result(audit(docs, labels, fails=simple, block=4, growth=2)) == wanted
    # A hash that tells nothing: the texts themselves decide.
    weak = lambda c: F.xxhash64(F.lit(0)) + 0 * F.length(c)
    assert result(audit(docs, labels, fails=simple, digest=weak)) == wanted
    assert len(wanted) == 4 * 600


def test_production_filters(spark):
    got = result(audit(spark.createDataFrame(rows(), DOCS), spark.createDataFrame(LABEL_ROWS, LABELS)))
    assert got == brute(rows(), LABEL_ROWS, 200)


def test_copies_against_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    masks, letters = with_masks(docs)
    first = {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for d, t in texts.items():
        first[t] = min(first.get(t, d), d)
    assert letters == "ABCDE"
    assert {r["doc_id"] for r in masks.where("mask >= 16").collect()} == {d for d, t in texts.items() if first[t] < d}


def test_no_rows(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
