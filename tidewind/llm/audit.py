"""Filter interaction audit: what each filter removes in every order of applying them.

A row's failures are bits of a mask, and every figure of every order follows from
the number of rows of each mask, so texts are looked at once and 32 counts a part
give all 120 orders.

One filter removes copies of an earlier document.  They are found by partition
refinement: rows are split by the number of their code points, then by the hash
of their first block, of the next, and so on; a row that is alone in its class
takes no further part.  Blocks grow by a factor, so the rounds grow with the
logarithm of the longest text that still has company.  Only then are the full
texts that are left compared; equal hashes never decide.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewind.llm.common import attach, discard, materialize

LAST = (1 << 63) - 1
#: Classes of copies whose keys (8 bytes each) are broadcast; more are shuffled with the texts.
MOST_KEYS = 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails a filter, by letter; ``E``, copies, isn't one of a single text."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def block_hashes(text: Column, block: int, growth: int, digest: Callable[[Column], Column]) -> Column:
    """Hashes of a text's blocks: ``block`` code points, then ``growth`` times as many in each."""
    # The ends of i blocks; the last block may be shorter, an empty text has one.
    upto = lambda i: F.floor(block * (F.pow(F.lit(float(growth)), i) - 1) / (growth - 1)).cast("int")
    about = F.greatest(F.round(F.log(F.length(text) * (growth - 1) / block + 1) / F.log(F.lit(float(growth)))).cast("int"), F.lit(1))
    last = F.when(upto(about) < F.length(text), about).otherwise(about - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.substring(text, upto(i) + 1, F.lit(block) * F.pow(F.lit(float(growth)), i).cast("int"))))


def _counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """The rows as a table, and counts taken while it is written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()]))
    return table, seen.get


def refined(rows: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """``rows(n_chars, blocks)`` -> ``(key, n)``, the classes of several rows that agree in length and all blocks, as a table, and their number.

    ``key`` is the hash of length and block hashes so far; classes are split block
    by block, and rows that are alone leave.
    """
    live, done, spare, block = rows.select(F.xxhash64("n_chars").alias("key"), "blocks"), [], [], 0
    while True:
        counts = live.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        more = F.size("blocks") > block
        table, seen = _counted(attach(live, counts, "key", "n", n_rows).where("n is not null"), more=more)
        spare.append(table)
        done.append(table.where(~more).select("key", "n").distinct())
        n_rows = seen["more"]
        if not n_rows:
            break
        live = table.where(more).select(F.xxhash64("key", F.col("blocks")[block]).alias("key"), "blocks")
        block += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out, seen = _counted(out)
    discard(*spare)
    return out, seen["n"]


def with_masks(docs: DataFrame, fails: Callable[[Column], dict[str, Column]] = failures, copies: str = "E", part: str = "lang", block: int = 1024, growth: int = 16, digest: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, str]:
    """``(doc_id, part, mask)`` of each row, and the letters whose bits the mask holds, lowest first.

    ``copies`` is the letter of the filter that a text fails if a row with a smaller
    doc_id, anywhere in the table, has the same text; a null doc_id is larger than
    any other, and rows of one doc_id are no copies of each other.  A null text is
    an empty one, a null part the empty string.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails(F.col("text")).values())]
    letters = "".join(fails(F.lit(""))) + copies
    made = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    made = made.withColumn("n_chars", F.length("text")).withColumn("blocks", block_hashes(F.col("text"), block, growth, digest))
    # The key of a class after its last block, as refined() makes it.
    made = made.withColumn("key", F.aggregate("blocks", F.xxhash64("n_chars"), lambda key, b: F.xxhash64(key, b)))
    facts, seen = _counted(made.select("doc_id", "d", "part", "n_chars", "blocks", "key", sum(bits[1:], bits[0]).alias("mask")))
    classes, n_classes = refined(facts, seen["n"])
    keys = classes.select("key")
    keys = F.broadcast(keys) if n_classes <= MOST_KEYS else keys
    # Copies collapse in the task that reads them, so a large class isn't gathered.
    texts = made.select("key", "text", "d").join(keys, "key", "left_semi").groupBy("key", "text").agg(F.min("d").alias("first"))
    texts = materialize(texts)
    firsts, found = _counted(texts.groupBy("key").agg(F.count("*").alias("n_texts"), F.min("first").alias("first")).join(classes, "key"), several=F.col("n_texts") > 1)
    copy = 1 << (len(letters) - 1)
    late = F.when(F.col("d") > F.col("first"), copy).otherwise(0)
    rows = attach(facts.select("doc_id", "d", "part", "mask", "key"), firsts, "key", "n", seen["n"])
    rows = rows.where("n_texts is null or n_texts = 1").select("doc_id", "part", (F.col("mask") + F.coalesce(late, F.lit(0))).alias("mask"))
    if found["several"]:  # different texts of one key: told apart by the texts themselves
        apart = made.join(firsts.where("n_texts > 1").select("key"), "key", "left_semi").join(texts, ["key", "text"])
        rows = rows.unionByName(apart.select("doc_id", "part", (sum(bits[1:], bits[0]) + late).alias("mask")))
    discard(classes)
    return rows, letters


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """``masks(part, mask, n, good, toxic)`` -> a row for each part, order of the letters and step, zeros included."""
    every, bit = range(1 << len(letters)), {c: 1 << i for i, c in enumerate(letters)}
    steps, orders = [], [*permutations(letters)]
    for order in orders:
        before = 0
        for step, c in enumerate(order, 1):
            steps += [("".join(order), step, m, not m & (before | bit[c]), bool(m & bit[c] and not m & before), bool(m & bit[c] and m & before), m == bit[c], len(orders) // m.bit_count() if m & bit[c] else 0) for m in every]
            before |= bit[c]
    schema = "filter_order string, step int, mask int, is_kept boolean, is_removed boolean, is_redundant boolean, is_unique boolean, times int"
    table = masks.sparkSession.createDataFrame(steps, schema)  # of fixed size: orders x steps x masks
    rows = masks.join(F.broadcast(table), "mask")
    total = lambda where, c="n": F.sum(F.when(F.col(where), F.col(c)).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total("is_kept").alias("kept"),
        total("is_removed").alias("removed"),
        total("is_redundant").alias("redundant"),
        total("is_unique").alias("unique_fails"),
        total("is_removed", "good").alias("good_lost"),
        total("is_removed", "toxic").alias("toxic_lost"),
        F.sum(F.col("times") * F.col("n")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs(doc_id, text, lang)`` and ``labels(doc_id, quality, toxic)`` -> a row for each part, order and step:

    kept, removed, redundant (fail this filter, removed earlier), unique_fails (fail
    only this one), good_lost and toxic_lost (removed here with quality or toxic 1)
    and shapley (removals of the filter over all orders).  Options as in
    ``with_masks``, which says what nulls mean.  Repeated rows count as often as
    they occur; of several labels of a document the highest counts, those without a
    doc_id are left out.  Texts of any length are looked at whole.  Other columns
    are not read; no rows give no rows.
    """
    rows, letters = with_masks(docs, **options)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    one = lambda c: F.count_if(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    masks = rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))
    return interactions(masks, letters)
