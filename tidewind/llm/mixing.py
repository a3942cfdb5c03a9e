"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's target is met by complete epochs first; the rest is a weighted
sample without replacement: every document draws an exponential key divided by
its quality weight, keys are sorted within the source, and documents are taken
while the running sum of their words is nearest to what is left of the budget.

No source is ever sorted in one task: keys fall into ``2 ** run_bits`` runs per
source, the sums of the runs are prefix-summed first, whole runs before the
budget are taken, whole runs after it are not, and only the one run in which the
budget ends is sorted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewind.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters among the characters that are not white space, times the square of log distinct words by log words; at least 0.1.

    Symbols, markup and repetition lower it, length hardly does: distinct words grow
    like a power of all words (Herdan 1960), whose exponent is that of a text of any
    length.  A single word counts as one; a text without words has 0.1.
    """
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    varied = F.when(F.size(found) > 1, F.log(F.size(F.array_distinct(found))) / F.log(F.size(found))).otherwise(1.0)
    share = F.try_divide(letters, solid) * varied * varied
    return F.coalesce(F.greatest(share, F.lit(0.1)), F.lit(0.1))


def uniform_draw(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the content of a row, the same in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``sizes(source, source_size)`` -> adds ``target``.

    Sources in code point order, null last, get the weights in turn.  Their
    targets are share * total by weight, none above limit * size; what a full
    source can't hold is reshared by weight.  Done in one pass over the sources
    sorted by limit * size / weight: the first i are full when the level of the
    others, (share * total - their limits) / other weights, is not below them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int")))
    s = s.withColumn("cap", F.lit(float(limit)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").isNull(), "source")
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_from", F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w"))
    s = s.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_from"))
    # Later sources also see a level below their ratio, but a lower one: the first is the highest.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    s = s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level)))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 42, run_bits: int = 12, key: Column | None = None) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``(doc_id, source, size, source_size, target, taken)``, one row per row.

    taken is size times the number of times the mix takes the document, at most
    ``ceil(limit)`` times.  A null text has no words and is taken 0 words; a null
    source is a source of its own, the last.  Equal rows draw equal keys and stand
    next to each other.  A budget ends at the document that comes nearest to it.
    Texts of any length count whole.  No rows give no rows; other columns are not
    read.  With a ``key`` of the caller, rows have it as ``rk``.
    """
    named_rows = [key.alias("rk")] if key is not None else []
    key = -F.log(uniform_draw(seed, F.col("doc_id"), F.col("size"))) / F.col("weight")
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), *named_rows)
    # exp(-key) falls as the key rises and lies in (0, 1): runs of nearly even size for any weights near one.
    run = F.floor((1 - F.exp(-F.col("key"))) * (1 << run_bits)).cast("int")
    carried = ["rk"] if named_rows else []
    rows = materialize(rows.withColumn("key", key).select("doc_id", "source", "size", "key", run.alias("run"), *carried))
    runs = materialize(rows.groupBy("source", "run").agg(F.sum("size").alias("run_size")))
    targets = source_targets(runs.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, share, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    named = targets.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest")
    before = F.sum("run_size").over(Window.partitionBy("source").orderBy("run")) - F.col("run_size")
    ends = runs.withColumn("before", before).join(named, F.col("source").eqNullSafe(F.col("of")))
    ends = ends.select("source", "run", "run_size", "before", "rest")
    edge = ends.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("run_size") >= F.col("rest")))
    edge = edge.groupBy("source").agg(F.min("run").alias("edge"), F.min("before").alias("edge_before"))
    named = named.join(edge.withColumnRenamed("source", "edge_of"), F.col("of").eqNullSafe(F.col("edge_of")), "left")
    plan = materialize(named.select("of", "source_size", "target", "epochs", "rest", F.coalesce("edge", F.lit(-1)).alias("edge"), "edge_before"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    whole = rows.where("run <> edge").withColumn("more", (F.col("run") < F.col("edge")).cast("long"))
    # The rows of one run of each source, one in 2 ** run_bits.
    order = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("edge_before") + F.sum("size").over(order)
    last = rows.where("run = edge").withColumn("more", (upto - F.col("size") / 2 <= F.col("rest")).cast("long"))
    taken = F.col("size") * (F.col("epochs") + F.col("more"))
    both = whole.unionByName(last)
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)
