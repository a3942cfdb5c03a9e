"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame.  All
but the last return the columns of documents; between two stages the documents
are written as Parquet in the shared folder and read again, so a stage starts
from files whatever becomes of the executors that made them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.llm import quality
from tidewind.llm.bpe import encode_decode
from tidewind.llm.common import delete_at_exit, read_table, shared_folder
from tidewind.llm.mixing import mix
from tidewind.llm.paragraphs import repeated_paragraphs
from tidewind.llm.queries import digests
from tidewind.llm.simhash import first_of_components


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text is rejected, repeated rows fare alike, no rows give no rows."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest doc_id, a null one last.

    Of different texts with that doc_id the first by fingerprint stays, of
    repeated rows one.
    """
    key = F.xxhash64("doc_id", "text")
    keep = first_of_components(docs, key).withColumnRenamed("rk", "_tw_rk")
    kept = docs.withColumn("_tw_rk", key).join(keep, "_tw_rk", "left_semi")
    return kept.dropDuplicates(["_tw_rk"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that an earlier document has; a document of nothing else goes."""
    found = repeated_paragraphs(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    A document is told by doc_id, text and source, so a null or shared doc_id takes
    nobody else's copies; repeated rows have all copies of theirs together.  A null
    or empty text has no words, so it is not taken; no rows give no rows.
    """
    key = F.xxhash64("doc_id", "text", "source")
    taken = mix(docs, key=key).where("taken > 0").select(F.col("rk").alias("_tw_rk"), (F.col("taken") / F.col("size")).cast("int").alias("_tw_times"))
    times = taken.groupBy("_tw_rk").agg(F.sum("_tw_times").cast("int").alias("_tw_times"))
    out = docs.withColumn("_tw_rk", key).join(times, "_tw_rk").dropDuplicates(["_tw_rk"])
    return out.withColumn("_tw_copy", F.explode(F.sequence(F.lit(1), F.col("_tw_times")))).select(docs.columns)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each document, a null text as an empty one, row by row."""
    return digests(encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("bpe_ids", bpe_ids),
]

#: Classifier, SimHash and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, place)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(path := f"{place}/{i}_{name}")
            docs = spark.read.parquet(path)
    return docs
