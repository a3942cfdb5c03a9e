"""The operators with production parameters on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewind.llm import langid, linecrf, quality, toxicity
from tidewind.llm.codebooks import codebooks_sha256, compress
from tidewind.llm.audit import audit
from tidewind.llm.bpe import encode_decode
from tidewind.llm.common import attach, materialize, read_table
from tidewind.llm.html import extract
from tidewind.llm.mixing import mix
from tidewind.llm.paragraphs import repeated_paragraphs
from tidewind.llm.sharding import uniform_shards
from tidewind.llm.simhash import simhash_components
from tidewind.llm.topk import top_k


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = uniform_shards(rows, F.xxhash64("doc_id", "size", "text_crc32"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", F.col("slot").cast("long"), grown)


def held_out(fold: int, folds: int) -> Column:
    """Whether a row's doc_id falls into the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(~held_out(0, 5)), labels.where(~held_out(0, 5)))
    found = toxicity.score(docs, model).withColumn("held_out", held_out(0, 5))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    judged = quality.judge(docs, quality.train(docs, labels))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "quality_score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_paragraphs(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_removed", "source_doc_ids", "text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~held_out(1, 3)))).withColumn("held_out", held_out(1, 3))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def digests(tokens: DataFrame) -> DataFrame:
    n = F.expr("octet_length(ids) div 4").alias("n_tokens")
    return tokens.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = linecrf.train(docs.where(~held_out(1, 3)), labels.where(~held_out(1, 3)))
    found = linecrf.score(docs, model).withColumn("held_out", held_out(1, 3))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(read_table(spark, sf_dir, "embeddings"), ("vec_id", "label"))
    found = materialize(found.withColumn("_tw_l", F.coalesce(F.col("label").cast("string"), F.lit("null"))))
    sums = found.groupBy("_tw_l").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hexes = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    sha = F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    return attach(found, sums, "_tw_l", "n", found.count()).select("vec_id", hexes.alias("code"), "error", "label_error", sha)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_html": op2_html,
        "op3_mixing": op3_mixing,
        "op4_simhash": op4_simhash,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_language": op9_language,
        "op10_bpe": op10_bpe,
        "op11_line_quality": op11_line_quality,
        "op12_filter_audit": op12_filter_audit,
        "op13_codes": op13_codes,
    }
