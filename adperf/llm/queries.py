"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.llm import align, chat, exact_dedup, hard_negatives, host_quality, neardup, packing, pii, piece, substring, token_store, toxicity, warc
from adperf.llm.common import documents


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of(spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")))
    return chat.link_tool_calls(calls, results, chat.SCHEMAS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece.encode_digests(documents(spark, sf_dir), path).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.detect_pii(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.host_quality(documents(spark, sf_dir)).drop("host_rate").withColumnRenamed("id", "doc_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_store.write_tokens(documents(spark, sf_dir), path, token_store.new_folder(spark))
    return token_store.read_tokens(manifest, digest=True).withColumnRenamed("id", "doc_id")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = token_store.token_lengths(documents(spark, sf_dir), path)
    return packing.pack(lengths, id_col="id", length_col="n_tokens").withColumnRenamed("id", "doc_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(documents(spark, sf_dir), shingle=2)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("id", "doc_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rows = align.align_tokenizers(documents(spark, sf_dir), *paths, digest=True)
    return rows.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, anchor=F.col("vec_id") % 100 == 0, label=label)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))
    index = warc.write_archive(pages, warc.new_archive(spark))
    return warc.read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_exact_dedup, op3_sentencepiece, op4_pii, op5_host_quality, op6_token_store, op7_best_fit, op8_minhash,
        op9_toxicity, op10_substring_dedup, op11_token_alignment, op12_hard_negatives, op13_warc, pipeline,
    )
}
