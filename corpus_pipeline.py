"""The corpus pipeline: quality rules, exact and near de-duplication, PII masking, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives
the frame that is written as Parquet and reread as the next one's docs.  All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adperf.llm import exact_dedup, host_quality, neardup, packing, pii, token_store
from adperf.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return host_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five words, 0.8)."""
    return neardup.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's place in the packed sequences, its length in tokens with the end token."""
    # the executors run other stages too: no words stay in idle Python workers
    lengths = token_store.token_lengths(docs, public_tokenizers.path("word_bpe_49k.json"), remember=False)
    return packing.pack(lengths, id_col="id", length_col="n_tokens").withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("best_fit_packing", packed)]

#: Near-duplicate links and bin packing have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
