"""Exact de-duplication as a stateful stream.

A stream of arrivals (digest, stable identifier, content locator) runs into a
RocksDB-backed keyed state that never expires: per digest it keeps the best
identifier with its locator and the number of arrivals.  The update is an
aggregate, so arrivals of one digest meet in the map task before any shuffle
and a hot text costs one state row per task.  Digests with two or more
arrivals are hits; their full bytes are compared, and a digest that different
texts share is split by text, so a weak digest gives the same result as a
strong one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.llm.common import FILE, ROW, binary_values, frugal, located, scanned, shared_path, stored, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the bytes of one digest's hits are dealt for the comparison.
SALTS = 16


def normalised(text):
    """Null as empty; A-Z lower-cased, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def arrivals(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """(digest, id, locator) of every row; the text is read, hashed and left behind."""
    rows = located(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), FILE, ROW)

    def digests(batches):
        for b in batches:
            # bytes.lower() changes A-Z only
            found = [digest(x.lower()) for x in binary_values(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), b.column("id"), b.column(FILE), b.column(ROW)],
                names=["digest", "id", FILE, ROW],
            )

    return rows.mapInArrow(frugal(digests), f"digest string, id long, {FILE} string, {ROW} long")


def keep_state(stream: DataFrame) -> DataFrame:
    """The streaming operator: arrivals in, per digest the row to keep so far and the count.

    Works on any stream with columns digest, id, __file and __row; there is no
    watermark, so state is never dropped.  Of equal ids the later locator stays.
    """
    return stream.groupBy("digest").agg(
        F.max(F.struct("id", FILE, ROW)).alias("best"), F.count(F.lit(1)).alias("group_size")
    )


def run_state(spark: SparkSession, table: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream the stored arrivals through :func:`keep_state` and read the state back.

    A restart with the same checkpoint folder goes on from the last committed
    micro-batch; the state lives in RocksDB on the executors and is committed to
    the shared checkpoint folder after each micro-batch.
    """
    at = shared_path(spark, "adperf-state", uuid.uuid4().hex)
    names = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # a store is closed after its commit: open ones hold memory, and 4 MB of disk even when empty
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    }
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(table)
        query = (
            keep_state(stream)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", at)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        # the state source reads its settings while it is planned
        state = stored(
            spark.read.format("statestore").load(at).select(
                F.col("key.digest").alias("digest"), F.col("value.*")
            )
        )
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    best, size = state.columns[1], state.columns[2]
    return state.select("digest", F.col(best).alias("best"), F.col(size).alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[bytes], str] = sha256_hex,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per input row: id, locator, digest, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays, a null id being smallest;
    of repeated rows (same id, same text) the one with the largest locator.  An
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    spark, docs = docs.sparkSession, scanned(docs)
    came = stored(arrivals(docs, id_col, text_col, digest))
    if came.isEmpty():
        return came.select("id", FILE, ROW, "digest").withColumns(
            {"keep_id": F.lit(None).cast("long"), "group_size": F.lit(0).cast("long"), "kept": F.lit(True)}
        )
    folder = came.inputFiles()[0].rsplit("/", 1)[0]
    state = run_state(spark, folder, came.schema, files_per_batch)
    hits = state.where("group_size > 1")

    # Full bytes of every hit, one digest's rows dealt into SALTS parts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parts = hits.select("digest", salts)
    texts = located(docs).select(FILE, ROW, normalised(F.col(text_col)).alias("text"))
    suspects = came.join(hits.select("digest"), "digest", "left_semi")
    members = suspects.join(texts, [FILE, ROW]).withColumn("salt", F.pmod(F.xxhash64(FILE, ROW), F.lit(SALTS)).cast("int"))
    bounds = (
        members.join(parts, ["digest", "salt"])
        .groupBy("digest", "salt").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    clashes = stored(bounds.where("lo <> hi").select("digest"))

    rows = came.join(hits.withColumnRenamed("best", "b"), "digest", "left")
    first = F.coalesce(F.col("b"), F.struct("id", FILE, ROW))
    plain = rows.select(
        "id", FILE, ROW, "digest", first["id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((first[FILE] == F.col(FILE)) & (first[ROW] == F.col(ROW))).alias("kept"),
    )
    if clashes.isEmpty():
        return plain
    # Texts that share a digest with another text are grouped by the text itself.
    split = came.join(clashes, "digest", "left_semi").join(texts, [FILE, ROW])
    groups = split.groupBy("digest", "text").agg(
        F.max(F.struct("id", FILE, ROW)).alias("b"), F.count(F.lit(1)).alias("group_size")
    )
    apart = split.join(groups, ["digest", "text"]).select(
        "id", FILE, ROW, "digest", F.col("b.id").alias("keep_id"), F.col("group_size").cast("long"),
        ((F.col(f"b.{FILE}") == F.col(FILE)) & (F.col(f"b.{ROW}") == F.col(ROW))).alias("kept"),
    )
    return plain.join(clashes, "digest", "left_anti").unionByName(apart)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep; all columns unchanged."""
    docs = scanned(docs)
    gone = stored(exact_dedup(docs, id_col, text_col).where("not kept").select(FILE, ROW))
    return without(docs, gone)
