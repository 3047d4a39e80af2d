"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.session import ensure_checkpoint_dir

#: White space that separates words, as a character class body (fixed value of the contracts).
SPACE = r"\x20\x09-\x0D"

FILE, ROW = "__file", "__row"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back."""
    path = shared_path(df.sparkSession, "adperf-tables", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *parts])


#: Nodes of a plan that leave each row of a file scan as it is, or out.
_PLAIN = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if every scan of it gives the same rows of its files, else its rows written once and read back.

    Only deterministic filters and projections over one file relation pass as they
    are.  A join, an explode or a limit is stored: its rows would share a
    locator or change between scans.
    """
    plan = df._jdf.queryExecution().analyzed()
    while True:
        below, name = plan.children(), plan.getClass().getSimpleName()
        if name not in _PLAIN or below.size() > 1 or not plan.deterministic():
            return stored(df)
        if not below.size():
            break
        plan = below.apply(0)
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return stored(df)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, which is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str):
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def located(df: DataFrame, file: str = FILE, row: str = ROW) -> DataFrame:
    """A plain scan with a locator of each row: (file, row number in it).

    The locator names the stored content, so it is the same in every scan and
    after a lost task.
    """
    return df.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a plain scan whose locator is not in ``gone`` (__file, __row); columns unchanged, whatever their names."""
    file, row = fresh(docs, FILE), fresh(docs, ROW)
    gone = gone.select(F.col(FILE).alias(file), F.col(ROW).alias(row))
    return located(docs, file, row).join(gone, [file, row], "left_anti").select(*[named(c) for c in docs.columns])


def binary_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        begin = size = 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for at, n in enumerate(lengths):
            n = n or 0
            if at > begin and size + n > most:
                yield batch.slice(begin, at - begin)
                begin, size = at, 0
            size += n
        if len(lengths) > begin:
            yield batch.slice(begin, len(lengths) - begin)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow; at the end of a task its Python worker gives back what it no longer uses.

    A worker outlives its tasks, and what it holds then counts beside the next stage's.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            del batches
            gc.collect()
            pa.default_memory_pool().release_unused()

    return task


class WordIds(dict):
    """word -> number of its 128-bit hash, of which ``hashes`` gives the two halves.

    Filled on first sight and bounded: ``trim()`` between slices forgets all
    words beyond ``most``; hashes do not depend on what is remembered.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.new = most, []
        self.halves = np.empty((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(xxhash.xxh3_128_digest(word))
        return at

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.new.clear()
            self.halves = self.halves[:0]

    def hashes(self, words: Iterable[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash halves of n words, as two uint64 arrays."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.new:
            self.halves = np.concatenate([self.halves, np.frombuffer(b"".join(self.new), "<u8").reshape(-1, 2)])
            self.new.clear()
        return self.halves[at, 0], self.halves[at, 1]
