"""Token ids in binary files of independent zstandard frames.

A file holds one frame per document in id order, then a table with one entry
per frame and a footer:

    frame*  entry*  footer
    entry   = offset u64, stored size u32, CRC-32 of the stored frame u32,
              document id i64 (NULL_ID if null), tokens before it in the file u64, tokens u32
    footer  = number of frames u64, CRC-32 of the table u32, token width u8, magic 8 bytes

All numbers are little-endian.  A reader takes the footer and the table, and
then only the frames of the documents it wants.  A frame of another checksum
is refused.  Files are written under a name of the task attempt and then moved
to their final name, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import os
import string
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adperf.llm.common import binary_values, frugal, shared_path, slices, stored

ENTRY = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("doc_id", "<i8"), ("start", "<u8"), ("tokens", "<u4")])
FOOTER = np.dtype([("frames", "<u8"), ("crc", "<u4"), ("width", "u1"), ("magic", "S8")])
MAGIC = b"TOKZSTD1"
NULL_ID = -(1 << 63)
LEVEL = 3
#: Words remembered by a task.
REMEMBERED = 300_000
#: Words given to the library as one text.
JOINED = 500
#: Mark of a vocabulary entry that ends a word (fixed value of the format).
WORD_END = "</w>"
#: ASCII characters that are neither white space, controls, letters nor digits.
MARKS = string.punctuation.encode()


def _filesystem(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class _Words(dict):
    """word -> its number, given on first sight; ``new`` has the words not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def forget(self, kept: int) -> None:
        """Forget all but the first ``kept`` words."""
        for word in list(self)[kept:]:
            del self[word]


def _tokenizer(path: str, by_word: bool) -> Tokenizer:
    """The tokenizer of this Python worker, kept between the tasks that it runs."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    key = (path, by_word)
    if store.get("key") != key:
        store.update(key=key, tokenizer=Tokenizer(path, by_word))
    return store["tokenizer"]


class Tokenizer:
    """Ids of whole texts from the tokenizers library, word by word.

    The model lower-cases, drops white space and never joins across it, so the
    ids of a text are those of its words one after the other.  A word is encoded
    by the library on first sight; the first REMEMBERED words stay, later ones are
    forgotten together when they are as many again.  ASCII words that differ in
    case only are encoded once, and ASCII marks after letters apart from them,
    as the model splits them there.  Runs of letters or of marks are handed to the
    library many at a time, with a space between: each has one entry that ends a
    word, its last, at least, so as many ends as words prove where each begins;
    else they are encoded one by one.  With a tokenizer that keeps white space or
    case or splits otherwise, ``by_word=False`` encodes whole texts.
    """

    def __init__(self, path: str, by_word: bool = True):
        # one thread: the cores belong to Spark's tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library, self.by_word = Library.from_file(path), by_word
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[at for entry, at in vocabulary.items() if entry.endswith(WORD_END)]] = True
        self.number = _Words()
        self.ids: list[bytes] = []

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        """Letters and the ASCII marks after them; empty for a word of another form."""
        stem = word.rstrip(MARKS)
        if stem.isalpha():  # of bytes: ASCII letters only
            stem = stem.lower()
        # letters as the model sees them: some become a letter and a mark, which marks after it would join
        elif stem.isascii() or not unicodedata.normalize("NFC", stem.decode("utf-8", "replace")).lower().isalpha():
            return ()
        return (stem, word[len(stem) :]) if len(stem) < len(word) else (stem,)

    def _encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        for lo in range(0, len(texts), 2000):
            part = [t.decode("utf-8", "replace") for t in texts[lo : lo + 2000]]
            for x in self.library.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()

    def _encoded_joined(self, words: list[bytes]) -> Iterator[bytes]:
        parts = [words[lo : lo + JOINED] for lo in range(0, len(words), JOINED)]
        texts = [b" ".join(part).decode("utf-8") for part in parts]
        for part, x in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(part) or ends[-1] != ids.nbytes:
                yield from self._encoded(part)
                continue
            raw, begin = ids.tobytes(), 0
            for stop in ends.tolist():
                yield raw[begin:stop]
                begin = stop

    def forget(self) -> None:
        """Forget all words; the library stays."""
        self.number.clear()
        self.number.new.clear()
        self.ids.clear()

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        last = np.array([end], "<u4").tobytes()
        if not self.by_word:
            return [np.frombuffer(x + last, "<u4") for x in self._encoded(texts)]
        if len(self.ids) > 2 * REMEMBERED:
            self.number.forget(REMEMBERED)
            del self.ids[REMEMBERED:]
        number = self.number.__getitem__
        words = [list(map(number, t.split())) for t in texts]  # bytes.split() cuts at ASCII white space only
        parts = [self._parts(w) for w in self.number.new]
        kinds = list(dict.fromkeys(chain.from_iterable(parts)))
        known = dict(zip(kinds, self._encoded_joined(kinds), strict=True))
        others = [w for w, p in zip(self.number.new, parts, strict=True) if not p]
        known.update(zip(others, self._encoded(others), strict=True))
        self.ids += [b"".join([known[x] for x in p]) if p else known[w] for w, p in zip(self.number.new, parts, strict=True)]
        self.number.new.clear()
        ids = self.ids.__getitem__
        return [np.frombuffer(b"".join([*map(ids, x), last]), "<u4") for x in words]


class Writer:
    """Writes one file; documents are added in id order, then ``close()``."""

    def __init__(self, path: str, width: int = 4):
        import zstandard

        self.fs, self.path = _filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = self.fs.open_output_stream(self.part), width
        self.entries: list[tuple] = []
        self.offset = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"token id {ids.max()} does not fit in {self.width} bytes")
        frame = self.pack(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.entries.append((self.offset, len(frame), zlib.crc32(frame), NULL_ID if doc_id is None else doc_id, self.tokens, len(ids)))
        self.offset += len(frame)
        self.tokens += len(ids)

    def close(self) -> None:
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(table)
        self.out.write(np.array([(len(self.entries), zlib.crc32(table), self.width, MAGIC)], FOOTER).tobytes())
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Reads single documents of a file without decompressing others."""

    def __init__(self, path: str):
        import zstandard

        self.fs, at = _filesystem(path)
        self.file = self.fs.open_input_file(at)
        size = self.file.size()
        footer = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if footer["magic"] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n = int(footer["frames"]) * ENTRY.itemsize
        table = self.file.read_at(n, size - FOOTER.itemsize - n)
        if zlib.crc32(table) != footer["crc"]:
            raise ValueError(f"the table of {path} is damaged")
        self.entries, self.width = np.frombuffer(table, ENTRY), int(footer["width"])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def find(self, doc_id: int | None) -> np.ndarray:
        """Places of a document's frames, by binary search."""
        ids = self.entries["doc_id"]
        key = NULL_ID if doc_id is None else doc_id
        return np.arange(np.searchsorted(ids, key), np.searchsorted(ids, key, "right"))

    def ids(self, at: int) -> np.ndarray:
        e = self.entries[at]
        frame = self.file.read_at(int(e["size"]), int(e["offset"]))
        if zlib.crc32(frame) != e["crc"]:
            raise ValueError(f"frame {at} is damaged")
        return np.frombuffer(self.unpack(frame), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def token_lengths(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True,
    remember: bool = True,
) -> DataFrame:
    """(id, n_tokens) of every row, as :func:`write_tokens` would store them; nothing is written.

    With ``remember`` a Python worker keeps the words it has seen for its next task, and so their memory
    while it idles or runs another operator; without, it gives that back at the end of each task.
    """

    def run(batches):
        tokenizer = None
        try:
            for b in slices(batches, "text", 2 << 20):
                tokenizer = _tokenizer(tokenizer_path, by_word)
                ids = tokenizer.encode(binary_values(b.column("text")), end_id)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in ids], pa.int64())], names=["id", "n_tokens"])
        finally:
            if tokenizer and not remember:
                tokenizer.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run if remember else frugal(run), "id long, n_tokens long")


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    partitions: int | None = None, width: int = 2, by_word: bool = True,
) -> DataFrame:
    """Encode all texts and write them in ascending id order; the manifest of the files.

    Rows are dealt by ranges of ids, so file n holds smaller ids than file n + 1;
    null ids come first, repeated ids stand side by side (a null text is empty:
    it has the end id only).  An empty table gives no file and an empty manifest.
    The manifest (file number, path, docs, tokens, tokens in earlier files) has a
    row per file and is returned stored.  ``width`` is bytes per token; an id
    that does not fit is refused.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("file", F.spark_partition_id())

    def run(batches):
        tokenizer, writer, number = None, None, 0
        for b in slices(batches, "text", 2 << 20):
            if writer is None:
                number = b.column("file")[0].as_py()
                path = f"{folder.rstrip('/')}/tokens-{number:06d}.tokz"
                tokenizer, writer = _tokenizer(tokenizer_path, by_word), Writer(path, width)
            for doc_id, ids in zip(b.column("id").to_pylist(), tokenizer.encode(binary_values(b.column("text")), end_id), strict=True):
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [path], "docs": [len(writer.entries)], "tokens": [writer.tokens]})

    schema = "file long, path string, docs long, tokens long"
    files = stored(rows.mapInArrow(run, schema))
    # one row per file, not per document
    earlier = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return stored(files.withColumn("before", F.coalesce(earlier, F.lit(0)).cast("long")))


def read_tokens(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids | ids_crc32) of every document, read from the files of a manifest."""
    names = ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"]

    def run(batches):
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                reader = Reader(path)
                for lo in range(0, len(reader.entries), 1000):
                    part = reader.entries[lo : lo + 1000]
                    ids = [reader.ids(lo + k) for k in range(len(part))]
                    null = part["doc_id"] == NULL_ID
                    last = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if digest else pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["doc_id"], pa.int64(), mask=null), pa.array(part["start"].astype("i8") + before), pa.array([len(x) for x in ids], pa.int64()), last],
                        names=names,
                    )
                reader.close()

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return manifest.repartition(n, "file").mapInArrow(run, schema)


def index(manifest: DataFrame) -> DataFrame:
    """(id, path, at): the place of each document's frame, from the tables of the files alone."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                reader = Reader(path)
                ids = reader.entries["doc_id"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array([path] * len(ids), pa.string()), pa.array(np.arange(len(ids)))],
                    names=["id", "path", "at"],
                )
                reader.close()

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "file").mapInArrow(run, "id long, path string, at long")


def read_documents(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the wanted documents; only their frames are read and decompressed."""
    asked = wanted.select(F.col(id_col).cast("long").alias("asked")).distinct()
    places = index(manifest).join(asked, F.col("id").eqNullSafe(F.col("asked"))).select("id", "path", "at")

    def run(batches):
        for b in batches:
            readers: dict[str, Reader] = {}
            out = []
            for path, at in zip(b.column("path").to_pylist(), b.column("at").to_pylist(), strict=True):
                if path not in readers:
                    for r in readers.values():
                        r.close()
                    readers = {path: Reader(path)}
                out.append(readers[path].ids(at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])
            for r in readers.values():
                r.close()

    return places.sortWithinPartitions("path", "at").mapInArrow(run, "id long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "adperf-tokens", uuid.uuid4().hex)
