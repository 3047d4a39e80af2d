"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Both tokenizers' ids of a text cover the same bytes.  A byte offset where a token of
each ends is a shared cut, and the text between two neighbouring cuts is a
group.  Groups are found by divide and conquer: an interval looks for a common end
near its middle (each candidate by bisect in the other side's ends), is cut
there, and both halves go on; an interval without a common end inside is a group.
All intervals of a round are halved together in numpy.

Every text is first cut where both tokenizers end a token whatever stands around:
before white space after other characters and before marks after letters or digits, as
far as no piece reaches across.  Such units are tokenized, aligned and remembered once, up to a bound, so frequent words cost a
dictionary look-up.  Without such places (other pre-tokenizers) the text is one unit.

A link is a pair of token occurrences whose bytes overlap.  The number of documents
that hold an id pair linked is counted over the whole corpus: tasks count distinct
pairs first, and the table of counts is read back in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import binary_values, slices, stored
from adperf.llm.piece import BLANK, OTHER, PieceModel
from adperf.llm.token_store import _filesystem

#: Units remembered by a Python worker.
REMEMBERED = 300_000
#: Units given to the library as one text.
JOINED = 500
#: Pair counts held at once by a task.
PART = 4_000_000
#: Fixed value: white space of the byte-level pre-tokenizer's pattern, as a character class body.
WHITE = r"\t-\r \x85\xa0  -     　"


#: Stands before units that begin with a mark, where many units make one text.
FILLER = " a"
#: Some letters and digits, as a character class body; a mark after one of them begins a unit.
LETTERS = r"0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481"


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each of the ends A is also an end of B, by divide and conquer.

    Both are rising byte offsets; ``last`` has the places in A of ends known to be
    shared, the final one included.
    """
    cut = np.zeros(len(ends_a), bool)
    cut[last] = True
    lo, hi = np.append(0, last[:-1] + 1), last  # candidates of an interval: lo <= end < hi
    while True:
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return cut
        at = np.full(len(lo), -1)
        middle, todo, near, far = (lo + hi - 1) // 2, np.arange(len(lo)), 0, 1
        while len(todo):
            # the middle, then its neighbours, then twice as many on each side
            d = np.arange(near, far)
            step = np.stack([-d, d], axis=1).reshape(1, -1)
            c = middle[todo][:, None] + step
            inside = (c >= lo[todo][:, None]) & (c < hi[todo][:, None])
            offset = ends_a[np.where(inside, c, 0)]
            place = np.minimum(np.searchsorted(ends_b, offset), len(ends_b) - 1)
            hit = inside & (ends_b[place] == offset)
            found = hit.any(axis=1)
            at[todo[found]] = c[found, hit[found].argmax(axis=1)]
            left = ~found & ((middle[todo] - far >= lo[todo]) | (middle[todo] + far < hi[todo]))
            todo, near, far = todo[left], far, 2 * far
        got = at >= 0
        cut[at[got]] = True
        lo, hi = np.concatenate([lo[got], at[got] + 1]), np.concatenate([at[got], hi[got]])


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 up, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Units of text -> ids of both tokenizers, their groups and their links."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        vocabulary, byte_of = self.library.get_vocab(), _byte_of()
        self.raw_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.raw_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.model = PieceModel(path_b)
        self.raw_b = self.model.raw
        self.unknown = sentencepiece.SentencePieceProcessor(model_file=path_b).unk_id()
        self.size_a, self.size_b = (np.array([len(x) for x in raw]) for raw in (self.raw_a, self.raw_b))
        self.pattern = re.compile(self._units(json.loads(self.library.to_str())))
        # ids as text, with what follows them
        self.a_text, self.b_text = (
            [np.array([b"%d%c" % (i, mark) for i in range(len(raw))], object) for mark in marks]
            for raw, marks in ((self.raw_a, b",|"), (self.raw_b, b",;"))
        )
        self.clear()

    def _units(self, settings: dict) -> str:
        """Pattern of the units of a text that begins with a blank."""
        pre = settings.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not byte_level or settings.get("normalizer"):
            return r"(?s).+"
        white, letter = re.compile(f"[{WHITE}]"), re.compile(f"[{LETTERS}]")
        pieces = [x.decode("utf-8", "replace") for i, x in enumerate(self.raw_b) if i != self.unknown]
        # what some piece has right after a character of the other kind: no cut before it
        beside = {(x, c) for p in pieces for x, c in zip(p, p[1:], strict=False)}
        joined = {c for x, c in beside if white.match(c) and not white.match(x)} | {c for x, c in beside if not white.match(c) and letter.match(x)}
        begin = "".join(re.escape(c) for c in " \n\t\r" if c not in joined)
        marks = "".join(re.escape(c) for c in string.punctuation if c not in joined)
        if re.escape(" ") not in begin:
            return r"(?s).+"
        body = rf"[{marks}]*+[^{WHITE}{marks}]*+(?:(?<![{LETTERS}])[{marks}]++[^{WHITE}{marks}]*+)*+" if marks else rf"[^{WHITE}]*+"
        return rf"(?s)(?=.)[{WHITE}]*+{body}(?:(?![{begin}])[{WHITE}]++{body})*+"

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts = np.empty((0, 4), np.int64)  # ids A, ids B, groups, links of a unit
        self.bad = np.empty(0, bool)
        self.links = np.empty(0, np.int64)
        self.begin = np.zeros(1, np.int64)

    def _ids_a(self, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and the number of each; many units make a text.

        A unit that begins with white space may follow any but one that ends with it; one that
        begins with a mark follows a filler that ends with a letter.
        """
        white = re.compile(f"[{WHITE}]")
        texts, part, filled, after = [], [], [], ""
        for u in units:
            fill = "" if white.match(u) else FILLER
            if len(part) >= JOINED or after and white.match(after):
                texts.append("".join(part))
                part = []
            part += (fill, u)
            filled.append(len(fill))
            after = u[-1]
        texts.append("".join(part))
        encode = lambda x: [np.array(e.ids, np.int64) for e in self.library.encode_batch_fast(x, add_special_tokens=False)]
        ids = np.concatenate(encode(texts))
        size = np.stack([filled, [len(x) for x in raw]], axis=1).reshape(-1)
        ends, wanted = np.cumsum(self.size_a[ids]), np.cumsum(size)
        at = np.searchsorted(ends, wanted, "right")
        if len(ends) and ends[-1] == wanted[-1] and (ends[at - 1] == wanted)[size > 0].all():
            n = np.diff(at, prepend=0).reshape(-1, 2)
            return ids[np.repeat(np.tile([False, True], len(n)), n.reshape(-1))], n[:, 1]
        apart = encode(units)  # a vocabulary that does not give back the bytes
        return np.concatenate(apart), np.array([len(x) for x in apart], np.int64)

    def learn(self, units: list[str]) -> None:
        """Tokenize and align units not seen yet."""
        raw = [u.encode() for u in units]
        size = np.array([len(x) for x in raw], np.int64)
        a, count_a = self._ids_a(units, raw)
        symbols = self.model.merge([u.replace(" ", BLANK) for u in units])
        other = np.concatenate(symbols) >= OTHER
        if other.any():  # characters outside the vocabulary become bytes
            of = np.repeat(np.arange(len(symbols)), [len(x) for x in symbols])
            for k in np.unique(of[other]).tolist():
                symbols[k] = self.model.ids(symbols[k])
        count_b = np.array([len(s) for s in symbols], np.int64)
        b = np.concatenate(symbols)
        bad = np.zeros(len(units), bool)
        if b"".join(map(self.raw_a.__getitem__, a.tolist())) != b"".join(raw) or b"".join(map(self.raw_b.__getitem__, b.tolist())) != b"".join(raw):
            for k, (i, j) in enumerate(zip(np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b, strict=True)):
                bad[k] = any(b"".join(r[x] for x in ids) != raw[k] for r, ids in ((self.raw_a, a[i : i + count_a[k]]), (self.raw_b, b[j : j + count_b[k]])))
            a, b = a[~np.repeat(bad, count_a)], b[~np.repeat(bad, count_b)]
            count_a, count_b, size = (np.where(bad, 0, x) for x in (count_a, count_b, size))
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(size)
        good = ends[~bad]
        cut_a = np.flatnonzero(shared_ends(ends_a, ends_b, np.searchsorted(ends_a, good))) if len(good) else np.empty(0, np.int64)
        shared = ends_a[cut_a]
        cut_b = np.searchsorted(ends_b, shared)
        # groups as text: A ids, then B ids of each
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.append(0, cut_b + 1)[group_a]
        place_b = np.arange(len(b)) + (cut_a + 1)[group_b]
        tokens = np.empty(len(a) + len(b), object)
        last_a, last_b = np.isin(np.arange(len(a)), cut_a), np.isin(np.arange(len(b)), cut_b)
        tokens[place_a] = np.where(last_a, self.a_text[1][a], self.a_text[0][a])
        tokens[place_b] = np.where(last_b, self.b_text[1][b], self.b_text[0][b])
        tokens, stop = tokens.tolist(), np.cumsum(count_a + count_b).tolist()
        self.text += [b"".join(tokens[i:j]) for i, j in zip([0, *stop], stop, strict=False)]
        # links: a piece of text between two ends of either side lies in one token of each
        either = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, either)] * len(self.raw_b) + b[np.searchsorted(ends_b, either)]
        upto = lambda x: np.searchsorted(x, ends, "right")
        n_groups, n_links = np.diff(upto(shared), prepend=0), np.diff(upto(either), prepend=0)
        self.counts = np.concatenate([self.counts, np.stack([count_a, count_b, n_groups, n_links], axis=1)])
        self.bad = np.concatenate([self.bad, bad])
        self.begin = np.concatenate([self.begin, len(self.links) + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, links])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, groups as text, document of each link kind, link kind, its times) of texts.

        Empty texts and those whose ids do not give back their bytes have no tokens.
        """
        if len(self.number) > REMEMBERED:
            self.clear()
        number, new, found = self.number, [], []
        for t in texts:
            of = []
            for u in self.pattern.findall(" " + t) if t else ():
                at = number.get(u)
                if at is None:
                    number[u] = at = len(number)
                    new.append(u)
                of.append(at)
            found.append(of)
        if new:
            self.learn(new)
        size = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate([np.array(x, np.int64) for x in found]) if found else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), size)
        bad = np.zeros(len(texts), bool)
        bad[doc[self.bad[flat]]] = True
        kept = ~bad[doc]
        flat, doc = flat[kept], doc[kept]
        counts = np.stack([np.bincount(doc, self.counts[flat, k], len(texts)).astype(np.int64) for k in range(4)], axis=1)
        groups = [b"".join(map(self.text.__getitem__, x))[:-1] if not z else b"" for x, z in zip(found, bad.tolist(), strict=True)]
        n = self.begin[flat + 1] - self.begin[flat]
        links = self.links[np.repeat(self.begin[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        kinds = len(self.raw_a) * len(self.raw_b)
        key, times = np.unique(np.repeat(doc, n) * kinds + links, return_counts=True)
        return counts, groups, key // kinds, key % kinds, times


def _aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker, kept between the tasks that it runs."""
    kept = sys.modules.setdefault("_aligner_of_worker", types.ModuleType("_aligner_of_worker")).__dict__
    if kept.get("key") != (path_a, path_b):
        kept.update(key=(path_a, path_b), aligner=Aligner(path_a, path_b))
    return kept["aligner"]


def _vocabulary(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, kinds, times) of every row.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of the ids, or with ``digest`` its
    SHA-256 in hex; '' without tokens.  ``kinds`` are the distinct linked id pairs of the row,
    id A times the size of vocabulary B plus id B, and ``times`` how often each
    is linked, as little-endian unsigned 64-bit and 32-bit integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        aligner = _aligner(path_a, path_b)
        for b in slices(batches, "text", 4 << 20):
            texts = [x.decode("utf-8", "replace") for x in binary_values(b.column("text"))]
            counts, groups, doc, kind, times = aligner.align(texts)
            border = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            raw_kind, raw_times = kind.astype("<u8").tobytes(), times.astype("<u4").tobytes()
            if digest:
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            else:
                groups = [g.decode() for g in groups]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(counts[:, k]) for k in range(4)], pa.array(groups, pa.string()),
                 *[pa.array([raw[w * i : w * j] for i, j in zip(border, border[1:], strict=False)], pa.binary()) for raw, w in ((raw_kind, 8), (raw_times, 4))]],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "kinds", "times"],
            )

    return rows.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, kinds binary, times binary")


def link_counts(rows: DataFrame, vocabulary_b: int) -> DataFrame:
    """(kind, n, best) from the rows of :func:`aligned`: in how many rows a pair is linked, and whether that is its A id's highest number."""

    def run(batches):
        held, size = [], 0

        def merged():
            kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            kind, at = np.unique(kind, return_inverse=True)
            return kind, np.bincount(at, n).astype(np.int64)

        for b in slices(batches, "kinds", 16 << 20):
            kind, n = np.unique(np.frombuffer(b"".join(binary_values(b.column("kinds"))), "<i8"), return_counts=True)
            held.append((kind, n))
            size += len(kind)
            if size > PART:
                held = [merged()]
                size = len(held[0][0])
                if size > PART // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["kind", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["kind", "n"])

    n = stored(rows.select("kinds").mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")))
    a = F.expr(f"kind div {vocabulary_b}")
    # an id has at most as many kinds as the other vocabulary has entries
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(most, "a").select("kind", "n", (F.col("n") == F.col("most")).alias("best"))


def _parts(counts: DataFrame, most: int) -> list[list[str]]:
    """Files of a stored table, dealt into parts of about ``most`` rows; a file has no more than that."""
    files = counts.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts, held = [[]], 0
    for f in sorted(files, key=lambda f: f.path):
        if held and held + f.n > most:
            parts.append([])
            held = 0
        parts[-1].append(f.path)
        held += f.n
    return parts


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, part: int = PART,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    A text is aligned with a blank before it.  A null or empty text, and one whose ids
    of either tokenizer do not give back its bytes, has no tokens and zeros.  Repeated
    rows count each; an empty table gives none; other columns are not read.
    Texts are never cut short: a text without blanks is one unit.  Tokenizer files must be readable on
    every executor.
    """
    rows = stored(aligned(docs, path_a, path_b, id_col, text_col, digest))
    counts = stored(link_counts(rows, _vocabulary(path_b)))
    n = counts.count()
    counts = stored(counts.repartition(max(1, -(-2 * n // part)), "kind"))
    parts = _parts(counts, part)

    def run(batches):
        kept = sys.modules.setdefault("_aligner_of_worker", types.ModuleType("_aligner_of_worker")).__dict__

        def table(paths):
            if kept.get("paths") != paths:
                read = []
                for path in paths:
                    fs, at = _filesystem(path)
                    read.append(pq.read_table(at, filesystem=fs))
                got = pa.concat_tables(read)
                order = np.argsort(got.column("kind").to_numpy())
                kept.update(paths=paths, table=[got.column(c).to_numpy()[order] for c in ("kind", "n", "best")])
            return kept["table"]

        for b in slices(batches, "kinds", 16 << 20):
            raw = binary_values(b.column("kinds"))
            kind = np.frombuffer(b"".join(raw), "<i8")
            times = np.frombuffer(b"".join(binary_values(b.column("times"))), "<u4").astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), [len(x) // 8 for x in raw])
            sums = np.zeros((2, b.num_rows), np.int64)
            for paths in parts if len(kind) else ():
                keys, n, best = table(paths)
                at = np.minimum(np.searchsorted(keys, kind), len(keys) - 1)
                has = np.flatnonzero(keys[at] == kind)
                np.add.at(sums[0], doc[has], times[has] * best[at[has]])
                np.add.at(sums[1], doc[has], times[has] * n[at[has]])
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
            columns = {c: b.column(c) for c in names if c in b.schema.names} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return rows.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
