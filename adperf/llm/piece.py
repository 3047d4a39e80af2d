"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes one flat numpy array of symbols with word boundaries.  In each
round every word finds its best pair (segmented minimum of the pair ranks),
all words merge their leftmost best pair at once, the array is compacted, and
words without a pair leave.  Rounds end when no word is left.  Words of more
than ``LONG`` symbols (very long runs without a blank) merge through a heap
instead, which gives the same merges in n log n steps.

Words are cut where no piece of the vocabulary can reach across: before a run
of blanks, and around characters that no longer piece contains.  Equal words
are merged once and remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import binary_values, slices

BLANK = "▁"
#: Symbols beyond which a word takes the heap.
LONG = 256
#: Words remembered by a task.
REMEMBERED = 300_000
#: Symbols at or above this are characters outside the vocabulary: OTHER + code point.
OTHER = 1 << 21
NONE = np.int64(1 << 40)


class PieceModel:
    """Vocabulary of a BPE model file as arrays: pair -> merged piece, and ranks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(np.unique(-scores), -scores)
        self.byte = np.zeros(256, np.int64)
        self.raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[value] = i
                self.raw[i] = bytes([value])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.raw[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        rows = []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = (pieces.get(x, OTHER + ord(x) if len(x) == 1 else None) for x in (p[:cut], p[cut:]))
                if a is not None and b is not None:
                    rows.append(((a << 22) | b, i))
        pairs = np.array(sorted(rows), np.int64).reshape(-1, 2)
        self.keys, self.made = pairs[:, 0].copy(), pairs[:, 1].copy()
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t" if c not in joined)
        # With `alone` characters as words of their own, no piece reaches across a cut.
        self.cut = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        table = np.arange(0x110000, dtype=np.int64) + OTHER
        for c, i in self.chars.items():
            table[ord(c)] = i
        self.symbol = table
        self.spans = max((len(p) for p in pieces), default=1)
        crossing = [p for p in pieces if BLANK in p.lstrip(BLANK)]
        if crossing:  # a blank inside or after a word: nothing can be cut
            self.cut = re.compile(r"(?s).+")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged piece, rank) of each pair; rank NONE where there is none."""
        key = (left << 22) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        made = self.made[at]
        return made, np.where(found, self.rank[made], NONE)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The symbols of each word after all merges."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._heap(self.symbol[np.frombuffer(w.encode("utf-32-le"), np.uint32)])
            else:
                short.append(i)
        if not short:
            return out
        codes = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le"), np.uint32)
        sym = self.symbol[codes]
        word = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        done_sym, done_word = [], []
        while len(sym):
            made, rank = self.lookup(sym[:-1], sym[1:])
            rank = np.append(np.where(word[1:] == word[:-1], rank, NONE), NONE)
            made = np.append(made, 0)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            live = np.repeat(best < NONE, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            # the leftmost best pair of each word
            hit = np.flatnonzero(live & (rank == np.repeat(best, sizes)))
            if not len(hit):
                break
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            sym = sym.copy()
            sym[hit] = made[hit]
            live[hit + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        for w, part in zip(word[first], np.split(sym, first[1:]), strict=True):
            out[w] = part
        return out

    def _heap(self, sym: np.ndarray) -> np.ndarray:
        """The same merges for one long word: best rank first, leftmost among equals."""
        sym, n = sym.tolist(), len(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        made, rank = self.lookup(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
        heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (m, r) in enumerate(zip(made, rank, strict=True)) if r < NONE]
        heapq.heapify(heap)
        keys, results, ranks = self.keys, self.made, self.rank

        def push(i: int) -> None:
            j = after[i]
            if i < 0 or j < 0:
                return
            key = (sym[i] << 22) | sym[j]
            at = int(np.searchsorted(keys, key))
            if at < len(keys) and keys[at] == key:
                m = int(results[at])
                heapq.heappush(heap, (int(ranks[m]), i, sym[i], sym[j], m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in sym if s >= 0], np.int64)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as vocabulary ids; characters outside it as their UTF-8 byte pieces."""
        if not (symbols >= OTHER).any():
            return symbols
        parts = []
        for s in symbols.tolist():
            parts += [s] if s < OTHER else self.byte[list(chr(s - OTHER).encode())].tolist()
        return np.array(parts, np.int64)


class _Numbers(dict):
    """word -> its number, given on first sight; ``new`` has the words not merged yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Encodes and decodes texts with a model; remembers a bounded number of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.number = _Numbers()
        self.ids: list[bytes] = []  # by word number: its ids as little-endian uint32
        raw = self.model.raw
        self.pieces = np.empty(len(raw), object)
        self.pieces[:] = raw

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids, as uint32."""
        m = self.model
        if len(self.ids) > REMEMBERED:
            self.number.clear()
            self.ids.clear()
        number = self.number.__getitem__
        cut = [list(map(number, m.cut.findall(BLANK + t.replace(" ", BLANK)))) if t else [] for t in texts]
        self.ids += [m.ids(symbols).astype("<u4").tobytes() for symbols in m.merge(self.number.new)]
        self.number.new.clear()
        begin, end = (np.array([x], "<u4").tobytes() for x in (m.bos, m.eos))
        ids = self.ids.__getitem__
        return [np.frombuffer(b"".join([begin, *map(ids, words), end]), "<u4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, blanks restored, the leading blank removed, bytes joined to characters."""
        raw = b"".join(self.pieces[ids])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row.

    Null counts as the empty text, which has the begin and end ids only.
    Repeated rows give repeated results, an empty table none; other columns are
    not read.  ``model_path`` must be readable on every executor.
    """
    return _mapped(docs, model_path, id_col, text_col, "id long, ids array<int>, decoded string", lambda ids, text: (
        pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(text, pa.string())))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, the ids and the decoded text as their count and SHA-256."""
    return _mapped(docs, model_path, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string())))


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder = Encoder(model_path)
        for b in slices(batches, "text"):
            ids = encoder.encode([x.decode("utf-8", "replace") for x in binary_values(b.column("text"))])
            decoded = [encoder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns(ids, decoded)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)
