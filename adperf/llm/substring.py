"""Long repeated passages by recompression.

Texts are token sequences.  Rounds rename them: first short runs of one token
become one symbol, then in every round each symbol is dealt, by its name, to the
left or the right class, and every left-right pair becomes one symbol.  A new
name is the hash of what it stands for, so all tasks of the cluster give equal
substrings equal names without exchanging a dictionary.  A symbol's *reach* is
the range of words that its existence depends on; where the reach lies inside a
passage, every copy of that passage has the same symbol at the same place.

A window of ``window`` words is represented by its longest symbol with reach
inside the window (ties: name, then place), so equal windows have equal
representatives.  Adjacent windows with one representative are a span.

1. Spark groups the representatives of all spans by name.  A name that occurs once
   rules its windows out; a name and extent (digest of all words of the span)
   that occur twice settle all windows of the span at once.  That settles the
   inside of every long repeat with a few symbols.
2. What is left are spans at the ends of repeats: same name, other extent.  Their
   windows are compared one by one, by a 128-bit digest of all their words.
3. Words covered by repeated windows are removed.

Each task first compares within itself and sends one entry per distinct key, so a
passage that a third of all documents share costs one entry per task, and no
group grows with the number of its copies.  Symbols only propose: what is removed
rests on digests of the words themselves (128 bits; a name's 64 bits and its
extent's 64 bits count together).  Windows without a representative go to step 2.
"""

from __future__ import annotations

import hashlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import FILE, ROW, WordIds, binary_values, located, scanned, slices, stored
from adperf.llm.neardup import mix

WINDOW = 35
ROUNDS = 6
#: Runs of up to so many equal tokens get a name; in longer ones tokens stay single.
RUN = 4
#: Entries that a task gathers before it sends them.
CHUNK = 600_000
#: Bytes of text for which there is a bucket of entries, which one task settles.
BUCKET = 64 << 20
#: Extents of one name within a task from which they are grouped by name and extent.
MANY = 16
ENTRY = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("row", "<u4"), ("at", "<u4"), ("n", "<u4"), ("f", "u1")])
#: Flags of an entry: place unknown here, key repeats in its task, name repeats in its task, settled as repeated, settled as undecided, name grouped elsewhere as well.
NOWHERE, TWICE, NAMED, SETTLED, OPEN, SPREAD = 1, 2, 4, 8, 16, 32
#: Status of a span: its windows must be compared, are repeated, are repeated and must be shown to others.
COMPARE, REPEATED, SHOWN = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def to(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", self.inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


def digests(hashes: np.ndarray, powers: Powers):
    """A function (begin, end) -> hash of the words between, for arrays of places."""
    up, down = powers.to(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * up[: len(hashes)])])
    return lambda begin, end: mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _ODD)


def recompress(words: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int):
    """(name, begin, end, reach begin, reach end) of the symbols after the rounds.

    ``words`` holds the tokens of many documents; ``first`` and ``last`` are the
    bounds of each token's document.  A reach that touches a document's end lies
    outside the document by one.
    """
    n = len(words)
    new = np.append(True, (words[1:] != words[:-1]) | (first[1:] != first[:-1]))
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, n))
    named = size <= RUN
    # runs that get a name, and the single tokens of the longer ones
    whole = np.repeat(named, size)
    begin = np.flatnonzero(new | ~whole)
    of = np.cumsum(new)[begin] - 1
    end = np.where(named[of], run[of] + size[of], begin + 1)
    count = (end - begin).astype(np.uint64)
    name = np.where(count > 1, mix(words[begin] + count * _ODD), words[begin])
    lo = np.where(named[of], begin - 1, np.maximum(begin - RUN, run[of] - 1))
    hi = np.where(named[of], end + 1, np.minimum(end + RUN, run[of] + size[of] + 1))
    first, last = first[begin], last[begin]
    lo, hi = np.maximum(lo, first - 1), np.minimum(hi, last + 1)
    for r in range(rounds):
        salt = np.uint64((r + 1) * int(_ODD) % (1 << 64))
        left = (mix(name ^ salt) >> np.uint64(63)).astype(bool)
        near = np.append(first[1:] == first[:-1], False)
        after = np.append(left[1:], True)  # class of the next symbol
        pair = near & left & ~after
        second = np.append(False, pair[:-1])
        # a single left symbol depends on the next one, a single right symbol on the one before
        hi_next = np.where(near, np.append(hi[1:], 0), last + 1)
        lo_before = np.where(np.append(False, near[:-1]), np.append(0, lo[:-1]), first - 1)
        single = ~pair & ~second
        hi = np.where(pair, np.append(hi[1:], 0), np.where(single & left, hi_next, hi))
        lo = np.where(single & ~left, lo_before, lo)
        end = np.where(pair, np.append(end[1:], 0), end)
        name = np.where(pair, mix(mix(name) + np.append(name[1:], np.uint64(0)) * _ODD), name)
        keep = ~second
        name, begin, end, lo, hi, first, last = (x[keep] for x in (name, begin, end, lo, hi, first, last))
    return name, begin, end, lo, hi


def spans(symbols, first: np.ndarray, last: np.ndarray, window: int):
    """(first window, number of windows, name, has a representative) of the spans of all documents."""
    name, begin, end, lo, hi = symbols
    p = np.arange(len(first))
    p = p[p + window <= last]
    if not len(p):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, bool)
    a, b = np.searchsorted(lo, p), np.searchsorted(hi, p + window, "right")
    some = a < b
    key = (np.minimum(end - begin, 63).astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))
    best = np.full(len(p), -1)
    if some.any():
        # place of the greatest key in each range, the leftmost of equals, from tables of ranges of 1, 2, 4, ...
        sa, sb = a[some], b[some]
        level = np.frexp((sb - sa).astype(float))[1] - 1
        got = np.empty(len(sa), np.int64)
        table = np.arange(len(key))
        for j in range(int(level.max()) + 1):
            at = level == j
            x, y = table[sa[at]], table[sb[at] - (1 << j)]
            got[at] = np.where(key[y] > key[x], y, x)
            if len(table) > (1 << j):
                x, y = table[: -(1 << j)], table[1 << j :]
                table = np.where(key[y] > key[x], y, x)
        best[some] = got
    cut = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (first[p[1:]] != first[p[:-1]])))
    size = np.diff(np.append(cut, len(p)))
    return p[cut], size, np.where(best[cut] >= 0, name[best[cut]], np.uint64(0)), best[cut] >= 0


def _groups(*keys: np.ndarray):
    """(order, group of each sorted row, size of each group) by the keys, the first one foremost."""
    order = np.lexsort(keys[::-1])
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(order) else np.empty(0, np.int64)


def _entries(**columns) -> np.ndarray:
    out = np.zeros(len(columns["k1"]), ENTRY)
    for k, v in columns.items():
        out[k] = v
    return out


def name_entries(e: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends for its spans (k1 name, k2 extent): entries and their buckets.

    One entry per (name, extent); its further copies are settled.  A name with many
    extents is grouped by name and extent, and announced to the group of its name.
    """
    open_ = e["f"] & OPEN > 0
    sent = [e[open_]]
    e = e[~open_]
    order, group, size = _groups(e["k1"], e["k2"])
    e = e[order]
    lead = np.append(True, group[1:] != group[:-1]) if len(e) else np.empty(0, bool)
    more = e[~lead]
    more["f"] = SETTLED
    e, twice = e[lead], size > 1
    e["f"] |= np.where(twice, TWICE, 0).astype("u1")
    _, name, extents = _groups(e["k1"])  # e is sorted by name
    occurrences = np.bincount(name, weights=size) if len(e) else np.empty(0)
    several, many = occurrences[name] > 1, extents[name] > MANY
    e["f"] |= np.where(several, NAMED, 0).astype("u1") | np.where(many, SPREAD, 0).astype("u1")
    call = e[many & np.append(True, name[1:] != name[:-1])] if len(e) else e
    call = call.copy()
    call["f"] = NOWHERE | NAMED | SPREAD
    key = mix(np.where(many, mix(e["k1"]) + e["k2"], e["k1"]))
    sent += [more, e, call]
    own = [mix(x["row"].astype(np.uint64)) for x in sent[:2]]
    keys = np.concatenate([*own, key, mix(call["k1"])])
    return np.concatenate(sent), (keys % np.uint64(buckets)).astype(np.int32)


def name_results(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, status) of the spans that are repeated or must be compared, from all entries of a bucket."""
    done = e["f"] & (SETTLED | OPEN) > 0
    out, status = [np.flatnonzero(done)], [np.where(e["f"][done] & SETTLED > 0, REPEATED, COMPARE)]
    at = np.flatnonzero(~done)
    x = e[at]
    order, group, size = _groups(x["k1"], x["k2"])
    x, at = x[order], at[order]
    if len(x):
        flag = lambda bit: x["f"] & bit > 0
        nowhere = flag(NOWHERE)
        real = np.bincount(group, weights=~nowhere)
        twice = np.bincount(group, weights=flag(TWICE)) > 0
        full = ((real > 1) | twice)[group] & ~nowhere
        name = np.cumsum(np.append(True, x["k1"][1:] != x["k1"][:-1])) - 1
        shared = ((np.bincount(name) > 1) | (np.bincount(name, weights=flag(NAMED)) > 0))[name]
        # a settled span is shown to spans of the same name that must be compared, one per extent
        mixed = ((np.bincount(name, weights=~full & ~nowhere) > 0) | (np.bincount(name, weights=flag(SPREAD)) > 0))[name]
        lead = np.append(True, group[1:] != group[:-1])
        lead = lead | (np.append(False, nowhere[:-1]) & ~nowhere & np.append(True, group[1:] == group[:-1]))
        take = shared & ~nowhere
        out.append(at[take])
        status.append(np.where(full, np.where(mixed & lead, SHOWN, REPEATED), COMPARE)[take])
    return np.concatenate(out), np.concatenate(status)


def window_entries(e: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends for single windows: one entry per window digest; repeats within the task are settled."""
    order, group, size = _groups(e["k1"], e["k2"])
    e = e[order]
    twice = (size > 1)[group] if len(e) else np.empty(0, bool)
    settled = e[twice & (e["f"] & NOWHERE == 0)]
    settled["f"] = SETTLED
    lead = np.append(True, group[1:] != group[:-1]) if len(e) else np.empty(0, bool)
    one = e[lead]
    one["f"] |= np.where(twice[lead], TWICE | NOWHERE, 0).astype("u1")
    keys = np.concatenate([mix(settled["row"].astype(np.uint64)), mix(one["k1"])])
    return np.concatenate([settled, one]), (keys % np.uint64(buckets)).astype(np.int32)


def window_results(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    done = e["f"] & SETTLED > 0
    out = [np.flatnonzero(done)]
    at = np.flatnonzero(~done)
    x = e[at]
    order, group, size = _groups(x["k1"], x["k2"])
    if len(x):
        x, at = x[order], at[order]
        repeated = ((size > 1) | (np.bincount(group, weights=x["f"] & TWICE > 0) > 0))[group]
        out.append(at[repeated & (x["f"] & NOWHERE == 0)])
    out = np.concatenate(out)
    return out, np.full(len(out), REPEATED)


BLOBS = "bucket int, file long, base long, entries binary"
FOUND = "file long, row long, at int, n int, status int"


def _sent(file: int, base: int, parts: list[np.ndarray], make, buckets: int) -> pa.RecordBatch:
    e, bucket = make(np.concatenate(parts), buckets)
    order = np.argsort(bucket, kind="stable")
    e, bucket = e[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(e) else np.empty(0, int)
    blobs = [x.tobytes() for x in np.split(e, cut[1:])] if len(e) else []
    k = len(blobs)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int32()), pa.array([file] * k, pa.int64()), pa.array([base] * k, pa.int64()), pa.array(blobs, pa.binary())],
        names=["bucket", "file", "base", "entries"],
    )


def _exchange(rows: DataFrame, entries_of, make, settle, buckets: int) -> DataFrame:
    """Entries of all rows, grouped by bucket and settled: (file, row, at, n, status).

    ``rows`` has file and row; ``entries_of`` gives the entries of a slice with
    ``row`` as the row's number in it.  Entries name a row by its distance from
    the first row of what a task sends together.
    """

    def send(batches):
        tools = (WordIds(), Powers())
        parts, file, base, held = [], None, 0, 0
        for b in slices(batches, "text", 1 << 20):
            files, numbers = b.column("file").to_numpy(), b.column("row").to_numpy()
            for part in np.split(np.arange(len(files)), np.flatnonzero(files[1:] != files[:-1]) + 1):
                if parts and (files[part[0]] != file or held > CHUNK or numbers[part[-1]] - base >= 1 << 32):
                    yield _sent(file, base, parts, make, buckets)
                    parts, held = [], 0
                if not parts:
                    file, base = int(files[part[0]]), int(numbers[part[0]])
                e = entries_of(b.slice(part[0], len(part)), *tools)
                e["row"] = (numbers[part] - base)[e["row"]]
                parts.append(e)
                held += len(e)
                tools[0].trim()
        if parts:
            yield _sent(file, base, parts, make, buckets)

    def settled(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blobs = [np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()]
        sizes = [len(x) for x in blobs]
        at, status = settle(np.concatenate(blobs))
        e = np.concatenate(blobs)[at]
        file, base = (np.repeat(table.column(c).to_numpy(), sizes)[at] for c in ("file", "base"))
        return pa.table({
            "file": pa.array(file, pa.int64()), "row": pa.array(base + e["row"], pa.int64()), "at": pa.array(e["at"].astype("i4")),
            "n": pa.array(e["n"].astype("i4")), "status": pa.array(status.astype("i4")),
        })

    return rows.mapInArrow(send, BLOBS).groupBy("bucket").applyInArrow(settled, FOUND)


def _tokens(texts: list[bytes], ids: WordIds):
    """(words of each text, high and low hash halves of all, first and last place of each word's text, first place of each text)."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    high, low = ids.hashes(chain.from_iterable(words), int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return words, high, low, np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes), starts


def _span_entries(window: int, rounds: int):
    def entries(batch, ids, powers):
        _, high, low, first, last, starts = _tokens(binary_values(batch.column("text")), ids)
        if not len(high):
            return np.zeros(0, ENTRY)
        at, n, name, has = spans(recompress(high, first, last, rounds), first, last, window)
        extent = digests(low, powers)(at, at + n + window - 1)
        row = np.searchsorted(starts, at, "right") - 1
        return _entries(k1=name, k2=extent, row=row, at=at - starts[row], n=n, f=np.where(has, 0, OPEN))

    return entries


def _lists(column: pa.Array, *fields: str):
    """Bounds of each row's list, and the flat values (of the fields, if any) as arrays; null is an empty list."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    values = [pa.compute.struct_field(flat, f).to_numpy() for f in fields] or [flat.to_numpy()]
    return np.concatenate([[0], np.cumsum(sizes)]), *values


def _window_entries(window: int):
    def entries(batch, ids, powers):
        _, high, low, _, _, starts = _tokens(binary_values(batch.column("text")), ids)
        bounds, at, n, status = _lists(batch.column("spans"), "at", "n", "status")
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        wait = status != REPEATED
        if not wait.any():
            return np.zeros(0, ENTRY)
        at, n, row, shown = at[wait].astype(np.int64), n[wait], row[wait], status[wait] == SHOWN
        # every window of the spans
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, row, shown = np.repeat(at, n) + step, np.repeat(row, n), np.repeat(shown, n)
        begin = starts[row] + at
        one, two = (digests(h, powers)(begin, begin + window) for h in (high, low))
        return _entries(k1=one, k2=two, row=row, at=at, n=1, f=np.where(shown, NOWHERE, 0))

    return entries


def _cover(words: list[bytes], at: np.ndarray, n: np.ndarray, window: int) -> tuple[int, bytes]:
    """(words removed, kept words joined by a blank) for spans of n windows from ``at`` on."""
    if not len(at):
        return 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n + window - 1, -1)
    keep = np.cumsum(change[:-1]) == 0
    return len(words) - int(keep.sum()), b" ".join(compress(words, keep.tolist()))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, digest: bool = False
) -> DataFrame:
    """One row per input row: id, n_words, n_removed and the kept words joined by one blank.

    With ``digest`` the last column is kept_sha256, the SHA-256 of the kept text.
    A null text has no words; repeated rows are repeats of each other; a null or
    repeated id changes nothing, as rows are told apart by their place in the
    stored table; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    last = "kept_sha256" if digest else "kept_text"
    rows = located(scanned(docs)).select(
        F.xxhash64(FILE).alias("file"), F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )

    # a bucket is one task's work: their number follows the texts
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))

    def out(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")

    found = _exchange(rows.select("file", "row", "text"), _span_entries(window, rounds), name_entries, name_results, buckets)
    found = found.groupBy("file", "row").agg(F.collect_list(F.struct("at", "n", "status")).alias("spans"))
    joined = rows.join(found, ["file", "row"], "left").select("id", "text", "spans")

    def settle(batches):
        """Texts whose spans are all settled are done; those with windows to compare or to show keep their text."""
        for b in slices(batches, "text"):
            n, removed, kept, left = [], [], [], []
            bounds, at, size, status = _lists(b.column("spans"), "at", "n", "status")
            waits, shows = (
                (np.diff(np.concatenate([[0], np.cumsum(some)])[bounds]) > 0).tolist() for some in (status == COMPARE, status != REPEATED)
            )
            for i, (text, wait, show) in enumerate(zip(binary_values(b.column("text")), waits, shows, strict=True)):
                words = text.split()
                mine = slice(bounds[i], bounds[i + 1])
                cut, rest = (0, b"") if wait else _cover(words, at[mine], size[mine], window)
                n.append(len(words))
                removed.append(cut)
                kept.append(None if wait else out(rest))
                left.append(text if show else None)
            spans_left = pa.compute.if_else(pa.array(shows, pa.bool_()), b.column("spans"), pa.scalar(None, b.schema.field("spans").type))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(left, pa.binary()), spans_left],
                names=["id", "n_words", "n_removed", last, "text", "spans"],
            )

    kinds = f"id long, n_words long, n_removed long, {last} string, text binary, spans array<struct<at:int,n:int,status:int>>"
    first = stored(joined.mapInArrow(settle, kinds))
    waiting = located(first.where("text is not null"))
    waiting = waiting.select(F.xxhash64(FILE).alias("file"), F.col(ROW).alias("row"), "id", "text", "spans", last)
    windows = _exchange(waiting.select("file", "row", "text", "spans"), _window_entries(window), window_entries, window_results, buckets)
    windows = windows.groupBy("file", "row").agg(F.collect_list("at").alias("windows"))

    def finish(batches):
        for b in slices(batches, "text"):
            n, removed, kept = [], [], []
            bounds, at, size, status = _lists(b.column("spans"), "at", "n", "status")
            more, single = _lists(b.column("windows"))
            for i, text in enumerate(binary_values(b.column("text"))):
                words = text.split()
                mine = slice(bounds[i], bounds[i + 1])
                sure, found = status[mine] != COMPARE, single[more[i] : more[i + 1]]
                starts = np.concatenate([at[mine][sure], found])
                cut, rest = _cover(words, starts, np.concatenate([size[mine][sure], np.ones(len(found), np.int64)]), window)
                n.append(len(words))
                removed.append(cut)
                kept.append(out(rest))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", last])

    schema = f"id long, n_words long, n_removed long, {last} string"
    rest = waiting.where(F.col(last).isNull()).join(windows, ["file", "row"], "left").select("id", "text", "spans", "windows").mapInArrow(finish, schema)
    return first.where(F.col(last).isNotNull()).select("id", "n_words", "n_removed", last).unionByName(rest)
