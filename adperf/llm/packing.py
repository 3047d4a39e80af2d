"""Best-fit packing into bins of several permitted lengths.

Documents (longer ones in pieces of the largest length) are dealt at random into
blocks of about ``BLOCK`` pieces, and each block is packed by itself: longest
first, into the open bin with the least room that holds the piece.  Where no
bin does, a new bin is opened.  For each permitted length the contents that it would get are
foreseen from the sizes still to pack (the largest that fits, again and again); the length with the
least cost per token foreseen is opened, where a bin costs the smallest length that holds its
contents, plus ``overhead``.  So short lengths are opened where what is left would not fill a long
one.  At the end each bin takes the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import SPACE, stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64
#: Pieces packed together by one task; bounds its memory, whatever the input.
BLOCK = 50_000


def foreseen(piece: int, room: int, sizes: list[int], count: dict[int, int]) -> int:
    """Tokens of a bin that begins with ``piece`` and takes the largest size that fits until none does.

    ``sizes`` are the distinct sizes still to pack, ascending, and ``count`` their numbers.
    """
    total, k = piece, len(sizes)
    room -= piece
    while room > 0:
        k = bisect_right(sizes, room, 0, k) - 1
        if k < 0:
            break
        n = min(count[sizes[k]], room // sizes[k])
        total += n * sizes[k]
        room -= n * sizes[k]
    return total


def least_cost(piece: int, sizes: list[int], count: dict[int, int], lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length for a new bin that begins with ``piece``; of equal costs the smaller one."""
    best = None
    for c in lengths:
        if c >= piece:
            total = foreseen(piece, c, sizes, count)
            cost = lengths[bisect_left(lengths, total)] + overhead
            # least cost / total, in whole numbers
            if best is None or cost * best[1] < best[0] * total:
                best = (cost, total, c)
    return best[2]


def pack_block(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, final bin length) of each piece.

    Open bins are kept by their room, so a piece costs a binary search.
    """
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    at_room: dict[int, list[int]] = {}
    used: list[int] = []
    size_of: list[int] = []
    kinds, numbers = np.unique(sizes, return_counts=True)
    to_pack, count = kinds.tolist(), dict(zip(kinds.tolist(), numbers.tolist(), strict=True))

    def put(b: int) -> None:
        room = size_of[b] - used[b]
        if room > 0:
            if room not in at_room:
                rooms.insert(bisect_left(rooms, room), room)
                at_room[room] = []
            at_room[room].append(b)

    for i in order.tolist():
        n = int(sizes[i])
        count[n] -= 1
        if not count[n]:
            to_pack.pop()  # the largest, as the longest go first
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = at_room[room].pop()
            if not at_room[room]:
                del at_room[room], rooms[k]
        else:
            b = len(used)
            used.append(0)
            size_of.append(least_cost(n, to_pack, count, lengths, overhead))
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        put(b)
    final = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
    return bin_of, offset, final[bin_of] if len(used) else bin_of


def token_counts(text):
    """Words of a text plus an end token; a null text has the end token only."""
    words = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return (F.size(F.array_remove(words, "")) + 1).cast("long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
    lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, block: int = BLOCK,
) -> DataFrame:
    """(id, piece, begin, length, bin, offset, bin_length), one row per piece of a document.

    The length of a document is ``length_col`` (null or negative counts as 0) or,
    without one, its words plus an end token.  A document longer than the largest
    permitted length becomes pieces of that length and a rest; one of length 0
    has no piece.  No piece is cut otherwise or left out.  Bins are named by
    block and number; rows with equal ids are packed each for itself, and equal
    lengths in the order of id and place.  An empty table gives no rows.
    """
    lengths = tuple(sorted(set(lengths)))
    largest = lengths[-1]
    size = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)) if length_col else token_counts(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("n")).where("n > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long")))
    pieces = rows.withColumn("begin", starts).select(
        "id", (F.col("begin") / largest).cast("int").alias("piece"), "begin",
        F.least(F.col("n") - F.col("begin"), F.lit(largest)).alias("length"),
    )
    # Dealt by a stored row number, so that rows of one id spread over the blocks.
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, -(-pieces.count() // block))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offset, final = pack_block(table.column("length").to_numpy(), lengths, overhead)
        number = table.column("block").to_numpy()
        name = pa.array([f"{k}-{b}" for k, b in zip(number.tolist(), bins.tolist(), strict=True)], pa.string())
        out = table.select(["id", "piece", "begin", "length"])
        return out.append_column("bin", name).append_column("offset", pa.array(offset)).append_column("bin_length", pa.array(final))

    schema = "id long, piece int, begin long, length long, bin string, offset long, bin_length long"
    return pieces.groupBy("block").applyInArrow(one, schema)
