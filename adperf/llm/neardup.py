"""Near-duplicates by one-permutation MinHash with optimal densification.

1. Every document's word shingles are hashed once; the hash both chooses one of
   ``BANDS * ROWS`` bins and competes for its minimum.  An empty bin borrows from
   the bin that a fixed random sequence of bins reaches first (optimal
   densification).  ``ROWS`` bins make the key of one band.
2. Documents with equal shingle sets become one unit, so exact copies cost
   one row each and no pair.
3. Units that share a band key are a bucket.  Its smallest unit is the centre of a
   star: candidate edges go from members to the centre, so a bucket of n units
   has n - 1 edges, not n squared.
4. Candidates are confirmed on the full shingle sets, and confirmed links are joined
   into components: first one centre for each unit, then the other centres of
   the units that are not in their component yet.
5. Buckets whose members are still in several components are searched whole.  The
   bucket's most common component is a family, and the bucket's other members are
   its strangers; the strangers are compared with the family and with each other, in
   blocks of bounded size that hold the sets.  So every pair that shares a bucket
   is compared unless its members are in one component already; there is no cap,
   and no row per pair.

At a similarity of 0.8 the chance that two units share no band is (1 - 0.8^5)^48,
about 5e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import FILE, ROW, WordIds, binary_values, frugal, located, scanned, slices, stored, without

BANDS, ROWS = 48, 5
SIMILARITY = 80  # percent
SHINGLE = 5
#: Shingles of a part in the search of whole buckets; bounds a task's memory.
PART = 400_000
#: Units without any document id take numbers from here up.
NO_ID = 1 << 62
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: WordIds, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased.

    A text of fewer than k words has its whole word sequence as one shingle, one
    without words none.
    """
    found = text.lower().split()  # bytes: A-Z, and ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    high, low = words.hashes(found, len(found))
    n = min(k, len(found))
    out = mix(high[: len(high) - n + 1] ^ low[: len(low) - n + 1])
    for i in range(1, n):
        out = mix(out ^ (high[i : len(high) - n + 1 + i] + low[i : len(low) - n + 1 + i] * np.uint64(2 * i + 1)))
    return np.unique(out)


_borrowed: dict[tuple[int, int], np.ndarray] = {}


def _borrow(bins: int, tries: int) -> np.ndarray:
    """For each bin the sequence of bins from which it borrows when empty; kept within a task."""
    if (bins, tries) not in _borrowed:
        _borrowed[bins, tries] = _borrow_table(bins, tries)
    return _borrowed[bins, tries]


def _borrow_table(bins: int, tries: int) -> np.ndarray:
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(at) % np.uint64(bins)).astype(np.int64)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of a non-empty sorted shingle set, as int64."""
    bins = bands * rows
    of = ((sketch >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    # sorted hashes are grouped by bin, the least of each bin first
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    least, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[of[first]] = sketch[first]
    filled[of[first]] = True
    empty = np.flatnonzero(~filled)
    for tries in (16, 2048):
        if len(empty):
            ask = _borrow(bins, tries)[empty]
            got = filled[ask]
            has = got.any(axis=1)
            least[empty[has]] = least[ask[has, got[has].argmax(axis=1)]]
            empty = empty[~has]
    if len(empty):  # beyond all tries: the first filled bin, the same for equal sets
        least[empty] = least[of[0]]
    key = mix(np.arange(bands, dtype=np.uint64))
    for r in range(rows):
        key = mix(key ^ least[r::rows])
    return key.view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, locator, n, digest, bands) of every row; digest is null for an empty set."""
    narrow = located(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), FILE, ROW)

    def run(batches):
        words = WordIds()
        for b in slices(batches, "text"):
            n, digest, keys = [], [], []
            for text in binary_values(b.column("text")):
                s = shingles(text, words, k)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(s, bands, rows) if len(s) else None)
                words.trim()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column(FILE), b.column(ROW), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", FILE, ROW, "n", "digest", "bands"],
            )

    return narrow.mapInArrow(frugal(run), f"id long, {FILE} string, {ROW} long, n long, digest binary, bands array<long>")


def units(rows: DataFrame) -> DataFrame:
    """(unit, id, locator, n, digest, bands), a row per distinct set: its smallest id and that row's locator.

    The unit's number is that id, or one from NO_ID up where the id is null or
    stands for several sets.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", FILE, ROW)).alias("f")
    unit = rows.where("digest is not null").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    unit = unit.select("digest", "f.id", f"f.{FILE}", f"f.{ROW}", "n", "bands")
    unit = stored(unit)
    shared = unit.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and id is not null").select("id", F.lit(True).alias("shared"))
    own = F.col("id").isNull() | F.coalesce("shared", F.lit(False))
    number = F.when(own, F.lit(NO_ID) + F.pmod(F.xxhash64("digest"), F.lit(NO_ID - 1))).otherwise(F.col("id"))
    return stored(unit.join(shared, "id", "left").withColumn("unit", number).drop("shared"))


def confirmed(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full shingle sets reach the similarity.

    ``texts`` has unit, text.  The sets are built where the two texts of an edge
    meet; a hot centre's edges may be split over tasks.
    """
    left = edges.join(texts.select(F.col("unit").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("unit").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        words = WordIds()
        for b in slices(batches, "ta"):
            sets = {}
            hits = []
            pairs = zip(binary_values(b.column("ta")), binary_values(b.column("tb")), strict=True)
            for ta, tb in pairs:
                for t in (ta, tb):
                    if t not in sets:
                        sets[t] = shingles(t, words, k)
                one, two = sets[ta], sets[tb]
                common = len(np.intersect1d(one, two, assume_unique=True))
                hits.append(100 * common >= percent * (len(one) + len(two) - common))
                words.trim()
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return both.mapInArrow(frugal(run), "a long, b long")


def linked_sets(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, label: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links between the non-empty sets of ``one`` and of ``two`` (masks) that join sets of unequal ``label``: a spanning forest.

    Linked sets share one of their rarest shingles: with the shingles of every
    set in one order, rare ones first, a set of n that needs at least c common
    ones shares one of its first n - c + 1.  Only sets that meet there, are of a
    possible size and are not joined yet are compared, on all their shingles.
    """
    size = np.array([len(s) for s in sets])
    _, shingle, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(seen), np.int64)
    place[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    of = np.repeat(np.arange(len(sets)), size)
    shingle = place[shingle]
    shingle = shingle[np.lexsort((shingle, of))]
    start = np.cumsum(size) - size
    need = np.maximum((percent * size + 99) // 100, 1)
    ahead = np.arange(len(shingle)) - start[of] <= (size - need)[of]
    posted = np.flatnonzero(ahead & two[of])
    posted = posted[np.argsort(shingle[posted], kind="stable")]
    postings, holder = shingle[posted], of[posted]
    joined = np.unique(label, return_inverse=True)[1]
    left, right = [], []
    for i in np.flatnonzero(one).tolist():
        mine = shingle[start[i] : start[i] + size[i]]
        asked = mine[: size[i] - need[i] + 1]
        met = holder[_ranges(np.searchsorted(postings, asked), np.searchsorted(postings, asked, "right"))]
        met = np.unique(met[joined[met] != joined[i]])
        met = met[percent * np.maximum(size[met], size[i]) <= 100 * np.minimum(size[met], size[i])]
        if not len(met):
            continue
        theirs = shingle[_ranges(start[met], start[met] + size[met])]
        both = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(both, np.cumsum(size[met]) - size[met], dtype=np.int64)
        for j in met[100 * common >= percent * (size[i] + size[met] - common)].tolist():
            if joined[i] != joined[j]:
                joined[joined == joined[j]] = joined[i]
                left.append(i)
                right.append(j)
    return left, right


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges begin..end, one range after the other."""
    n = end - begin
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def searched(members: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within the buckets (key, unit, label), a spanning forest of each block.

    Families and strangers are dealt into parts of about ``PART`` shingles; each
    pair of parts with a stranger part is a block, and a task's work.
    """
    kinds = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    family = kinds.groupBy("key").agg(F.max("c").alias("c"), F.max_by("label", F.col("c")).alias("family"), F.count(F.lit(1)).alias("kinds"))
    family = family.where("kinds > 1").select("key", "family")
    strangers = stored(members.join(family, "key").where("label <> family").select("family", "unit", "label").distinct())
    own = labels.join(strangers.select(F.col("family").alias("label")).distinct(), "label").select(F.col("label").alias("family"), "unit", "label")
    rows = strangers.withColumn("stranger", F.lit(True)).unionByName(own.withColumn("stranger", F.lit(False))).join(sizes, "unit")
    parts = rows.groupBy("family").agg(*[
        F.ceil(F.sum(F.when(F.col("stranger") == x, F.col("n")).otherwise(0)) / PART).cast("int").alias(c) for x, c in ((True, "xs"), (False, "ys"))
    ])
    count = F.when(F.col("stranger"), F.col("xs")).otherwise(F.col("ys"))
    rows = rows.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("unit"), count).cast("int"))
    # blocks are (x, y) with a stranger part x and a family part y, or stranger parts (x, -1 - y) with x <= y
    block = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    part, each = F.col("part"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.concat(F.transform(each("ys"), lambda y: block(part, y)), F.transform(each("xs"), lambda x: block(F.least(part, x), -1 - F.greatest(part, x))))
    theirs = F.transform(each("xs"), lambda x: block(x, part))
    rows = rows.withColumn("block", F.explode(F.when(F.col("stranger"), mine).otherwise(theirs)))
    rows = rows.select("family", "block.x", "block.y", "stranger", "part", "unit", "label").join(texts, "unit")

    def compare(table: pa.Table) -> pa.Table:
        words = WordIds()
        unit, part, stranger, label = (table.column(c).to_numpy() for c in ("unit", "part", "stranger", "label"))
        sets = [shingles(t, words, k) for t in binary_values(table.column("text"))]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        one = stranger & (part == x)
        two = ~stranger if y >= 0 else part == -1 - y
        a, b = linked_sets(sets, one, two, label, percent)
        return pa.table({"a": pa.array(unit[a], pa.int64()), "b": pa.array(unit[b], pa.int64())})

    return rows.groupBy("family", "x", "y").applyInArrow(compare, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, label): the least label that is reachable over ``links`` (a, b).

    Each round every label takes the least label next to it, and then the label
    of that label, so paths halve.  A round is written to the shared folder.
    Only labels that have links take part.
    """
    label_of = labels.select(F.col("unit").alias("__u"), F.col("label").alias("__l"))
    joined = links.join(label_of, F.col("a") == F.col("__u")).select(F.col("__l").alias("x"), "b")
    joined = joined.join(label_of, F.col("b") == F.col("__u")).select("x", F.col("__l").alias("y")).where("x <> y").distinct()
    edges = stored(joined)
    if edges.isEmpty():
        return labels
    both = edges.union(edges.select("y", "x"))
    at = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")))
    while True:
        near = both.join(at.select(F.col("x").alias("y"), F.col("to").alias("t")), "y").groupBy("x").agg(F.min("t").alias("t"))
        step = at.join(near, "x").select("x", F.least("to", "t").alias("s"), F.col("to").alias("old"))
        jump = at.select(F.col("x").alias("s"), F.col("to").alias("j"))
        new = stored(step.join(jump, "s").select("x", F.least("s", "j").alias("to"), (F.least("s", "j") != F.col("old")).alias("moved")))
        at = new.select("x", "to")
        if new.where("moved").isEmpty():
            break
    moves = at.select(F.col("x").alias("label"), "to")
    return labels.join(moves, "label", "left").select("unit", F.coalesce("to", "label").alias("label"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, locator, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links, the row's own id
    included.  A text without words (or null) has the empty set and is linked
    with nothing.  Rows that share an id are linked by their texts only.  A
    component without any id has a null component_id.  ``kept`` is true where
    the id is the component's, or both are null.  An empty table gives no rows;
    other columns are not read.
    """
    return _labelled(scanned(docs), id_col, text_col, shingle, percent, bands, rows).drop("label")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with their component's own label, null for the empty set.

    Components whose smallest ids are equal or null have different labels.
    ``docs`` is a plain scan.
    """
    found = stored(sketched(docs, id_col, text_col, shingle, bands, rows))
    unit = units(found)
    sizes = unit.select("unit", "n")

    members = unit.select("unit", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("unit").alias("centre"), F.max("unit").alias("last")).where("centre < last")
    members = stored(members.join(buckets.select("key", "centre"), "key"))
    stars = members.where("unit <> centre").select(F.col("centre").alias("a"), F.col("unit").alias("b")).distinct()
    edges = stored(_possible(stars, sizes, percent))
    centre = members.select("key", "unit", "centre")

    wanted = unit.join(centre.select("unit").distinct(), "unit").select("unit", FILE, ROW)
    source = located(docs).select(FILE, ROW, F.col(text_col).alias("text"))
    texts = stored(source.join(wanted, [FILE, ROW]).select("unit", "text"))

    labels = unit.select("unit", F.col("unit").alias("label"))
    nearest = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = stored(components(labels, stored(confirmed(nearest, texts, shingle, percent))))
    la, lb = (labels.select(F.col("unit").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    apart = edges.join(nearest, ["a", "b"], "left_anti").join(la, "a").join(lb, "b").where("la <> lb").select("a", "b")
    labels = stored(components(labels, stored(confirmed(stored(apart), texts, shingle, percent))))
    left = stored(centre.where("unit <> centre").join(labels, "unit").select("key", "unit", "label"))
    links = stored(searched(left, labels, sizes, texts, shingle, percent))
    labels = stored(components(labels, links))

    named = unit.select("digest", "unit", "id").join(labels, "unit")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    final = named.join(smallest, "label").select("digest", "component_id", "label")
    out = found.join(final, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select("id", FILE, ROW, F.col("n").alias("n_shingles"), component.alias("component_id"), "label")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _possible(edges: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The edges whose set sizes allow the similarity."""
    for x in "ab":
        edges = edges.join(sizes.select(F.col("unit").alias(x), F.col("n").alias(f"n{x}")), x)
    return edges.where(F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100).select("a", "b")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged.

    The row with the smallest id stays, of rows that share it the first by locator;
    rows without an id come after all others.  Components that share their
    smallest id are not mixed.  Rows without words all stay.
    """
    docs = scanned(docs)
    rows = stored(_labelled(docs, id_col, text_col, shingle, percent, BANDS, ROWS))
    place = F.struct(F.col("id").isNull().alias("x"), "id", FILE, ROW)
    first = rows.where("label is not null").groupBy("label").agg(F.min(place).alias("f"))
    keep = first.select(f"f.{FILE}", f"f.{ROW}").union(rows.where("label is null").select(FILE, ROW))
    gone = rows.select(FILE, ROW).join(keep, [FILE, ROW], "left_anti")
    return without(docs, stored(gone))
