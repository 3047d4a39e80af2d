"""Token alignment, hard negatives and WARC bundles against brute-force versions, with the awkward cases."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from adperf.llm import align, exact_dedup, hard_negatives, host_quality, neardup, pii, warc
from adperf.llm.common import scanned
from adperf.llm.oracle import ORACLE
from tools.compare import compare

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ------------------------------------------------------------- alignment
def aligned_by_brute_force(text):
    """(ids A, ids B, groups, links) with every overlap tried."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a_lib = Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    byte_of = {c: n for n, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])])}
    byte_of |= {chr(256 + k): n for k, n in enumerate(n for n in range(256) if chr(n) not in byte_of)}
    raw_a = [bytes(byte_of[c] for c in a_lib.id_to_token(i)) for i in a]
    raw_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None

    def spans(raw):
        ends = np.cumsum([len(x) for x in raw]).tolist()
        return list(zip([0, *ends], ends))

    sa, sb = spans(raw_a), spans(raw_b)
    groups, lo = [], 0
    for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at) if lo <= s and e <= cut) for ids, at in ((a, sa), (b, sb))))
        lo = cut
    links = collections.Counter((i, j) for i, (s, e) in zip(a, sa) for j, (p, q) in zip(b, sb) if max(s, p) < min(e, q))
    return a, b, groups, links


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(4)
    odd = "ab c é中▁́\U0001f600 1<s>\x00\n\t\r   \x85\x1c'’s.,;:-_xyzé  .,,((\"9я"
    texts = [None, "", " ", "\n", "a", "a", "it's  a\n\n test \t x ", "▁a b", "<|endoftext|> <s>", "  \n ", "x" * 3000, "中文字符测试" * 20,
             "\U0001f600" * 50, "don't,''s x'.9,. a\r\n)b", "()\r {\r\n"]
    return texts + ["".join(rnd.choice(odd) for _ in range(rnd.randint(1, 60))) for _ in range(250)]


@pytest.mark.parametrize("part,remembered", [(4_000_000, 300_000), (50, 40)])
def test_alignment(spark, odd_texts, part, remembered, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    texts = odd_texts + odd_texts[:40]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1, "k") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, kinds string")
    docs = docs.repartition(3)
    want = [aligned_by_brute_force(t) for t in texts]
    count = collections.Counter(x for w in want if w for x in w[3])
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    expected = []
    for w in want:
        if w is None:
            expected.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = w
        best = sum(t for x, t in links.items() if count[x] == most[x[0]])
        expected.append((len(a), len(b), len(groups), sum(links.values()), best, sum(t * count[x] for x, t in links.items()), ";".join(groups)))
    rows = align.align_tokenizers(docs, A, B, part=part).collect()
    got = [tuple(r)[1:] for r in rows]
    assert sorted(got) == sorted(expected)
    assert {r.id: tuple(r)[1:] for r in rows if r.id is not None} == {k: expected[k] for k in range(len(texts)) if k % 9}
    digests = align.align_tokenizers(docs, A, B, digest=True, part=part).collect()
    assert sorted(r.groups for r in digests) == sorted(hashlib.sha256(e[6].encode()).hexdigest() if e[6] else "" for e in expected)


def test_shared_ends():
    rnd = random.Random(8)
    for _ in range(300):
        n = rnd.randint(1, 200)
        ends = [np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n})) for _ in range(2)]
        known = np.searchsorted(ends[0], sorted({n, *[x for x in ends[0].tolist() if x in ends[1] and rnd.random() < 0.1]}))
        assert align.shared_ends(*ends, known).tolist() == np.isin(*ends).tolist()


# --------------------------------------------------------- hard negatives
def mined_by_brute_force(rows, positives=5, negatives=10):
    """rows: (id, label, vector, is anchor) of the rows that take part."""
    out = []
    last = lambda i: (i is None, i or 0)
    q = [[math.floor(256 * x) for x in v] for _, _, v, _ in rows]
    for a, (i, label, _, anchor) in enumerate(rows):
        if not anchor:
            continue
        score = [sum(x * y for x, y in zip(q[a], v)) for v in q]
        order = sorted(range(len(rows)), key=lambda b: (-score[b], last(rows[b][0]), b))
        for p in [b for b in order if b != a and rows[b][1] == label][:positives]:
            fit = [b for b in order if rows[b][1] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:negatives]
            out += [(i, rows[p][0], r, rows[n][0], score[p], score[n]) for r, n in enumerate(fit, 1)]
    return out


def sortable(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("anchors,block,few", [(512, 8192, 0.1), (12, 200, 0.5)])
def test_hard_negatives(spark, anchors, block, few, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives.threshold_pairs, "__defaults__", (4, few))
    rng = np.random.default_rng(3)
    common = rng.normal(size=17) / 4
    data = []
    for i in range(300):
        v = (rng.normal(size=17) / 4).round(3).tolist() if i % 3 else common.round(3).tolist()
        if i % 11 == 0:
            v = v[: i % 13]  # shorter vectors end in zeros, some are empty
        if i % 17 == 0:
            v = [0.0] * 17
        data.append((i, int(rng.integers(0, 4)) if i % 19 else 3, v))
    data += [(None, 1, data[5][2]), (500, None, data[5][2]), (501, 1, None), (502, 1, [float("nan")] * 3), (503, 1, [0.1, None]),
             (504, 1, [float("inf")]), (600, 9, data[7][2]), (700, 2, [1.0] * 17)]
    docs = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, label int, embedding array<float>, row int, `a.b` string").coalesce(1)
    got = hard_negatives.hard_negatives(docs, F.col("vec_id") % 20 == 0, F.col("label")).collect()
    part = [(i, c, v + [0.0] * (17 - len(v)), i is not None and i % 20 == 0) for i, c, v in data
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [(i, c, [float(np.float32(x)) for x in v], a) for i, c, v, a in part]
    assert sortable(tuple(r) for r in got) == sortable(mined_by_brute_force(part))


def test_hard_negatives_repeated_ids(spark):
    data = [(1, 1, [1.0, 0.0])] * 3 + [(2, 0, [0.5, 0.5]), (2, 0, [0.5, 0.5]), (1, 0, [0.8, 0.0])]
    docs = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").coalesce(1)
    rows = hard_negatives.hard_negatives(docs, F.col("vec_id") == 1, F.col("label")).collect()
    part = [(*d, d[0] == 1) for d in data]
    assert sortable(tuple(r) for r in rows) == sortable(mined_by_brute_force(part)) and len(rows) == 3 * 2 * 3
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.hard_negatives(none, F.col("vec_id") == 1, F.col("label")).count() == 0


def test_threshold_pairs_keep_every_pair():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 2**25):
        for segment, few in ((1, 0.0), (5, 0.3), (64, 1.0)):
            q, x = (np.floor(rng.normal(size=(n, 23)) * scale * (rng.random((n, 23)) < 0.4)) for n in (20, 200))
            exact = q.astype(np.int64) @ x.astype(np.int64).T
            for share in (0.5, 0.9, 1.0):
                least = np.quantile(exact, share, axis=1).astype(np.int64)
                got = set(zip(*(z.tolist() for z in hard_negatives.threshold_pairs(q, x, least, segment, few))))
                assert got == {(i, j, int(exact[i, j])) for i, j in zip(*np.nonzero(exact >= least[:, None]))}


# ------------------------------------------------------------------- WARC
def page_frame(spark):
    rnd = random.Random(6)
    html = [None, "", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 70_000, *[f"<p>{rnd.randint(0, 20)}</p>" * rnd.randint(1, 30) for _ in range(150)]]
    rows = [(k, f"http://h/{k}?q=é b\r\n" if k % 3 else None, h, "z", 1) for k, h in enumerate(html)]
    rows += [(7, "u", html[7], "z", 1)] * 3 + [(None, None, html[8], "z", 1), (None, "v", "only", "z", 1), (None, "v", "only", "z", 1)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, __file string, record_type int").repartition(3)


@pytest.mark.parametrize("frame_bytes,bundle_bytes,least", [(2000, 500, 0), (1, 1, 30)])
def test_warc_round_trip(spark, frame_bytes, bundle_bytes, least):
    rows, pages = page_frame(spark)
    index = warc.write_archive(pages, warc.new_archive(spark), frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, least=least)
    got = warc.read_archive(index).collect()
    payload = [(h or "").encode() for _, _, h, _, _ in rows]
    largest = {}
    for (i, *_), p in zip(rows, payload):
        largest[p] = max(largest.get(p, (False, 0)), (i is not None, i or 0))
    want = collections.Counter()
    first = {p: rows[k][0] for p, k in ((p, max((k for k in range(len(rows)) if payload[k] == p), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))) for p in largest)}
    done = set()
    for (i, *_), p in zip(rows, payload):
        kind, to = "response", None
        if len(p) >= least and (i != first[p] or (p, i) in done):
            kind, to = "revisit", first[p]
        done.add((p, i))
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, to] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got}) == len(rows) and {r.url for r in got if r.page_id == 4} == {"http://h/4?q=é%20b%0D%0A"}
    names = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to_id in names for r in got if r.record_type == "revisit")
    wanted = spark.createDataFrame([(3,), (4,), (7,), (None,), (7,), (99999,)], "page_id long")
    some = collections.Counter((r.page_id, bytes(r.payload)) for r in warc.read_payloads(index, wanted).collect())
    assert some == collections.Counter((i, p) for (i, *_), p in zip(rows, payload) if i in (3, 4, 7, None))


def test_bundle_is_plain_zstandard_and_checked(tmpdir_path):
    import zstandard

    writer = warc.BundleWriter(f"{tmpdir_path}/b/x.warc.zst", 100)
    raw = [warc.record([("WARC-Type", "response"), ("Empty", None)], bytes([65 + k]) * 40) for k in range(9)]
    places = [writer.add(r) for r in raw]
    writer.close()
    with open(writer.path, "rb") as f:
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(1 << 20) for _ in range(1))
    assert whole == b"".join(raw)
    reader = warc.BundleReader(writer.path)
    assert [reader.frame(f)[o : o + len(r)] for (f, o), r in zip(places, raw)] == raw and len(reader.places) > 1
    with open(writer.path, "r+b") as f:
        f.seek(reader.places[1][0] + 12)
        f.write(b"\x00\xff\x00\xff")
    assert reader.frame(0)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.frame(1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert align.align_tokenizers(docs, A, B).count() == 0
    assert warc.read_archive(warc.write_archive(pages, warc.new_archive(spark))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    got = compare(spark, "/root/testdata/sf0.001", [name], verbose=True)
    assert got[name][0] == "OK", got[name]


# ------------------------------------------------ frames derived from files
@pytest.fixture()
def stored_docs(spark, tmpdir_path):
    path = f"{tmpdir_path}/docs"
    spark.createDataFrame([(k, f"text number {k % 2} " + " ".join(f"w{j}" for j in range(30)), k % 2) for k in range(4)], "doc_id long, text string, g int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("kind", ["scan", "filter", "explode", "join", "limit", "sample", "union"])
def test_derived_frames(spark, stored_docs, kind):
    """A locator must name a row, so frames whose rows share one are stored first."""
    frame = {
        "scan": lambda d: d, "filter": lambda d: d.where("doc_id >= 0").select("g", "text", "doc_id"),
        "explode": lambda d: d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
        "join": lambda d: d.join(spark.range(2).withColumnRenamed("id", "g"), "g"), "limit": lambda d: d.limit(3),
        "sample": lambda d: d.where(F.rand() >= 0), "union": lambda d: d.union(d),
    }[kind](stored_docs)
    plain = kind in ("scan", "filter")
    assert (scanned(frame) is frame) == plain
    if plain:
        return
    n = frame.count()
    rows = exact_dedup.exact_dedup(frame).collect()
    assert len(rows) == n and sum(r.kept for r in rows) == 2 == sum(r.kept for r in rows if r.group_size > 0)
    if kind != "explode":
        return
    assert exact_dedup.drop_exact_copies(frame).count() == 2
    # the texts differ in one word of 33
    assert neardup.drop_near_copies(frame, shingle=1).count() == 1
    index = warc.write_archive(frame, warc.new_archive(spark), id_col="doc_id", url_col="doc_id", payload_col="text")
    assert sorted(r.record_type for r in index.collect()) == ["response"] * 2 + ["revisit"] * (n - 2)


def test_columns_of_any_name_stay(spark, tmpdir_path):
    names = ["doc_id", "text", "source", "n_chars", "a.b", "__file", "__row", "__t", "__words", "__masked", "__bad", "__doc", "__h", "b`c"]
    text = "mail x@y.org " + " ".join(f"w{j}" for j in range(40))
    rows = [(k, text + ("" if k < 2 else f" z{k}"), "s", 3, *[f"{n}{k}" for n in names[4:]]) for k in range(4)]
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, ["long", "string", "string", "int"] + ["string"] * 10))
    made = spark.createDataFrame(rows, schema)
    made.write.parquet(f"{tmpdir_path}/clash")
    for docs in (spark.read.parquet(f"{tmpdir_path}/clash"),):
        for out, n in ((exact_dedup.drop_exact_copies(docs), 3), (neardup.drop_near_copies(docs, shingle=1), 1), (host_quality.keep_good(docs), 4), (pii.mask_pii(docs), 4)):
            assert out.columns == names
            found = out.collect()
            assert len(found) == n and all(r[4:] == rows[r[0]][4:] for r in found)
