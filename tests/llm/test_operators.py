"""The training-data operators against brute-force versions, on small frames with the awkward cases."""

import collections
import hashlib
import json
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from adperf.llm import chat, exact_dedup, host_quality, neardup, packing, pii, piece, substring, token_store, toxicity

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, __file string, n_words long"


def frame(spark, texts, ids=None):
    """Texts with columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), None, "x", 7) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    voc = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(voc) for _ in range(90)]
    out = [None, "", "  \n", "one", "one", "ONE", "a b", "x " * 200, "ÉTÉ z", "long" * 5000]
    for _ in range(60):
        w = [rnd.choice(voc) for _ in range(rnd.randint(1, 90))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, 50)
            w[len(w) // 2 : len(w) // 2] = passage[at : at + rnd.randint(10, 80)]
        out.append(" ".join(w) + ("\nline one\nline one" if rnd.random() < 0.3 else ""))
    base = [rnd.choice(voc) for _ in range(120)]
    for _ in range(40):
        w = list(base)
        for _ in range(rnd.choice((2, 6, 12))):
            w[rnd.randrange(len(w))] = rnd.choice(voc)
        out.append(" ".join(w))
    return out + out[40:50]


def number(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else int(v)


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda b: hashlib.sha256(b).hexdigest()[:1]])
def test_exact_dedup(spark, texts, digest):
    rows = exact_dedup.exact_dedup(frame(spark, texts), digest=digest, files_per_batch=1).toPandas()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    assert len(rows) == len(texts)
    for r in rows.itertuples():
        g = groups[lower(texts[r.id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.id == max(g))


def test_exact_dedup_repeated_rows(spark):
    docs = frame(spark, ["a", "a", "A", "b"], [1, 1, None, None])
    rows = exact_dedup.exact_dedup(docs).toPandas()
    assert rows.kept.sum() == 2 and sorted(rows.group_size) == [1, 3, 3, 3]
    assert exact_dedup.drop_exact_copies(docs).count() == 2


def test_sentencepiece(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("  \n\t\r;)}abcé中▁́\U0001f60001<s>\x00") for _ in range(rnd.randint(1, 400))) for _ in range(80)]
    all_ = texts + odd + [" " * 700, "ab" * 900, "<s> </s> <unk> <0x41>"]
    rows = piece.encode_texts(frame(spark, all_), path).collect()
    for r in rows:
        want = library.encode(all_[r.id] or "", add_bos=True, add_eos=True)
        assert list(r.ids) == want and r.decoded == library.decode(want)


def test_pii(spark):
    texts = [None, "", "mail a.b@c.org, x@@y, q@no", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111111111111112",
             "+1 (555) 123-45678 +12", "IBAN GB82 WEST 1234 5698 7654 32 paid", "ssn 123-45-6789", "code 123-45-6789", "GB82 WEST 1234 5698 7654 33"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("a@.-+ 0123456789()x") for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    rows = {r.id: r.spans for r in pii.detect_pii(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}
                want += [(kind, *m.span())] * good[kind]
        assert [(s.kind, s.start, s.end) for s in rows[i] if s.kind in patterns] == sorted(want, key=lambda s: (s[1], list(patterns).index(s[0])))
    assert [s.kind for s in rows[6]] == ["iban"] and [s.kind for s in rows[7]] == ["ssn"] and not rows[8] and not rows[9]
    masked = {r.doc_id: r for r in pii.mask_pii(frame(spark, texts)).collect()}
    assert masked[2].text.startswith("mail [EMAIL],") and masked[2].n_chars == len(masked[2].text) and masked[0].text is None


@pytest.mark.parametrize(
    "text",
    [f"{iban}{rest}" for iban in ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "NO93 8601 1117 947")
     for rest in ("", " paid", " Paid", " Thanks 12 X", " DUE ON FRIDAY MORNING", " 7 8 9x", " 123456789012345678901234567890", ", PAID", "\nPAID")],
)
@pytest.mark.parametrize("before", ["", "iban ", "AB12 CODES AND MORE ", "AB12 CDEFGHIJKLM "])
def test_iban_beside_words(before, text):
    """The longest prefix ending with a word that checks, found by trying them all."""
    whole = before + text
    a = len(before)
    ends = [e for e in range(a + 15, len(whole) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", whole[a:e])]
    b = max(e for e in ends if not re.match("[A-Za-z0-9]", whole[e:]) and pii.mod97(whole[a:e]))
    assert [x[:3] for x in pii.find(whole) if x[0] == "iban"] == [("iban", a, b)]
    assert "[IBAN]" in pii.masked(whole, pii.find(whole))


def test_iban_not_in_longer_words():
    for text in ("GB82WEST12345698765432Thanks", "xGB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33 Paid", "GB82 WEST 12"):
        assert not [x for x in pii.find(text) if x[0] == "iban"], text


def test_host_quality(spark, texts):
    rows = {r.id: r for r in host_quality.host_quality(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(WORD, t or "")
        seen = collections.defaultdict(list)
        for p in range(len(w) - 7):
            seen[tuple(w[p : p + 8])].append(p)
        again = len({q for v in seen.values() if len(v) > 1 for p in v for q in range(p, p + 8)})
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), again)
        assert r.base_failed == (len(w) < 20 or 100 * again > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert host_quality.keep_good(frame(spark, texts)).count() == sum(r.kept for r in rows.values())


def test_a_bad_host_loses_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    data = [(i, good if i % 10 else "x", "ok") for i in range(100)] + [(200 + i, "x" if i % 10 else good, "bad") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = host_quality.host_quality(docs).collect()
    assert {r.id for r in rows if r.kept} == {i for i in range(100) if i % 10}


def test_host_prior_leaves_chance_out(spark):
    """Rates that differ as much as chance lets them say nothing about their hosts."""
    good = " ".join(f"w{i}" for i in range(30))
    ones = [(i, good if i % 4 else "x", f"h{i}") for i in range(40)]
    rows = host_quality.host_quality(spark.createDataFrame(ones, "doc_id long, text string, source string")).collect()
    assert all(math.isclose(r.host_rate, 0.25) and r.kept == (not r.base_failed) for r in rows)
    few = [(100 * h + i, good, f"clean{h}") for h in range(20) for i in range(5)] + [(5000, "x", "small"), (5001, "x", "small"), (5002, good, "small")]
    data = spark.createDataFrame(few, "doc_id long, text string, source string")
    assert {r.id for r in host_quality.host_quality(data).collect() if r.kept} >= {i for i, t, _ in few if t == good and i < 5000}


def test_account_numbers_have_their_countrys_length():
    rnd = random.Random(0)
    codes = ["ZZ12" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ") for _ in range(40)) for _ in range(500)]
    assert not any(list(pii.ibans(c)) for c in codes)
    assert list(pii.ibans("DE89 3704 0044 0532 0130 00 X")) == [(0, 27)] and not list(pii.ibans("DE89 3704 0044 0532 0130 0"))


def test_token_store_round_trip(spark, texts, tmpdir_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [*texts, "İ.", "can't., <|startoftext|>x", "ΑΣ, Ǎ"]
    docs = frame(spark, odd)
    manifest = token_store.write_tokens(docs, path, tmpdir_path + "/tokens", partitions=3)
    library, start = Tokenizer.from_file(path), 0
    rows = {r.id: r for r in token_store.read_tokens(manifest).collect()}
    for i, t in enumerate(odd):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert list(rows[i].ids) == want and rows[i].start == start and rows[i].n_tokens == len(want)
        start += len(want)
    crc = {r.id: r.ids_crc32 for r in token_store.read_tokens(manifest, digest=True).collect()}
    assert crc[7] == zlib.crc32(np.array(rows[7].ids, "<u4").tobytes())
    some = token_store.read_documents(manifest, docs.where("doc_id in (3, 60)")).collect()
    assert {r.id: list(r.ids) for r in some} == {i: list(rows[i].ids) for i in (3, 60)}
    name = manifest.first().path
    with open(name.removeprefix("file:"), "r+b") as f:
        f.write(b"\xff\xff")
    with pytest.raises(ValueError, match="damaged"):
        token_store.Reader(name).ids(0)


@pytest.mark.parametrize("width,most", [(1, 255), (2, 65_535), (4, 2**32 - 1)])
def test_token_ids_fit_their_width(tmpdir_path, width, most):
    writer = token_store.Writer(f"{tmpdir_path}/w{width}/a.tokz", width)
    writer.add(1, np.array([0, most], np.uint64))
    with pytest.raises(ValueError, match="does not fit"):
        writer.add(2, np.array([0, most + 1], np.uint64))
    writer.close()
    assert list(token_store.Reader(writer.path).ids(0)) == [0, most]


def test_packing(spark, texts):
    rows = packing.pack(frame(spark, texts), lengths=(16, 32, 64), overhead=4, block=40).toPandas()
    want = {i: len(re.findall(WORD, t or "")) + 1 for i, t in enumerate(texts)}
    assert rows.groupby("id").length.sum().to_dict() == want
    for _, b in rows.sort_values("offset").groupby("bin"):
        assert list(b.offset) == [0, *np.cumsum(b.length)[:-1]]
        used, size = b.length.sum(), b.bin_length.iloc[0]
        assert used <= size and size == min(c for c in (16, 32, 64) if c >= used)


def packed_plainly(sizes, lengths, overhead):
    """The same rule by trying everything: (piece sizes, final length) of each bin; of equal rooms the bin last changed."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        n = left.pop(0)
        fit = [b for b in bins if b[1] - sum(b[0]) >= n]
        if fit:
            least = min(b[1] - sum(b[0]) for b in fit)
            chosen = [b for b in fit if b[1] - sum(b[0]) == least][-1]
            chosen[0].append(n)
            bins.append(bins.pop(next(k for k, b in enumerate(bins) if b is chosen)))
            continue
        costs = []
        for c in lengths:
            if c >= n:
                total = n
                for other in left:  # the largest first
                    total += other if total + other <= c else 0
                costs.append((Fraction(min(x for x in lengths if x >= total) + overhead, total), c))
        bins.append(([n], min(costs)[1]))
    return sorted((sorted(b), min(x for x in lengths if x >= sum(b))) for b, _ in bins)


def test_packing_equals_the_plain_rule():
    rnd = random.Random(11)
    for _ in range(60):
        lengths = tuple(sorted(rnd.sample(range(8, 80), 3)))
        sizes = [rnd.randint(1, lengths[-1]) for _ in range(rnd.randint(1, 60))]
        bins, offset, final = packing.pack_block(np.array(sizes), lengths, 4)
        got = collections.defaultdict(list)
        for n, b, f in zip(sizes, bins, final, strict=True):
            got[b, f].append(n)
        assert sorted((sorted(v), f) for (_, f), v in got.items()) == packed_plainly(sizes, lengths, 4)


def test_packing_uses_all_lengths_to_advantage():
    """Several lengths together cost less than the best of them alone."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 3000, 20_000)

    def cost(lengths):
        bins, _, final = packing.pack_block(sizes, lengths, packing.OVERHEAD)
        first = np.unique(bins, return_index=True)[1]
        return int((final[first] + packing.OVERHEAD).sum())

    joint = cost(packing.LENGTHS)
    alone = min(cost((c,)) for c in packing.LENGTHS if c >= 3000)
    assert joint < alone


def test_best_fit_packs_tokens(spark):
    """The lengths of op7 are those of the tokenizer library, the end token included."""
    from tokenizers import Tokenizer

    from adperf.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs}
    rows = QUERIES["op7_best_fit"](spark, "/root/testdata/sf0.001").toPandas()
    assert rows.groupby("doc_id").length.sum().to_dict() == want
    bins = rows.groupby("bin").agg({"length": "sum", "bin_length": "max"})
    assert (bins.length <= bins.bin_length).all()


@pytest.mark.parametrize("k,part", [(2, 400_000), (2, 500), (5, 400_000)])
def test_near_duplicates(spark, texts, k, part, monkeypatch):
    monkeypatch.setattr(neardup, "PART", part)
    rows = neardup.near_duplicates(frame(spark, texts), shingle=k).toPandas()
    sets = []
    for t in texts:
        w = re.findall(WORD, lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    for r in rows.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.id]), label[r.id], label[r.id] == r.id)
    assert neardup.drop_near_copies(frame(spark, texts), shingle=k).count() == len(set(label))


def test_near_duplicates_odd_ids(spark):
    a, b = " ".join(f"u{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = neardup.near_duplicates(frame(spark, [a, a, b, b, None], [None, 3, 3, None, None])).collect()
    assert [number(r.component_id) for r in sorted(rows, key=lambda r: (r.n_shingles, r.id is None, r.id or 0))] == [None, 3, 3, 3, 3]


def test_drop_near_copies_odd_ids(spark):
    """One row of each component stays, whatever ids the components share or lack."""
    def text(c, changed=None):
        return " ".join(f"{c}{i}" for i in range(60)) + (f" {changed}" if changed else "")

    rows = [(5, text("a")), (5, text("b")), (5, text("b", "x")), (7, text("a", "y")), (None, text("a", "z")), (5, text("c")),
            (None, text("d")), (None, text("d", "x")), (None, text("d")), (None, text("e")), (None, ""), (5, None), (5, " ")]
    kept = neardup.drop_near_copies(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    found = sorted((r.text or " ").split(" ")[0][:1] + str(r.doc_id) for r in kept)
    assert found == ["5", "5", "None", "a5", "b5", "c5", "dNone", "eNone"]


@pytest.mark.parametrize("percent", [1, 50, 80, 100])
def test_linked_sets(percent):
    """The forest joins what all pairs of the two sides join, and each of its links holds."""
    rng = np.random.default_rng(percent)
    base = [rng.choice(1 << 40, 60, replace=False) for _ in range(3)]
    sets = []
    for i in range(90):
        have = rng.choice(base[i % 3], rng.integers(1, 60), replace=False) if i % 5 else base[i % 3][:55]
        sets.append(np.unique(np.concatenate([have, rng.integers(0, 1 << 40, rng.integers(0, 9))]).astype(np.uint64)))
    one, two, label = np.arange(90) < 60, np.arange(90) >= 40, np.where(np.arange(90) % 7 == 0, 0, np.arange(90))

    def joined(pairs):
        of = label.copy()
        for a, b in pairs:
            of[of == of[a]] = of[b]
        return len(set(of.tolist())), {frozenset(np.flatnonzero(of == x).tolist()) for x in of}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    found = list(zip(*neardup.linked_sets(sets, one, two, label, percent), strict=True))
    assert all(one[a] and two[b] and linked(a, b) for a, b in found)
    want = joined([(a, b) for a in np.flatnonzero(one) for b in np.flatnonzero(two) if linked(a, b)])
    assert joined(found) == want and len(found) == joined([])[0] - want[0]


@pytest.mark.parametrize("part", [400_000, 3_000])
def test_pages_of_one_template(spark, part, monkeypatch):
    """Pages about 0.6 alike share buckets but no link; the copies among them are found."""
    monkeypatch.setattr(neardup, "PART", part)
    rng = np.random.default_rng(1)
    page = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(300):
        own = rng.integers(0, 78)
        texts.append(" ".join(page[:own] + [f"p{i}x{j}" for j in range(22)] + page[own + 22 :]))
    texts += [t + " end" for t in texts[::10]]
    rows = neardup.near_duplicates(frame(spark, texts), shingle=2).collect()
    assert {r.id: r.component_id for r in rows} == {i: i if i < 300 else 10 * (i - 300) for i in range(330)}


@pytest.mark.parametrize("window,chunk,many,size", [(35, 600_000, 16, 64 << 20), (35, 60, 1, 500), (6, 60, 2, 64 << 20)])
def test_remove_repeats(spark, texts, window, chunk, many, size, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET", size)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "MANY", many)
    words = [re.findall(WORD, t or "") for t in texts]
    count = collections.Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    rows = substring.remove_repeats(frame(spark, texts), window=window).collect()
    for r in rows:
        w = words[r.id]
        gone = {q for p in range(len(w) - window + 1) if count[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_toxicity(spark):
    rnd = random.Random(2)
    voc, bad = [f"w{i}" for i in range(200)], ["awful1", "awful2", "awful3", "awful4"]
    data = []
    for i in range(900):
        w = [rnd.choice(voc) for _ in range(rnd.randint(5, 60))]
        n = rnd.choice((1, 3)) if i % 4 == 0 else 0
        w += rnd.sample(bad, n)
        data.append((i, " ".join(w), int(n > 0), n))
    docs = spark.createDataFrame([d[:2] for d in data] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data[:600]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = {r.id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = data[600:]
    assert np.mean([rows[d[0]].toxic == bool(d[2]) for d in held]) > 0.95
    mean = {n: np.mean([rows[d[0]].expected_severity for d in held if d[3] == n]) for n in (0, 1, 3)}
    assert mean[0] < mean[1] < mean[3] and not rows[5000].toxic and not rows[5001].toxic


def test_toxicity_sample(spark, monkeypatch):
    """Labels without a text take no place of the sample, and repeated rows take one."""
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(30)] + [(7, f"x{i}") for i in range(50)] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(8, 0)] * 9, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda grade, rows: seen.append(len(rows)))
    for most in (40, 20):
        toxicity.train(docs, labels, most=most)
    assert seen == [30, 20]


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "f", '{"y": 1.0, "x": [1e-7, 0.5]}', None), (1, "b", "f", '{"x": "no"}', ["a", "zz"]), (1, "c", "g", "{}", ["b", "a"]),
         (1, "d", "f", "oops", ["e"]), (1, "e", "f", '{"x":[],"x":[]}', ["d"]), (2, None, "f", None, ["a"]), (1, "a", "f", '{"x":[]}', None)],
        "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("a", "two"), ("a", "one"), (None, "z")], "call_id string, content string")
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "array", "items": {"type": "number"}}}}}
    rows = chat.link_tool_calls(calls, results, schemas).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.call_id].append(r)
    assert len(rows) == 7 and {k: v[0].level for k, v in by.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, None: 0}
    assert by["b"][0].n_missing == 1 and by["b"][0].errors == "$.x: not of type array" and by["c"][0].errors == "unknown tool"
    assert by["d"][0].errors == by["e"][0].errors == "arguments are not JSON" and by["a"][0].n_results == 2
    assert '{"arguments":{"x":[1e-7,0.5],"y":1},"call_id":"a","name":"f","result":"one"}' in {r.message for r in by["a"]}
    assert all(json.loads(r.message) for r in rows)


def test_levels_of_long_chains_forks_and_cycles(spark):
    """Levels against a plain longest path; a chain of 1,000 calls takes about as many joins as one of 1,000 has bits."""
    rnd = random.Random(3)
    parents = {f"n{k}": [f"n{k - 1}"] if k else [] for k in range(1000)}
    parents |= {f"m{k}": [f"m{j}" for j in {rnd.randrange(k) for _ in range(rnd.choice((1, 1, 1, 3)))}] if k else ["unknown"] for k in range(80)}
    parents |= {f"c{k}": [f"c{(k + 1) % 5}"] for k in range(5)} | {"behind": ["c0"], "beside": ["c1", "n7"], "after": ["beside"], "self": ["self"], "joined": ["n999", "m5", "zz"]}
    calls = spark.createDataFrame([(k, v + v[:1]) for k, v in parents.items()] + [(None, ["n1"]), ("n5", ["n4"])], "call_id string, depends_on array<string>")
    level = {}

    def depth(k, on=()):
        if k in on:
            return None
        if k not in level:
            of = [depth(p, (*on, k)) for p in parents[k] if p in parents]
            level[k] = None if None in of else 1 + max(of, default=-1)
        return level[k]

    import sys

    sys.setrecursionlimit(10_000)
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {k: depth(k) for k in parents}


def test_tool_calls_odd_arguments(spark):
    texts = ['{"x": "\\ud800"}', '{"x": true}', '{"x": 1}', '{"x": 1000000000000000000000}', '{"x": 1e21}', '{"\\udfff": 1}']
    calls = spark.createDataFrame([(1, f"c{k}", "f", t, None) for k, t in enumerate(texts)], "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "call_id string, content string")
    rows = {r.call_id: r for r in chat.link_tool_calls(calls, results, {"f": {"properties": {"x": {"enum": [1, 10**21]}}}}).collect()}
    assert [rows[f"c{k}"].valid for k in range(6)] == [False, False, True, True, True, False]
    assert rows["c0"].errors == rows["c5"].errors == "arguments hold half a character pair" and rows["c1"].errors == "$.x: not a listed value"
    assert rows["c3"].message.replace("c3", "") == rows["c4"].message.replace("c4", "") and "1e+21" in rows["c3"].message
    for schema in ({"pattern": "x"}, {"properties": {"a": {"anyOf": []}}}, {"items": {"const": 1}}, {"type": "thing"}, {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            chat.link_tool_calls(calls, results, {"f": schema})


def test_empty_tables(spark):
    docs = frame(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (
        exact_dedup.exact_dedup(docs), exact_dedup.drop_exact_copies(docs), piece.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model")),
        pii.detect_pii(docs), pii.mask_pii(docs), host_quality.host_quality(docs), host_quality.keep_good(docs), packing.pack(docs),
        token_store.read_tokens(token_store.write_tokens(docs, path, token_store.new_folder(spark))), neardup.near_duplicates(docs),
        neardup.drop_near_copies(docs), substring.remove_repeats(docs),
        toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))),
    ):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    quality = {r.id for r in host_quality.host_quality(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect() if r.kept}
    last = {}
    for i in sorted(quality):
        last[lower(docs[i])] = i
    sets = {}
    for t, i in last.items():
        w = re.findall(WORD, t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(pii.masked(docs[i], pii.find(docs[i])), add_special_tokens=False).ids) + 1 for i in set(label.values())}
    assert rows.groupby("doc_id").length.sum().to_dict() == want


def test_joined_words_have_the_library_ids():
    """Runs of letters and marks encoded many at a time, on letters that change when lower-cased or composed."""
    from adperf.llm.token_store import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = "abZ'.,-_<|>!3 İßéſﬁ̇Ǆ漢٣²ªⅣ𝒜ͅẞ\x1c\x85​"
    rng = np.random.default_rng(5)
    texts = ["".join(odd[k] for k in rng.integers(0, len(odd), n)) for n in rng.integers(0, 30, 4000)]
    texts += ["", " ", "don't it's.' can't,", "a<|endoftext|>b <|endoftext|>", "x" * 5000 + "..."]
    ours, library = Tokenizer(path), Tokenizer(path).library
    got = ours.encode([t.encode() for t in texts], 1)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_pipeline_leaves_no_words_in_workers(spark, monkeypatch):
    """After a task of the packing stage its Python worker holds no words; the lengths are the library's each time."""
    import sys

    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["Some words, some more.", None, "", "words Words wörds " + "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: tasks.append(run) or self)
    monkeypatch.setattr(packing, "pack", lambda lengths, **_: lengths)
    corpus_pipeline.packed(spark, docs, "")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    for _ in range(2):
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(4), pa.int64()), "text": pa.array(texts, pa.string())})
        out = [x for b in tasks[0](iter([batch])) for x in b.column("n_tokens").to_pylist()]
        assert out == want
        assert not sys.modules["_kept_by_worker"].tokenizer.ids
        assert not sys.modules["_kept_by_worker"].tokenizer.number
