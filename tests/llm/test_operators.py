"""Each operator against a brute-force version, on a table of odd cases and on the smallest test tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bitplanes, chat, minhash, mixing, packing, quality, sharding, simhash, suffixes, tokens, topk
from millrace.llm.common import table
from millrace.llm.components import connected_components
from millrace.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, mix_count int, copy string, atom string, carry_0 int, anchor int, score double"


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long, mid = sentence(1, 6000), sentence(2, 120)
    texts = [None, "", " ", "a", "A b c", "a b c", mid, mid, mid + " more", "x " + mid, long, long[:5000] + " changed " + long[5000:], "z" * 900, "é" * 300, "\n\t " + sentence(3, 40), "<|endoftext|> <|im_start|> ok", "q" * 199, "q" * 200, "zz top " * 60, None]
    rows = [(i, t, "en", "hot" if i % 3 else None, 1, "x", "y", 7, "c", "d", 1, 2, 0.5) for i, t in enumerate(texts)]
    rows += [(6, mid, "en", "hot", 1, "x", "y", 7, "c", "d", 1, 2, 0.5)] * 2  # repeated rows
    rows += [(None, mid, None, None, None, None, None, None, None, None, None, None, None), (None, "some text of no id", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "small"])
def docs(request, spark, odd, sf):
    return odd if request.param == "odd" else table(spark, sf, "documents")


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(default_path())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (50, [0.0, 1e5]), (100, []), (9, []), (150, [1e30, 1e30]), (0, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, dim int, salt int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect())
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        s = sorted((-min(max(sum(a * b for a, b in zip(q[1], v)), -(2**63)), 2**63 - 1), i) for i, v in ok if i != q[0] and len(v) == len(q[1]))[:3]
        want += [(q[0], n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_bounds_drop_candidates():
    rng = np.random.default_rng(0)
    c = np.floor(rng.standard_normal((4000, 64)) * np.geomspace(100, 1, 64))
    q, ids = c[0], np.arange(4000)
    rest = np.array([np.sqrt((c.T[lo:] ** 2).sum(0)) for lo in range(0, 64, 16)] + [np.zeros(4000)])
    found, score, seen = topk.search(q, 0, np.ascontiguousarray(c.T), rest, ids, 5, 16, -np.inf)
    want = sorted((-int(q @ c[i]), i) for i in range(1, 4000))[:5]
    assert list(zip((-score).astype(int), found)) == want
    assert seen[-1] < seen[0] / 10


def test_topk_group_carries_its_floor():
    rng = np.random.default_rng(1)
    ids, mat = rng.permutation(6000), np.floor(rng.standard_normal((6000, 64)) * 40)
    mat[100:1500], mat[3000:3400] = mat[0], -mat[1]  # many ties, and copies of one that no query likes
    kind, packed = topk._packed(mat)
    assert kind == "<i2"
    qs, owns = np.concatenate([mat[:40], mat[2000:2020]]), np.concatenate([ids[:40], ids[2000:2020]])
    pieces = [(kind, ids[lo : lo + 700].astype("<i8").tobytes(), mat[lo : lo + 700].astype("<i2").tobytes()) for lo in range(0, 6000, 700)]
    frame = pd.DataFrame([(64, False, *p) for p in pieces] + [(64, True, kind, owns[lo : lo + 7].astype("<i8").tobytes(), qs[lo : lo + 7].astype("<i2").tobytes()) for lo in range(0, 60, 7)], columns=["dim", "is_query", "kind", "ids", "mat"])
    got = pd.concat(topk._pairs(iter([frame]), 5, 16, 16, 512), ignore_index=True)
    assert len(got) == 5 * 60  # k rows a query, not k rows a query and block
    for q, own in zip(qs, owns):
        score = mat @ q
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != own)[:5]
        mine = got[got.query_id == own]
        assert sorted(zip(-mine.score, mine.vec_id)) == want


def test_topk_saturates_before_it_ranks():
    found, score = topk._exact(np.array([1e32]), 9, np.array([[1e31, 1e32, 1e33]]), np.array([1, 2, 3]), 2)
    assert list(found) == [1, 2] and score == [topk.LONG[1]] * 2


# 2


def test_planes(docs):
    files = bitplanes.write_files(docs, file_ids=20_000)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_files(files).collect())
    rows = plain(docs)
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(((i is not None, i or 0), len(x := ids_of(t)), crc(x)) for i, t in rows)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: (g[0], g[1])):
        assert start == at
        at += n


def test_planes_format(tmp_path, none, odd):
    ids = [np.array(x, "<u4").tobytes() for x in ([1], [70000, 2**32 - 1, 0], [], list(range(5000)))]
    keys, sizes, flat = bitplanes.unpack(bitplanes.pack([3, None, 5, -1], ids, chunk=1024))
    assert keys == [3, None, 5, -1] and sizes.tolist() == [1, 3, 0, 5000] and flat.astype("<u4").tobytes() == b"".join(ids)
    assert bitplanes.read_files(bitplanes.write_files(none)).count() == 0
    n = bitplanes.export(bitplanes.write_files(odd), str(tmp_path))
    assert n and sum(len(bitplanes.unpack(p.read_bytes())[0]) for p in tmp_path.iterdir()) == odd.count()


def test_encoder_equals_library():
    texts = ["Hello, WORLD's don't  it's...\n\n a b　c", "É́ İstanbul ΣΑΣ. äb é", "x<|endoftext|>y", "", " ", "tab\tsep\x1cfs\x85nel", "日本語 テスト 123 4a5"]
    got = encoder(default_path()).batch(texts, None)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


def test_encoder_equals_library_on_random_strings(monkeypatch):
    """Marks, letters in and out of the ranges that go straight to the model, odd spaces, few words kept, small chunks."""
    r = random.Random(1)
    parts = [*"aBzre't. \n,1éÉÀÞßÿ÷×ñŸΣİ\u0301日!?-;(\"<|#\t\r\x1c\u3000\x85\xa0\x00", "'s", "'re", "ÿ.", "Ñ!", "#$", "9.", "ﬁ", "ǅ", "<|endoftext|>", "x" * 9, "y" * 17, "é" * 9]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(20_000)] + [sentence(4, 9000), "q" * 9000]
    monkeypatch.setattr(tokens, "CHUNK", 5000)
    ours = tokens.Encoder(default_path(), words_kept=300)
    got = [x for lo in range(0, len(texts), 700) for x in ours.batch(texts[lo : lo + 700])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]
    assert ours.words.now.words < 3000


def test_encoder_of_another_file(tmp_path):
    """A file whose words can't be encoded one by one: whole texts go through the library."""
    import json

    said = json.loads(open(default_path(), encoding="utf-8").read())
    said["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(said), encoding="utf-8")
    ours = tokens.Encoder(str(tmp_path / "other.json"))
    texts = ["Hello THERE", "", "a. b"]
    assert [np.frombuffer(g, "<u4").tolist() for g in ours.batch(texts)] == [ours.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# 3


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & 2**64 - 1
    return x ^ x >> 31


def brute_prints(text):
    return brute_fingerprint(text, 5), brute_fingerprint(text, 5, mixed)


def in_radius(p, q):
    return any((x ^ y).bit_count() <= 11 for x, y in zip(p, q))


def brute_fingerprint(text, words, of=int):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    s = [" ".join(w)] if 0 < len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    h = [of(xxhash.xxh64_intdigest(x.encode(), 42)) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("words", "bits"), [(4, 4), (5, 8)])
def test_simhash(docs, words, bits):
    rows = [(i, brute_fingerprint(t, words)) for i, t in plain(docs)]
    comp = brute_components({f for _, f in rows}, bits)
    least = defaultdict(list)
    for i, f in rows:
        least[comp[f]] += [i] if i is not None else []
    want = sorted(((i is None, i or 0), f"{f:016x}", min(least[comp[f]], default=None)) for i, f in rows)
    got = simhash.near_groups(docs, words, bits).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in got) == want


def likeness(a, b, words=5):
    x, y = (simhash.shingle_set((t or "").encode(), words) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def test_like_groups(docs):
    """Links of all texts that are alike and within the bits, no other ones."""
    rows = plain(docs)
    fps = {t: brute_prints(t) for _, t in rows}
    texts = list(fps)
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if in_radius(fps[a], fps[b]) and likeness(a, b) >= 0.8:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, t in rows:
        least[find(t)] += [i] if i is not None else []
    want = sorted(((i is None, i or 0), f"{fps[t][0]:016x}", min(least[find(t)], default=-1)) for i, t in rows)
    got = simhash.like_groups(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_like_groups_of_many_copies(spark):
    r, base = random.Random(5), sentence(9, 400).split()
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = sentence(r.random(), 1)
        texts.append(" ".join(w))
    texts += [sentence(100 + i, 50) for i in range(40)]
    got = {x.doc_id: x.component_id for x in simhash.like_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] == 0 for i in range(61)) == 61 and all(got[i] == i for i in range(61, 101))


def like_components(rows):
    """component_id of each row, of links of all texts that are alike and within 11 bits by either fingerprint."""
    fps = {t: brute_prints(t) for _, t in rows}
    sets = {t: simhash.shingle_set((t or "").encode(), 5) for t in fps}
    of = {t: {t} for t in fps}
    for a in fps:
        for b in fps:
            if of[a] is not of[b] and in_radius(fps[a], fps[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                of[a] |= of[b]
                for x in of[b]:
                    of[x] = of[a]
    least = {id(s): min((i for i, t in rows if t in s and i is not None), default=None) for s in of.values()}
    return [(i, least[id(of[t])]) for i, t in rows]


def got_components(spark, rows):
    return sorted((r.doc_id, r.component_id) for r in simhash.like_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def with_edits(texts, seed, n=3):
    """The texts, and near copies of them with one edit of n words."""
    r, out = random.Random(seed), list(texts)
    for i, t in enumerate(texts):
        w = t.split()
        at = r.randrange(len(w) - n)
        w[at : at + n] = sentence(f"{seed} {i}", n).split()
        out.append(" ".join(w))
    return list(enumerate(out))


def test_like_groups_in_crowds(spark):
    """Unlike texts with much in common, within the bits of one another, and near copies of each."""
    shared = sentence(77, 144)
    rows = with_edits([shared + " " + sentence(1000 + i, 36) for i in range(100)], 5)
    want = like_components(rows)
    assert got_components(spark, rows) == sorted(want)


@pytest.mark.parametrize("times", [(40,), (40, 12)])
def test_like_groups_of_one_fingerprint(spark, times):
    """Unlike texts, and near copies of each, that one repeated line gives the same or near fingerprints."""
    line = sentence(5, 9) + "\n"
    rows = with_edits([sentence(2000 + i, 60) + "\n" + line * times[i % len(times)] for i in range(30)], 6)
    rows += [(100 + i, t) for i, t in rows[:3]]
    assert got_components(spark, rows) == sorted(like_components(rows))


def test_like_groups_find_what_is_alike(spark):
    """Against all pairs at a likeness of 0.8, whatever their bits: nine links of ten at least, and no other ones."""
    r, rows = random.Random(11), []
    for i in range(150):
        w = sentence(3000 + i, r.randint(60, 400)).split()
        rows.append((2 * i, " ".join(w)))
        for _ in range(max(1, int(len(w) * r.uniform(0.005, 0.024)))):  # each edit changes five shingles
            w[r.randrange(len(w))] = sentence(r.random(), 1)
        rows.append((2 * i + 1, " ".join(w)))
    alike = [likeness(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8 for i in range(150)]
    got = dict(got_components(spark, rows))
    found = [got[2 * i + 1] == 2 * i for i in range(150)]
    assert 60 < sum(alike) and sum(a and f for a, f in zip(alike, found)) >= 0.9 * sum(alike)
    assert all(a or not f for a, f in zip(alike, found)) and all(got[2 * i] == 2 * i for i in range(150))


@pytest.mark.parametrize("bits", [4, 8, 13])
def test_anchors_miss_no_link(bits):
    r = random.Random(0)
    fps = {r.getrandbits(64) for _ in range(30)}
    for _ in range(3):
        fps |= {f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, bits + 1))) for f in fps}
    import pandas as pd

    fp = np.array(sorted(fps), "u8").view("i8")
    sent = pd.concat(list(simhash._sent(iter([pd.DataFrame({"fp": fp})]), simhash.radii(bits), {0: 3, 5: 2}))).sort_values("key")
    links = pd.concat(list(simhash._compared(iter([sent]), bits)))
    graph = {f: {f} for f in fps}
    for a, b in zip(links["a"].to_numpy("i8").view("u8").tolist(), links["b"].to_numpy("i8").view("u8").tolist()):
        if graph[a] is not graph[b]:
            graph[a] |= graph[b]
            for x in graph[b]:
                graph[x] = graph[a]
    assert {f: min(graph[f]) for f in fps} == {f: min(x for x in fps if comp[x] == comp[f]) for comp in [brute_components(fps, bits)] for f in fps}


def test_no_documents(none):
    assert simhash.near_groups(none).count() == 0
    assert simhash.like_groups(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert minhash.compare_with_edits(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 230)}


# 4


def test_mix(spark, odd, sf):
    out = mixing.mix(odd).collect()
    copies = Counter((r.doc_id, r.text) for r in out)
    assert set(copies) <= set(plain(odd)) and [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    assert mixing.mix(odd).columns == [c for c in odd.columns if c != "copy"] + ["copy", "shuffle_key"]
    docs = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").when(F.col("doc_id") % 3 == 0, "b"))
    docs = docs.crossJoin(spark.range(20).select(F.col("id").alias("k"))).withColumn("doc_id", F.col("doc_id") * 20 + F.col("k")).drop("k")
    total = 10 * docs.count() * 2000.0
    rate = {r.source: r for r in mixing.rates(docs, {"a": 3, "b": 1}, total=total).collect()}
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    got = {r.source: r["count"] for r in mixing.mix(docs, {"a": 3, "b": 1}, total=total).groupBy("source").count().collect()}
    assert rate[None].rate == 0 and None not in got
    for s in "ab":
        assert abs(got[s] - n[s] * rate[s].rate) < 5 * math.sqrt(n[s] * rate[s].rate)
        lam = rate[s].rate / rate[s].parts
        assert np.allclose(rate[s].cdf[:5], np.cumsum([math.exp(-lam) * lam**i / math.factorial(i) for i in range(5)]))


# 5


def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats(docs):
    rows = plain(docs)
    want = sorted(((i is None, i or 0), *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 200)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()) == want


def test_repeats_among_edits(spark, monkeypatch):
    r = random.Random(4)
    base = sentence(9, 400)
    rows = []
    for i in range(60):
        lo = r.randrange(0, 1500)
        t = base[lo : lo + r.randint(100, 900)]
        at = r.randrange(len(t))
        rows.append((i, t[:at] + r.choice(["", "#", "ab", "\x00"]) + t[at:]))
    rows += [(100 + i, sentence(20 + i, 30) + " a common line of boilerplate text, long enough to hold a whole k-gram of bytes " + sentence(60 + i, 30)) for i in range(30)]
    rows += [(200, "ab" * 500), (201, "abc" * 90 + "x" + "abc" * 90), (202, "c" * 399 + "a" * 300)]
    monkeypatch.setattr(suffixes, "TEXT", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 200)))
    got = suffixes.remove_repeats(df, carry=("text",), with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    parts = [t.encode() for _, t in rows if len(t) >= 200]
    n = [len(p) - 199 for p in parts]
    assert (suffixes._crowd(parts, np.array(n), 200) == suffixes.repeated(parts, n, 200)).all()


def test_repeats_in_crowds(spark, monkeypatch):
    """Crowded k-grams: lines with other surroundings, copies of a document, equal strings in documents that differ."""
    alone = lambda i, n: "".join(random.Random(i).choice("abcdefghij klmnop") for _ in range(n))
    lines = {n: alone(7000 + n, n) for n in (70, 150, 199, 200, 201, 260)}
    rows = [(1000 * n + i, alone(i * 31 + n, 150) + line + alone(i * 37 + n, 160)) for n, line in lines.items() for i in range(40)]
    rows += [(i, alone(1, 900)) for i in range(80)] + [(900 + i, alone(1, 500) + alone(800 + i, 400)) for i in range(20)]
    rows += [(500, "z" * 1500), (501, "z" * 199), (502, None), (None, "zy" * 300), (503, alone(1, 900) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i is None, i or 0), *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 200)))
    deals, dealt = [], suffixes._dealt

    def watched(*a):
        deals.append(dealt(*a))
        return deals[-1]

    monkeypatch.setattr(suffixes, "_dealt", watched)
    monkeypatch.setattr(suffixes, "_most", lambda rows, many, crowd: crowd)
    for crowd in (1, 8, 30, 10**6):
        got = suffixes.remove_repeats(df, crowd=crowd).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want, crowd
    assert len(deals) == 3 and deals[0][1].count() > 0 and deals[2][0].groupBy("h").count().agg({"count": "max"}).first()[0] <= 30


@pytest.mark.parametrize("alphabet", [b"ab", b"abc\x00\xff", bytes(range(256))])
def test_two_stage_sort(alphabet):
    r = random.Random(1)
    parts = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(20)]
    data = np.concatenate([np.concatenate([np.frombuffer(p, "u1").astype("u2") + 1, [0]]) for p in parts])
    ends = np.repeat(np.cumsum([len(p) + 1 for p in parts]) - 1, [len(p) + 1 for p in parts])
    wanted = data > 0
    order = suffixes.two_stage_sort(data, ends, wanted, 1000)
    suffix = lambda p: tuple(data[p : ends[p]].tolist())
    assert sorted(order.tolist()) == np.nonzero(wanted)[0].tolist()
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in np.nonzero(wanted)[0])


# 6


def test_quality(spark, odd, none, sf):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (6, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    out = quality.score(odd, quality.fit(odd, labels), carry=("lang",)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5}
    labels = table(spark, sf.replace("0.001", "0.01"), "labels")
    rows = quality.op6_quality(spark, sf.replace("0.001", "0.01")).where("held_out").join(labels, "doc_id").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert right > 0.9 and auc > 0.9, (right, auc)


def test_quality_votes(spark, sf):
    """Cosines, neighbours and votes recomputed one by one, and the contract's threshold."""
    from binascii import crc32

    folder = sf.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels)
    learnt = {r.doc_id: r.quality for r in labels.collect() if crc32(str(r.doc_id).encode()) % 5}
    assert len(model.labels) == len({r.doc_id for r in docs.select("doc_id").collect()} & set(learnt))
    got = {r.doc_id: r for r in quality.op6_quality(spark, folder).collect()}
    for i, text in plain(docs.where("doc_id % 25 = 0")):
        v = np.zeros(model.latent.shape[1])
        for term, n in quality.terms(text).items():
            if term in model.index:
                v += (1 + math.log(n)) * model.latent[model.index[term]].astype("f8")
        cosines = [float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))) for w in model.vectors.astype("f8")]
        near = sorted(range(len(cosines)), key=lambda j: -cosines[j])[: quality.NEIGHBOURS]
        weight = [max(cosines[j], 0) ** quality.POWER for j in near]
        want = sum(w * model.labels[j] for w, j in zip(weight, near)) / sum(weight)
        assert abs(got[i].score - want) < 0.02, i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (crc32(str(i).encode()) % 5 == 0)


# 7


def brute_capacity(sizes, shards):
    best = {0: 0}
    for _ in range(shards):
        new = dict(best)
        for i, c in best.items():
            total = 0
            for j in range(i, len(sizes)):
                total += sizes[j]
                new[j + 1] = min(new.get(j + 1, 10**9), max(c, total))
        best = new
    return best[len(sizes)]


def test_capacity():
    r = random.Random(2)
    for _ in range(60):
        sizes = [r.choice([1, 3, 9, 50]) * r.randint(1, 9) for _ in range(r.randint(1, 14))]
        k = r.randint(1, 6)
        c = sharding.smallest_capacity(sizes, k)
        assert c == brute_capacity(sizes, k)
        at = sharding.cuts(sizes, k)
        held = Counter()
        for s, x in zip(at, sizes):
            held[s] += x
        assert at == sorted(at) and max(at) < k and max(held.values()) <= c
    assert sharding.smallest_capacity([], 4) == 0 and sharding.cuts([], 4) == []


def test_even_cuts():
    """No shard is left short: what earlier ones have over is shared by all that follow."""
    r = random.Random(7)
    sizes = [r.randint(50, 9000) for _ in range(1000)]
    held = Counter()
    for s, x in zip(sharding.cuts(sizes, 40), sizes):
        held[s] += x
    mean = sum(sizes) / 40
    assert len(held) == 40 and max(abs(x - mean) for x in held.values()) < 9000


def test_slots_whatever_the_partitions(spark, monkeypatch):
    """The same rows, a hot text and fully equal ones among them, in three and in seven partitions."""
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = [(i if i % 4 else None, "hot" if i % 2 else f"text {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(str, sharding.assign(df.repartition(n), 8).collect())) for n in (3, 7)]
    assert got[0] == got[1] and len(got[0]) == 6000


def test_shards(docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE", 3)
    monkeypatch.setattr(sharding, "RUN", 2)
    out = sharding.assign(docs, 8).collect()
    rows = plain(docs)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in out) == sorted(((i is None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    shard = defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        shard[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard.values())
    assert min(slots) >= 0 and max(slots) < 8


# 8


def test_chat(spark, sf):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|> there <\\| \\<|"), (1, 2, "assistant", "yes " * 50), (1, 3, "user", None), (1, 4, "assistant", "<|im_start|>x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, None, None, "n"), (3, 1, "user\n<|", "a\\b"), (None, 0, "user", "x"), (None, 0, "assistant", "y"), (4, 0, "assistant", "w " * 5000), (4, 1, "user", "v " * 5000)]
    rows += [(5, i, ("user", "assistant")[i % 2], sentence(i, 30)) for i in range(60)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, window int")
    shown = chat.format_chats(df, 100, 50)
    for r in shown.collect():
        turns = chat.parse(r.formatted)
        assert len(turns) == r.n_turns and (r.n_tokens <= 100 or r.n_turns == 1)
        assert sum(len(ids_of(x)) - 1 for role, t in turns for x in (chat.escape_role(role), chat.escape(t))) + 2 * len(turns) == r.n_tokens
    check_chat(rows, shown)
    small = table(spark, sf, "conversations")
    check_chat([(r.conv_id, r.turn, r.role, r.text) for r in small.collect()], chat.format_chats(small))
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    # a system turn that leaves no room for a turn goes, so every window keeps to the budget
    tight = spark.createDataFrame([(1, i, r, sentence(i, n)) for i, (r, n) in enumerate([("system", 20), ("user", 60), ("assistant", 60), ("user", 5), ("assistant", 5)])], "conv_id long, turn int, role string, text string")
    sizes = [len(ids_of(r.role)) + len(ids_of(r.text)) for r in tight.orderBy("turn").collect()]  # the two marks for the two end ids
    made = chat.format_chats(tight, max(sizes) + 3, 10_000).orderBy("window").collect()
    assert all(r.n_tokens <= max(sizes) + 3 for r in made) and sizes[0] + max(sizes) > max(sizes) + 3
    assert sum(r.n_turns - r.n_repeated for r in made) == 5 and any(r.n_repeated for r in made)


def check_chat(rows, shown):
    by, size = defaultdict(list), {r.conv_id: r.n for r in shown.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c, turn, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by[c].append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(shown).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        says = [t for r, t in turns if r == "assistant"]
        assert got[c].formatted_chars == size[c] and got[c].n_turns == len(turns) and got[c].loss_chars == sum(map(len, says))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(says).encode()).hexdigest()


def test_escapes():
    r = random.Random(3)
    for _ in range(500):
        s = "".join(r.choice("<|\\n\na") for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


# 9


def jaccard(a, b):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    a, b = of(a), of(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash(docs):
    rows = plain(docs)
    out = minhash.compare_with_edits(docs).collect()
    assert len(out) == len(rows)
    want = defaultdict(list)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = Counter(i for i, _ in rows)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(t) // 2
        want[i].append((len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest(), jaccard(t, t[: len(t) - k] + nxt[:k]), jaccard(t, nxt)))
    error = []
    for r in out:
        if ids[r.doc_id] > 1 or ids[order[(order.index(next(x for x in order if x[0] == r.doc_id)) + 1) % len(order)][0]] > 1:
            continue
        n, sha, edited, following = want[r.doc_id][0]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        error += [r.near_edited - edited, r.near_next - following]
    assert np.sqrt(np.mean(np.square(error))) < 0.05
    prints = defaultdict(set)
    for i, t in rows:
        prints[t or ""] |= {r.fingerprint for r in out if r.doc_id == i and ids[i] == 1}
    assert all(len(p) <= 1 for p in prints.values())


def test_empty_bins_by_one_rule(spark):
    """Every bin of texts of 1 to 60 shingles, against the probing written out."""
    texts = ["w"] + [sentence(50 + i, i + 5) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h = {r.doc_id: r.mh for r in df.select("doc_id", F.split("text", " ").alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).withColumn("mh", F.when(F.size("h") < 5, F.array(F.xxhash64("h"))).otherwise(F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("h", i + j) for j in range(1, 5)))))).collect()}
    probe = lambda j, a: minhash._mix((j * 128 + 1) * 0x9E3779B97F4A7C15 + a * 0xC2B2AE3D27D4EB4F & 2**64 - 1) % 128
    for r in minhash.add_fingerprint(df, "text", "fp").collect():
        bins = {}
        for x in h[r.doc_id]:
            b = (x + 2**63) >> 57
            bins[b] = min(x, bins.get(b, x))
        want = []
        for j in range(128):
            a, at = 0, j
            while at not in bins:
                at, a = probe(j, a), a + 1
            want.append(bins[at] & 255)
        got = [x >> 8 * k & 255 for x in r.fp for k in range(7, -1, -1)]
        assert got == want, r.doc_id
    assert all(sorted(minhash.order(j)) == list(range(128)) for j in range(128))


# 10


def test_packing(docs):
    for block in (1 << 23, 3000):
        check_packing(plain(docs), packing.pack(docs, block=block).collect())


def check_packing(rows, out):
    left = Counter()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids_of(t))
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        left[r.doc_id] += r.length
    assert {i: sum(map(len, x)) for i, x in texts.items()} == dict(left)
    for i, some in texts.items():
        if len(some) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(some[0]) and r.ids_crc32 == crc(some[0][at : at + r.length])
                at += r.length
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_lengths_fill_windows():
    r = np.random.default_rng(5)
    lengths = r.integers(1, 2048, 3000)
    piece, start, size, seq, at = packing.pack_lengths(lengths)
    assert np.bincount(piece, size).tolist() == lengths.tolist()
    fill = np.bincount(seq, size)
    assert (fill == 2048).sum() >= len(fill) - 1 and fill.max() <= 2048
    cut = len(piece) - len(lengths)
    assert cut < 0.15 * len(lengths)  # the solved combinations, not cutting, fill the windows
    assert len(packing.pack_lengths(lengths, passes=0)[0]) - len(lengths) > 1.5 * cut


def test_counts_are_those_solved():
    """Exact stock for a few combinations is found again; rounding keeps the sum and uses nothing whose count is 0."""
    histogram = np.bincount([1000] * 7 + [1048] * 7 + [400] * 4 + [648] * 4 + [1000] * 4, minlength=2049)
    rows = packing.combinations(histogram, 2048)
    assert rows.tolist() == [[1000, 648, 400], [1048, 1000, 0]]
    x = packing.solve(rows, histogram, close=1e-9)
    assert np.abs(x - [4, 7]).max() < 0.1 and packing.rounded(x).tolist() == [4, 7]
    assert packing.rounded(np.array([0.2, 0.2, 0.2, 0.0, 2.9])).tolist() == [0, 0, 1, 0, 3]
    every = packing.combinations(np.ones(65, "i8"), 64, heads=64, most=10**6)
    assert len(every) == len({tuple(sorted((a, b, 64 - a - b), reverse=True)) for a in range(1, 64) for b in range(0, 64 - a)})


def test_little_padding(spark, sf):
    """Whole tables: in each task at most one short sequence a block, which here is one a task."""
    docs = table(spark, sf.replace("0.001", "0.01"), "documents").repartition(3)
    out = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n < 2048 for r in out) <= 3
