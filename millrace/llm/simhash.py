"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits fall into three blocks. If two fingerprints differ in at most t bits, then for any radii whose sum
is t - 2 some block differs in no more bits than its radius. Each block, padded to 23 bits, has the words of the perfect
binary Golay code as anchors: their covering radius is 3, so a block lies within 3 bits of exactly one anchor, its home, and
within 3 more than its radius of the home of every block that it may be linked to. So a fingerprint is sent once to its home
and to every anchor within that larger distance, and at each anchor those at home are compared with all that came. No pair
is missed.

near_groups() links by fingerprints alone. like_groups() takes what meets at the anchors, by either of two fingerprints, as
candidates and links two texts only if their sets of shingles are alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, arrow_bytes, keep, partitions, table, trimmed, whole_groups
from millrace.llm.components import connected_components

GENERATOR, WIDTH, CHECKS, RADIUS = 0xC75, 23, 11, 3  # x^11+x^10+x^6+x^5+x^4+x^2+1
SPANS = ((0, 21), (21, 21), (42, 22))
HOMES, BATCH, OUT = 1 << 14, 3_000, 512  # OUT: rows of packed groups handed to the JVM at once
ARROW = 4 << 20  # bytes of whole texts or packed groups that a worker gets at once
FIRST = 16  # what open_pairs() gives a text in the first round; each later one gives four times as many, until none had more
SKETCH = 512
BROADCAST = 1_000_000  # text hashes, 8 bytes each
PRINTS = ("fp", "fp2")
PACKED = "key long, homes binary, others binary"
NODE = np.dtype([("fp", "<i8"), ("th", "<i8"), ("component", "<i8"), ("size", "<i8"), ("sketch", "u1", SKETCH // 8)])


def _syndrome(words: np.ndarray) -> np.ndarray:
    words = words.astype("i8")
    for bit in range(WIDTH - 1, CHECKS - 1, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << bit - CHECKS, words)
    return words


@lru_cache
def radii(bits: int) -> tuple[int, ...]:
    """Of the three blocks: two fingerprints that differ by more in each of them differ in more than `bits` bits."""
    total = max(0, bits - len(SPANS) + 1)
    return tuple(total // len(SPANS) + (i < total % len(SPANS)) for i in range(len(SPANS)))


@lru_cache
def _errors(radius: int) -> list[np.ndarray]:
    """For each syndrome the error words of at most that weight, the lightest first."""
    words = np.array([sum(1 << b for b in at) for n in range(radius + 1) for at in combinations(range(WIDTH), n)], "i8")
    s = _syndrome(words)
    order = np.argsort(s, kind="stable")
    return np.split(words[order], np.searchsorted(s[order], np.arange(1, 1 << CHECKS)))


def anchors(block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and anchor (0 .. 4095) of every anchor within radius of each 23-bit word; the first is its home."""
    table = _errors(radius)
    s = _syndrome(block)
    n = np.array([len(x) for x in table])[s]
    errors = np.concatenate([table[i] for i in s]) if len(s) else np.zeros(0, "i8")
    return np.repeat(np.arange(len(block)), n), (np.repeat(block.astype("i8"), n) ^ errors) >> CHECKS


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of what has these."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit SimHash of each text: XXH64 (seed 42) of its `words`-word shingles, repeats included, bit set if in over half;
    and another such fingerprint, of those hashes mixed."""
    hashes, sizes = [], []
    for text in texts:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        shingles = [b" ".join(w)] if 0 < len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        hashes += h
        sizes.append(len(h))
    n = np.array(sizes, "i8")
    out = np.zeros(len(texts), "u8"), np.zeros(len(texts), "u8")
    if hashes:
        at, some = np.cumsum(n) - n, n > 0
        flat = np.array(hashes, "<u8")
        for to, x in zip(out, (flat, _mixed(flat))):
            bits = np.unpackbits(x.view("u1").reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at[some], axis=0, dtype="i4")
            to[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(frames: Iterator[pd.DataFrame], words: int, carry: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [fingerprints(list(frame["text"].iloc[lo : lo + 256]), words) for lo in range(0, len(frame), 256)]
        fps = {c: np.concatenate([m[i] for m in made]).view("i8") if made else np.zeros(0, "i8") for i, c in enumerate(PRINTS)}
        yield pd.DataFrame({"doc_id": frame["doc_id"], **{c: frame[c] for c in carry}, **fps})


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view("u8") >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype("i8") for lo, n in SPANS]


def _homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for b, block in enumerate(_blocks(frame["fp"].to_numpy("i8"))):
            word = anchors(block, RADIUS)[1]
            at, n = np.unique(word + (b + len(SPANS) * _which(frame) << 12), return_counts=True)
            yield pd.DataFrame({"anchor": at, "n": n})


def _which(frame: pd.DataFrame) -> np.ndarray:
    """Of several kinds of fingerprints, which meet each at anchors of their own."""
    return frame["which"].to_numpy("i8") if "which" in frame else np.zeros(len(frame), "i8")


def _sent(frames: Iterator[pd.DataFrame], within: tuple[int, ...], splits: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows key, home, fp of _placed()."""
    for frame, key, home, i in _placed(frames, within, splits):
        yield pd.DataFrame({"key": key, "home": home, "fp": frame["fp"].to_numpy("i8")[i]})


def _sent_together(frames: Iterator[pd.DataFrame], within: tuple[int, ...], splits: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Rows key, homes, others: the fingerprints, or nodes, of a batch that meet at a key as bytes, so that few rows are shuffled."""
    for frame, key, home, i in _placed(frames, within, splits):
        order = np.lexsort((~home, key))
        key, home, i = key[order], home[order], i[order]
        items = frame["fp"].to_numpy("<i8") if "sketch" not in frame else nodes(frame)
        data, size = items[i].tobytes(), items.dtype.itemsize
        lo = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1]) if len(key) else np.zeros(0, "i8")
        cut = (lo + (np.add.reduceat(home.astype("i8"), lo) if len(lo) else lo)).tolist()
        hi = [*lo[1:].tolist(), len(key)]
        at = list(zip(lo.tolist(), cut, hi))
        for of in range(0, len(at), OUT):
            some = at[of : of + OUT]
            yield pd.DataFrame({"key": key[lo[of : of + OUT]], "homes": [data[size * a : size * b] for a, b, _ in some], "others": [data[size * b : size * c] for _, b, c in some]})


def nodes(frame: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(frame), NODE)
    for c in ("fp", "th", "component", "size"):
        out[c] = frame[c]
    out["sketch"] = np.frombuffer(b"".join(frame["sketch"]), "u1").reshape(len(frame), -1)
    return out


def _placed(frames: Iterator[pd.DataFrame], within: tuple[int, ...], splits: dict[int, int]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Batch, and key, home and place in the batch of what goes out. A crowded anchor's homes are dealt over several keys,
    and what visits it goes to each."""
    for whole in frames:
        for lo in range(0, len(whole), BATCH):
            frame = whole.iloc[lo : lo + BATCH]
            fp, which = frame["fp"].to_numpy("i8"), _which(frame)
            mixed = (_mixed(fp.view("u8")) >> np.uint64(32)).astype("i8")
            for b, block in enumerate(_blocks(fp)):
                i, word = anchors(block, RADIUS + within[b])
                home = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                anchor = word + (b + len(SPANS) * which[i] << 12)
                n = np.ones(len(anchor), "i8")
                for a, k in splits.items():
                    n[anchor == a] = k
                rep = np.repeat(np.arange(len(anchor)), n)
                salt = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                yield frame, (anchor[rep] << 20) + salt, home[rep] & (mixed[i[rep]] % n[rep] == salt), i[rep]


def local_links(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of fp which a chain of links starting at a home joins: stars for each such set, not all pairs.

    What is found is asked for its own neighbours in turn, so it can leave the rest and no link between two sets is lost.
    """
    fp = fp.view("u8")
    of = fp[home]
    linked = np.zeros(len(of), bool)
    for lo in range(0, len(of), tile := max(1, 4_000_000 // max(1, len(fp)))):
        linked[lo : lo + tile] = (np.bitwise_count(of[lo : lo + tile, None] ^ fp[None, :]) <= bits).sum(1) > 1
    a, b, rest = [], [], fp
    seen: set[int] = set()
    for x in of[linked].tolist():
        if x in seen:
            continue
        seen.add(x)
        queue = [x]
        while queue:
            near = np.bitwise_count(rest ^ np.uint64(queue.pop())) <= bits
            found = rest[near]
            new = [y for y in found.tolist() if y not in seen]
            seen.update(new)
            queue += new
            b.append(found)
            a.append(np.full(len(found), x, "u8"))
            rest = rest[~near]
    flat = lambda v: np.concatenate(v).view("i8") if v else np.zeros(0, "i8")
    return flat(a), flat(b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with one link a node, to the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        was, m = least.copy(), np.minimum(least[i], least[j])
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = least[least]
        if (least == was).all():
            break
    some = least != np.arange(len(nodes))
    return nodes[least[some]], nodes[some]


def _compared(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(frames, "key"):
        key, fp, home = frame["key"].to_numpy(), frame["fp"].to_numpy("i8"), frame["home"].to_numpy(bool)
        ends = [*(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        a, b, lo = [], [], 0
        for hi in ends:
            if home[lo:hi].any() and hi - lo > 1:
                x, y = local_links(fp[lo:hi], home[lo:hi], bits)
                a.append(x)
                b.append(y)
            lo = hi
        if a:
            a, b = forest(np.concatenate(a), np.concatenate(b))
            yield pd.DataFrame({"a": a, "b": b})


def local_pairs(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within `bits` to be checked first: all pairs of a set of up to FIRST that links join; in a larger set, for each
    member at home its nearest, the one it was found by, and the one with most neighbours at home, so a few a member. Last
    the members at home in larger sets, whose other pairs are left to open_pairs(): each pair that meets, meets at the
    homes of both, so the pairs left out have both ends among those members."""
    fp = fp.view("u8")
    of = np.nonzero(home)[0]
    linked = np.zeros(len(of), bool)
    for lo in range(0, len(of), tile := max(1, 4_000_000 // max(1, len(fp)))):
        linked[lo : lo + tile] = (np.bitwise_count(fp[of[lo : lo + tile], None] ^ fp[None, :]) <= bits).sum(1) > 1
    rest, done, by = np.arange(len(fp)), np.zeros(len(fp), bool), np.arange(len(fp))
    a, b, crowds = [], [], []
    for x in of[linked].tolist():
        if done[x]:
            continue
        done[x], queue, group = True, [x], [np.array([x])]
        while queue:
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= bits
            new = rest[near]
            new, rest = new[~done[new]], rest[~near]
            done[new], by[new] = True, at
            queue += new.tolist()
            group.append(new)
        g = np.concatenate(group)
        if len(g) <= FIRST:
            i, j = np.nonzero(np.triu(np.bitwise_count(fp[g, None] ^ fp[None, g]) <= bits, 1))
            a.append(g[i])
            b.append(g[j])
            continue
        own, degree = g[home[g]], np.zeros(len(g), "i8")
        for lo in range(0, len(own), tile := max(1, 4_000_000 // len(g))):
            some = own[lo : lo + tile]
            apart = np.bitwise_count(fp[some, None] ^ fp[None, g])
            degree += (apart <= bits).sum(0)
            apart[some[:, None] == g[None, :]] = 64
            a += [some, some]
            b += [g[apart.argmin(1)], by[some]]
        crowds.append(own)
        hub = g[degree.argmax()]
        near = own[np.bitwise_count(fp[own] ^ fp[hub]) <= bits]
        a.append(near)
        b.append(np.full(len(near), hub))
    i, j = (np.concatenate(v) if v else np.zeros(0, "i8") for v in (a, b))
    keep_ = i != j
    return fp[i[keep_]].view("i8"), fp[j[keep_]].view("i8"), fp[np.concatenate(crowds)].view("i8") if crowds else np.zeros(0, "i8")


def _met_together(frame: pd.DataFrame, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What meets at each key of frame, and which of it is at home."""
    key = frame["key"].to_numpy()
    lo = 0
    for hi in [*(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]:
        homes, others = (b"".join(frame[c].iloc[lo:hi]) for c in ("homes", "others"))
        items = np.frombuffer(homes + others, dtype)
        lo = hi
        if homes and len(items) > 1:
            yield items, np.arange(len(items)) < len(homes) // items.itemsize


def _candidates(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Pairs a, b to be checked first; with a null b, members a of larger sets."""
    for frame in whole_groups(frames, "key", 256):
        out, crowded = [np.zeros((2, 0), "i8")], [np.zeros(0, "i8")]
        for fp, home in _met_together(frame, "<i8"):
            i, j, crowd = local_pairs(fp.astype("i8"), home, bits)
            out.append(np.array([i, j]))
            crowded.append(crowd)
        a, b = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
        more = np.unique(np.concatenate(crowded))
        if len(a) or len(more):
            yield pd.DataFrame({"a": np.concatenate([a, more]), "b": pd.array([*b.tolist(), *[None] * len(more)], "Int64")})


def _sketched(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """The number of shingles of each text, and of those whose hash falls on each of SKETCH bits whether it is odd.

    Two sets differ in at least as many shingles as their sketches in bits, so a pair is ruled out without a miss.
    """
    for frame in frames:
        sizes, sketches = [], []
        for text in frame["text"]:
            shingles = shingle_set((text or "").encode("utf-8", "surrogatepass"), words)
            at = np.array([xxhash.xxh64_intdigest(x, 42) % SKETCH for x in shingles], "i8")
            sizes.append(len(shingles))
            sketches.append(np.packbits(np.bincount(at, minlength=SKETCH).astype("u1") & 1).tobytes())
        yield pd.DataFrame({"th": frame["th"], "size": np.array(sizes, "i8"), "sketch": sketches})


def open_pairs(met: np.ndarray, home: np.ndarray, bits: int, least: float, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Indices of the pairs of nodes, one at home, within `bits`, in different components and not ruled out by sketches;
    for each node at home up to `limit` of them, the likeliest first, and whether any had more."""
    fp, node, component, size, sketch = (met[c] for c in NODE.names)
    fp = fp.view("u8")
    a, b, more = [], [], False
    of = np.nonzero(home)[0]
    for lo in range(0, len(of), tile := max(1, 100_000 // len(fp))):
        some = of[lo : lo + tile]
        near = (np.bitwise_count(fp[some, None] ^ fp[None, :]) <= bits) & (component[some, None] != component[None, :])
        near &= ~home[None, :] | (node[some, None] < node[None, :])
        i, j = np.nonzero(near)
        i = some[i]
        apart = np.maximum(np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype="i8"), np.abs(size[i] - size[j]))
        share = apart / np.maximum(size[i] + size[j], 1)
        ok = share <= (1 - least) / (1 + least) + 1e-9
        i, j, share = i[ok], j[ok], share[ok]
        order = np.lexsort((share, i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        more = more or bool((rank >= limit).any())
        a.append(i[rank < limit])
        b.append(j[rank < limit])
    flat = lambda v: np.concatenate(v) if v else np.zeros(0, "i8")
    return flat(a), flat(b), more


def _open_pairs(frames: Iterator[pd.DataFrame], bits: int, least: float, limit: int) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(frames, "key", 64):
        for met, home in _met_together(frame, NODE):
            if (met["component"] == met["component"][0]).all():
                continue
            i, j, more = open_pairs(met.copy(), home, bits, least, limit)
            x, y = met["th"][i], met["th"][j]
            if len(x) or more:
                yield pd.DataFrame({"ta": np.minimum(x, y), "tb": np.maximum(x, y), "more": more})


def shingle_set(text: bytes, words: int) -> set[bytes]:
    w = text.lower().split()
    return {b" ".join(w)} if 0 < len(w) < words else {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)}


def _alike(frames: Iterator[pd.DataFrame], words: int, least: float) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for frame in frames:
        ok = np.zeros(len(frame), bool)
        last, of = None, set()
        for i, (ta, x, y) in enumerate(zip(frame["ta"], frame["pa"], frame["pb"])):
            if ta != last:
                last, of = ta, shingle_set(z.decompress(x), words)
            other = shingle_set(z.decompress(y), words)
            both = len(of & other)
            ok[i] = both >= least * (len(of) + len(other) - both)
        yield pd.DataFrame({"a": frame["ta"][ok], "b": frame["tb"][ok]})


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for frame in frames:
        yield pd.DataFrame({"t": frame["th"], "packed": [z.compress((x or "").encode("utf-8", "surrogatepass")) for x in frame["text"]]})


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(th, text) of the hashes wanted: no text is shuffled where they are few enough to broadcast."""
    wanted = keep(wanted.select("th").distinct(), "wanted")
    return rows.select("th", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "th", "left_semi")


def _checked(rows: DataFrame, edges: DataFrame, words: int, least: float) -> DataFrame:
    """Links a, b: the edges(ta, tb) whose whole texts are alike."""
    ends = edges.select(F.col("ta").alias("th")).union(edges.select("tb"))
    packed = keep(_texts_of(rows, ends).mapInPandas(_packed, "t long, packed binary").dropDuplicates(["t"]), "texts")
    side = lambda t, p: packed.select(F.col("t").alias(t), F.col("packed").alias(p))
    met = edges.join(side("ta", "pa"), "ta").join(side("tb", "pb"), "tb").select("ta", "tb", "pa", "pb")
    return met.mapInPandas(lambda it: trimmed(_alike(it, words, least)), "a long, b long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def like_groups(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 11) -> DataFrame:
    """doc_id, fingerprint, component_id as near_groups(), text_hash, and component_head (the smallest text_hash of
    component_id in the component, of a null one where it has no other), but of links between texts whose sets of shingles have at least
    `least` of their union in common, checked on whole texts; fingerprints within `bits` only propose pairs.

    Texts aren't linked directly if both of their two fingerprints differ in more than `bits` bits: of two texts at a likeness
    of 0.8, where a fingerprint differs in 10 bits on average, 11 bits find nine of ten. Texts are told apart by a 64-bit
    hash. In a large set of fingerprints a few pairs a member are checked first, and of different texts of one fingerprint one
    against the others and the neighbours. Texts of which more pairs may be open go to the anchors again, with their
    components and sketches, and all pairs of different components that their sketches don't rule out are checked, each
    text's likeliest first, with more a text each time until none had more: only pairs that are joined already stay
    unchecked. Two texts without words are alike; nulls, repeated rows and other columns as in near_groups().
    """
    with arrow_bytes(docs.sparkSession, ARROW):  # all Python work is done in here, the rest is a join of kept tables
        return _like_groups(docs, words, least, bits)


def _like_groups(docs: DataFrame, words: int, least: float, bits: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    marked = keep(rows.mapInPandas(lambda it: trimmed(_fingerprint(it, words, ("th",))), "doc_id long, th long, fp long, fp2 long"), "fingerprints")
    heads = keep(marked.groupBy("th", *PRINTS).agg(F.min("doc_id").alias("first")), "heads")
    edges, crowded = None, None
    for which, fp in enumerate(PRINTS):
        found, open_ = _proposed(heads.select("th", F.col(fp).alias("fp")), bits)
        open_ = open_.withColumn("which", F.lit(which))
        edges, crowded = (found, open_) if edges is None else (edges.union(found), crowded.union(open_))
    edges = keep(edges.distinct(), "edges")
    crowded = keep(crowded, "crowded")
    sketches = keep(_texts_of(rows, crowded).mapInPandas(lambda it: _sketched(it, words), "th long, size long, sketch binary").dropDuplicates(["th"]), "sketches")
    found = connected_components(_checked(rows, edges, words, least))
    tagged = keep(heads.join(found, F.col("th") == F.col("node"), "left").select("th", "first", F.coalesce("component", "th").alias("component")), "tagged")
    limit, more = FIRST, not crowded.isEmpty()
    while more:
        of_nodes = crowded.join(sketches, "th").join(tagged.select("th", "component"), "th").select("which", *NODE.names)
        met = _met(of_nodes, bits, _sent_together, PACKED)
        proposed = keep(met.mapInPandas(lambda it, limit=limit: trimmed(_open_pairs(it, bits, least, limit)), "ta long, tb long, more boolean"), "proposed")
        more, limit = not proposed.where("more").isEmpty(), 4 * limit
        todo = keep(proposed.select("ta", "tb").distinct().join(edges, ["ta", "tb"], "left_anti"), "todo")
        if todo.isEmpty():
            continue
        edges = edges.union(todo)
        of = lambda t, c: tagged.select(F.col("th").alias(t), F.col("component").alias(c))
        links = _checked(rows, todo, words, least).join(of("a", "ca"), "a").join(of("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        up = connected_components(links).withColumnRenamed("component", "root")
        tagged = keep(tagged.join(up, F.col("component") == F.col("node"), "left").select("th", "first", F.coalesce("root", "component").alias("component")), "tagged")
    head = tagged.groupBy("component").agg(F.min(F.struct(F.isnull("first").alias("none"), "first", "th")).alias("head"))
    of = tagged.join(head, "component").select("th", F.col("head.first").alias("component_id"), F.col("head.th").alias("component_head"))
    return marked.join(of, "th").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("th").alias("text_hash"), "component_head")


def _proposed(heads: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of heads(th, fp): links ta, tb to be checked first, and fp, th of all texts that may have others within `bits`."""
    ones = keep(heads.groupBy("fp").agg(F.min("th").alias("t0"), F.count("*").alias("texts")), "ones")
    met = _met(ones.select("fp"), bits, _sent_together, PACKED).mapInPandas(lambda it: _candidates(it, bits), "a long, b long")
    met = keep(met.distinct(), "met")
    pairs, several = met.where("b is not null"), ones.where("texts > 1").select("fp")
    # where a fingerprint has several texts, all of them and of their neighbours' texts stay open
    near = pairs.join(several, F.col("a") == F.col("fp"), "left_semi").select(F.col("b").alias("fp")).union(pairs.join(several, F.col("b") == F.col("fp"), "left_semi").select(F.col("a").alias("fp")))
    crowds = met.where("b is null").select(F.col("a").alias("fp")).union(several).union(near).distinct()
    name = lambda c, t: ones.select(F.col("fp").alias(c), F.col("t0").alias(t))
    same = heads.join(ones.where("texts > 1"), "fp").where("th <> t0").select(F.col("t0").alias("ta"), F.col("th").alias("tb"))
    links = pairs.join(name("a", "ta"), "a").join(name("b", "tb"), "b").select("ta", "tb").union(same)
    return links.select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")), heads.join(crowds, "fp").select("fp", "th")


def _met(fps: DataFrame, bits: int, send, schema: str) -> DataFrame:
    """What `send` makes of different fingerprints, sorted by key, all of a key in one task."""
    n = fps.mapInPandas(_homes, "anchor int, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOMES)
    splits = {r.anchor: -(-r.n // HOMES) for r in n.collect()}  # 3 x 4096 anchors at most
    sent = fps.mapInPandas(lambda it: send(it, radii(bits), splits), schema)
    return sent.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included).

    Fingerprints link at `bits` or fewer differing bits. Equal fingerprints meet once, whatever number of documents has
    them; links are drawn between different fingerprints, as stars, and joined over the cluster. A null text is an
    empty one, of fingerprint zero, linked like any other. A null doc_id gets its row, but counts for component_id only
    where its component has no other. Repeated rows stay; no rows give none; other columns are ignored.
    """
    marked = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda it: _fingerprint(it, words), "doc_id long, fp long, fp2 long").select("doc_id", "fp"), "fingerprints")
    heads = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "heads")
    met = _met(heads.select("fp"), bits, _sent, "key long, home boolean, fp long")
    links = met.mapInPandas(lambda it: _compared(it, bits), "a long, b long")
    found = connected_components(links)
    tagged = heads.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = tagged.groupBy("component").agg(F.min("first").alias("component_id"))
    of = tagged.join(least, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), words=4, bits=4)


QUERIES: dict[str, Query] = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
