"""Removal of repeated 200-byte strings by suffix arrays that a two-stage sort builds.

Every 200-byte string is filed under its smallest k-gram hash, so equal strings meet under the same hash at the same
place within it. Neighbouring strings with one such k-gram form a run; a run travels as its hash, the 128-bit digest of its
bytes (c, e) and its place. A run whose bytes occur twice is wholly repeated. Where different runs share a k-gram, their bytes are
fetched and a suffix array over them decides, by adjacent common prefixes, which strings occur more than once.

No task gets all of a crowded k-gram (more than CROWD rows and a quarter of a task's even share): its runs are dealt by
their bytes, bytes that crowd themselves are counted before any shuffle, and contexts are filed anew under ever longer
bytes around the k-gram, which equal strings have in common.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, partitions, table, whole_groups

LENGTH, GRAM, CHUNK, TEXT, CROWD = 200, 64, 1 << 20, 400_000, 1_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
RUN = "doc_id long, th long, start long, n int, h long, c long, e long"
CONTEXT = "doc_id long, th long, start long, n int, place int, h long, c long, kind int, bytes binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, "u8")
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


_tables: list[np.ndarray] = []


def _tables_() -> list[np.ndarray]:
    if not _tables:
        size = CHUNK + 1
        _tables.extend([_powers(int(BASE), size), _powers(pow(int(BASE), -1, 1 << 64), size)])
    return _tables


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(32)


def runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, strings and k-gram hash of every run. valid: where a string of `length` bytes may start."""
    width, n = length - gram + 1, len(data)
    none = (np.zeros(0, "i8"),) * 3
    if n < length or not valid.any():
        return none
    up, down = _tables_()
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * up[:n], out=total[1:])
        grams = _mixed((total[gram:] - total[:-gram]) * down[: n + 1 - gram])
        at = np.arange(len(grams), dtype="u8")
        keyed = grams & ~np.uint64(CHUNK - 1) | at
        pad = -len(keyed) % width
        rows = np.concatenate([keyed, np.full(pad, 2**64 - 1, "u8")]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        where = (least & np.uint64(CHUNK - 1)).astype("i8")
        ok = valid[:starts]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (where[1:] != where[:-1])
        start = np.nonzero(first)[0]
        if not len(start):
            return none
        ends = ok & np.concatenate([first[1:] | ~ok[1:], [True]])
        strings = np.nonzero(ends)[0] + 1 - start
        return start, strings, grams[where[start]]


def _runs(frames: Iterator[pd.DataFrame], length: int, gram: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"]]
        ids, th = frame["doc_id"].array, frame["th"].to_numpy("i8")
        batch: list[tuple[int, int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) < length:
                continue
            step = CHUNK - length
            for lo in range(0, max(1, len(t) - length + 1), step):
                part = t[lo : lo + step + length - 1] if len(t) > CHUNK else t
                if size + len(part) > CHUNK:
                    yield _batch(batch, ids, th, length, gram)
                    batch, size = [], 0
                batch.append((i, lo, part))
                size += len(part)
                if part is t:
                    break
        if batch:
            yield _batch(batch, ids, th, length, gram)


def _batch(batch: list[tuple[int, int, bytes]], ids, th: np.ndarray, length: int, gram: int) -> pd.DataFrame:
    raw = b"".join(b for *_, b in batch)
    data = np.frombuffer(raw, "u1")
    sizes = np.array([len(b) for *_, b in batch])
    begin = np.cumsum(sizes) - sizes
    valid = np.zeros(len(data), bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        valid[b : b + max(0, n - length + 1)] = True
    start, strings, h = runs(data, valid, length, gram)
    digests = b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(start.tolist(), (start + strings + length - 1).tolist())])
    c, e = np.frombuffer(digests, "<i8").reshape(-1, 2).T
    # a run never crosses documents: the last starts of a document aren't valid
    doc = np.searchsorted(begin, start, "right") - 1
    of, lo = np.array([i for i, *_ in batch]), np.array([x for _, x, _ in batch], "i8")
    return pd.DataFrame({"doc_id": ids[of[doc]], "th": th[of[doc]], "start": start - begin[doc] + lo[doc], "n": strings.astype("i4"), "h": h.view("i8"), "c": c, "e": e})


def _sorted_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of runs sorted by (h, c, e): kind 1: repeated as a whole; kind 2: one example of repeated bytes among different
    ones; kind 3: bytes that occur once among different ones. The rest goes. Holds one row more than a batch. Where the
    task has only a part of a k-gram's runs, the column several says whether all of them have different bytes."""
    held: pd.DataFrame | None = None
    before = first = None  # h, c, e of the last row that was given out, and of the first one with its h

    def out(frame: pd.DataFrame, following: tuple | None) -> pd.DataFrame:
        nonlocal before, first
        h, c, e = (frame[x].to_numpy() for x in "hce")
        n = len(frame)
        new_h, new_c = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1]) | (e[1:] != e[:-1])
        new_h[0] = before is None or h[0] != before[0]
        new_c[0] = before != (h[0], c[0], e[0])
        last = (h[-1], c[-1], e[-1])
        follow_c = np.concatenate([~new_c[1:], [following == last]]).astype(bool)
        follow_h = np.concatenate([~new_h[1:], [following is not None and following[0] == h[-1]]]).astype(bool)
        lead = np.maximum.accumulate(np.where(new_h, np.arange(n), -1))
        to = np.maximum(lead, 0)
        unlike_first = (c[to] != c) | (e[to] != e)
        if first is not None:
            unlike_first = np.where(lead >= 0, unlike_first, (first[1] != c) | (first[2] != e))
        again = ~new_c | follow_c
        told = frame["several"]
        mixed = ~follow_c & np.where(told.isna(), follow_h | unlike_first, told.eq(True)).astype(bool)
        kind1, kind2, kind3 = again, again & mixed, ~again & mixed
        before, first = last, (h[lead[-1]], c[lead[-1]], e[lead[-1]]) if lead[-1] >= 0 else first
        frame = frame.drop(columns="several")
        return pd.concat([frame[m].assign(kind=k) for k, m in ((1, kind1), (2, kind2), (3, kind3))], ignore_index=True)

    for frame in frames:
        if not len(frame):
            continue
        if held is not None:
            yield out(held, tuple(frame[x].iloc[0] for x in "hce"))
        held = frame
    if held is not None:
        yield out(held, None)


def two_stage_sort(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions that are wanted, in the order of their suffixes up to `depth` bytes.

    data: byte + 1, with 0 where a part ends; ends: the end of each position's part. Only suffixes smaller than their
    successors are compared; every other one is induced from its successor by one scan over the buckets of first symbols.
    """
    n = len(data)
    step = np.sign(np.diff(data.astype("i4")))
    change = np.where(step != 0, np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = np.ones(n, bool)  # smaller than its successor; the last separator counts as small
    small[:-1] = np.where(change < n, step[np.minimum(change, n - 2)] > 0, True)
    small[data == 0] = True
    # wanted positions, and what follows each up to the next small one
    nearest = np.where(small, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    mark = np.zeros(n + 1, "i4")
    at = np.nonzero(wanted)[0]
    np.add.at(mark, at, 1)
    np.add.at(mark, nearest[at] + 1, -1)
    inside = np.cumsum(mark)[:n] > 0
    raw = np.maximum(data.astype("i4") - 1, 0).astype("u1").tobytes()
    seeds = np.nonzero(inside & small)[0]
    stop = np.minimum(ends[seeds], seeds + depth)
    pairs = sorted((raw[p:q], p) for p, q in zip(seeds.tolist(), stop.tolist()))
    seeds = np.array([p for _, p in pairs], "i8")
    del pairs
    first = data[seeds].astype("i4")
    bounds = np.searchsorted(first, np.arange(258)) if len(seeds) else np.zeros(258, "i8")
    large = inside & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for bucket in range(257):
        scan = []
        now = np.concatenate(waiting[bucket]) if waiting[bucket] else np.zeros(0, "i8")
        while len(now):
            scan.append(now)
            p = now - 1
            now = p[(p >= 0) & large[p] & (data[p] == bucket)]
        scan.append(seeds[bounds[bucket] : bounds[bucket + 1]])
        order = np.concatenate(scan)
        out.append(order)
        p = order - 1
        p = p[(p >= 0) & large[p] & (data[p] > bucket)]
        symbols = data[p]
        for s in np.unique(symbols):
            waiting[s].append(p[symbols == s])
    order = np.concatenate(out)
    return order[wanted[order]]


def repeated(parts: list[bytes], strings: list[int], length: int) -> np.ndarray:
    """For all strings of all parts in turn (part i has strings[i] of them, at its start): does it occur more than once?"""
    sizes = np.array([len(p) for p in parts], "i8")
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.zeros(int((sizes + 1).sum()), "u2")
    inside = np.ones(len(data), bool)
    inside[begin + sizes] = False
    data[inside] = np.frombuffer(b"".join(parts), "u1").astype("u2") + 1
    ends = np.repeat(begin + sizes, sizes + 1)
    count = np.array(strings, "i8")
    starts = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = two_stage_sort(data, ends, wanted, length)
    windows = np.lib.stride_tricks.sliding_window_view(data.astype("u1") - np.uint8(1), length)
    twice = np.zeros(len(data), bool)
    for lo in range(0, len(order) - 1, 50_000):
        a, b = order[lo : lo + 50_000], order[lo + 1 : lo + 50_001]
        a = a[: len(b)]
        same = (windows[a] == windows[b]).all(axis=1)  # their common prefix has the whole length
        twice[a[same]] = twice[b[same]] = True
    return twice[starts]


def _decide(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(frames, "h", 256):
        key = frame["h"].to_numpy()
        sizes = frame["bytes"].str.len().to_numpy().cumsum()
        ends = [*(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        lo = 0
        for hi, after in zip(ends, [*ends[1:], None]):  # whole groups, up to TEXT bytes a sort unless one is larger
            if after is not None and sizes[after - 1] - (sizes[lo - 1] if lo else 0) <= TEXT:
                continue
            yield _group(frame.iloc[lo:hi], length)
            lo = hi


def _group(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    parts, n = list(frame["bytes"]), frame["n"].to_numpy("i8")
    if sum(map(len, parts)) <= 8 * TEXT:
        twice = repeated(parts, n.tolist(), length)
    else:
        twice = _crowd(parts, n, length)
    # stretches of repeated strings, in runs that occur once
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    twice &= (frame["kind"].to_numpy() == 3)[of]
    first = twice & ~np.concatenate([[False], twice[:-1] & (of[1:] == of[:-1])])
    last = twice & ~np.concatenate([twice[1:] & (of[1:] == of[:-1]), [False]])
    lo, hi = np.nonzero(first)[0], np.nonzero(last)[0]
    start = frame["start"].to_numpy("i8")[of[lo]]
    return pd.DataFrame({"doc_id": frame["doc_id"].array[of[lo]], "th": frame["th"].to_numpy("i8")[of[lo]], "lo": start + at[lo], "hi": start + at[hi] + length})


def _crowd(parts: list[bytes], n: np.ndarray, length: int) -> np.ndarray:
    """As repeated(), for a k-gram with very many different surroundings: its strings are dealt by their hash over several
    sorts, each of strings that may be equal, so that no sort holds them all."""
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    lots = np.array([hash(parts[i][s : s + length]) for i, s in zip(of.tolist(), at.tolist())], "i8")
    turns = -(-len(of) * length // (8 * TEXT))
    twice = np.zeros(len(of), bool)
    for turn in range(turns):
        some = np.nonzero(lots % turns == turn)[0]
        if len(some):
            twice[some] = repeated([parts[i][s : s + length] for i, s in zip(of[some].tolist(), at[some].tolist())], [1] * len(some), length)
    return twice


def _cut(frames: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for frame in frames:
        rows = []
        for packed, spans in zip(frame["packed"], frame["spans"]):
            text = z.decompress(packed) if packed else b""
            kept, removed, count, at = [], 0, 0, 0
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans) if spans is not None else ():
                if lo > at or not count:
                    kept.append(text[at:lo])
                    count += 1
                    removed -= lo
                elif hi <= at:
                    continue
                else:
                    removed -= at
                at = max(at, hi)
                removed += at
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if whole else None))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])
        yield pd.concat([frame.drop(columns=["packed", "spans"]), out if whole else out.drop(columns="kept_text")], axis=1)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for frame in frames:
        yield frame.drop(columns="text").assign(packed=[z.compress((t or "").encode("utf-8", "surrogatepass")) for t in frame["text"]])


def _contexts(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for frame in frames:
        rows = []
        for doc_id, th, packed, asks in zip(frame["doc_id"].array, frame["th"], frame["packed"], frame["asks"]):
            text = z.decompress(packed)
            rows += [(None if pd.isna(doc_id) else int(doc_id), th, a["start"], a["n"], -1, a["h"], 0, a["kind"], text[a["start"] : a["start"] + a["n"] + length - 1]) for a in asks]
        yield _context_frame(rows)


def _context_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "th", "start", "n", "place", "h", "c", "kind", "bytes"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


def gram_place(string: bytes, gram: int) -> int:
    """Where the smallest k-gram of a string starts: that of runs()."""
    data = np.frombuffer(string, "u1")
    up, down = _tables_()
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * up[: len(data)])])
        grams = _mixed((total[gram:] - total[:-gram]) * down[: len(data) + 1 - gram])
    return int(np.argmin(grams & ~np.uint64(CHUNK - 1)))


def _finer(frames: Iterator[pd.DataFrame], length: int, gram: int, width: int) -> Iterator[pd.DataFrame]:
    """Runs cut into classes of strings that have their k-gram within `width` places, each class filed under the
    length - width + 1 bytes around the k-gram that all its strings have: equal strings still meet."""
    for frame in frames:
        rows = []
        for doc_id, th, start, n, place, kind, data in zip(frame["doc_id"].array, *(frame[x] for x in ("th", "start", "n", "place", "kind", "bytes"))):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            place = gram_place(data[:length], gram) if place < 0 else place
            at = 0
            while at < n:
                of, past = divmod(place - at, width)
                many = min(n - at, past + 1)
                shared = data[place - of * width : place - of * width - width + 1 + length]
                h, c = struct.unpack("<qq", hashlib.blake2b(of.to_bytes(4, "little") + shared, digest_size=16).digest())
                rows.append((doc_id, th, start + at, many, place - at, h, c, kind, data[at : at + many - 1 + length]))
                at += many
        yield _context_frame(rows)


def _crowds(df: DataFrame, most: int) -> DataFrame:
    """The h, c that more than `most` rows have: no more than rows / most of them."""
    return df.groupBy("h", "c").count().where(F.col("count") > most).select("h", "c")


def _most(rows: int, many: int, crowd: int) -> int:
    """Rows of one key that a task may get: a quarter of its even share, so fewer than 4 * many keys have more."""
    return max(crowd, rows // (4 * many))


def _kinds(found: DataFrame, many: int, crowd: int) -> DataFrame:
    """The runs that count, with their kind (see _sorted_runs)."""
    most, slots = _most(found.count(), many, crowd), 16 * many
    slot = F.pmod("h", F.lit(slots))
    # a crowded k-gram's slot is crowded, so k-grams are counted in those slots alone
    full = keep(found.groupBy(slot.alias("slot")).count().where(F.col("count") > most).select("slot"), "slots")
    hot = keep(found.join(F.broadcast(full), slot == F.col("slot"), "left_semi").groupBy("h").agg(F.count("*").alias("runs"), ((F.min("c") < F.max("c")) | (F.min("e") < F.max("e"))).alias("several")).where(F.col("runs") > most).select("h", "several"), "hot")
    if hot.isEmpty():
        dealt = found.withColumn("several", F.lit(None).cast("boolean")).repartition(many, "h")
        return keep(dealt.sortWithinPartitions("h", "c", "e").mapInPandas(_sorted_runs, RUN + ", kind int"), "runs")
    columns = found.columns
    copies = found.join(F.broadcast(hot), "h").groupBy("h", "c", "e", "several").agg(F.count("*").alias("runs"), F.min(F.struct("doc_id", "th", "start", "n")).alias("one"))
    copies = keep(copies.where(F.col("runs") > most), "copies")
    same = F.broadcast(copies.select("h", "c", "e"))
    rest = found.join(same, ["h", "c", "e"], "left_anti").join(F.broadcast(hot), "h", "left").select(*columns, "several")
    dealt = rest.repartition(many, F.when(F.col("several").isNull(), F.col("h")).otherwise(F.xxhash64("h", "c", "e")))
    kinds = dealt.sortWithinPartitions("h", "c", "e").mapInPandas(_sorted_runs, RUN + ", kind int")
    whole = found.join(same, ["h", "c", "e"], "left_semi").select(*columns, F.lit(1).alias("kind"))
    ones = copies.where("several").select("one.doc_id", "one.th", "one.start", "one.n", "h", "c", "e", F.lit(2).alias("kind"))
    return keep(kinds.union(whole).union(ones), "runs")


def _dealt(context: DataFrame, crowds: DataFrame, most: int, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of which no more than `most` share h, and those strings that are equal to more than `most` others."""
    context, width, calm = keep(context, "contexts"), length - gram + 1, []
    columns = context.columns
    while True:
        calm.append(context.join(F.broadcast(crowds), ["h", "c"], "left_anti").select(*columns))
        crowded = context.join(F.broadcast(crowds), ["h", "c"], "left_semi").select(*columns)
        if width == 1:
            break
        width = -(-width // 2)
        context = keep(crowded.mapInPandas(lambda it, width=width: _finer(it, length, gram, width), CONTEXT), "contexts")
        crowds = keep(_crowds(context, most), "crowds")
        if crowds.isEmpty():
            calm, crowded = [*calm, context], None
            break
    out = calm[0]
    for more in calm[1:]:
        out = out.union(more)
    return out, crowded


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text) and spans (array of lo, hi) of the documents that have bytes to remove."""
    many = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    packed = rows.mapInPandas(_packed, "doc_id long, th long, packed binary")
    kinds = _kinds(keep(rows.mapInPandas(lambda it: _runs(it, length, gram), RUN), "found"), many, crowd)
    open_ = kinds.where("kind > 1")
    asks = open_.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "h", "kind")).alias("asks"))
    met = packed.join(asks.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "packed", "asks")
    context = met.mapInPandas(lambda it: _contexts(it, length), CONTEXT)
    most = _most(open_.count(), many, crowd)
    crowds, equal = keep(_crowds(open_.select("h", F.lit(0).cast("long").alias("c")), most), "crowds"), None
    if not crowds.isEmpty():
        context, equal = _dealt(context, crowds, most, length, gram)
    cut = context.repartition(many, "h").sortWithinPartitions("h").mapInPandas(lambda it: _decide(it, length), "doc_id long, th long, lo long, hi long")
    to = (F.col("start") + F.col("n") + F.lit(length - 1)).alias("hi")
    whole = kinds.where("kind = 1").select("doc_id", "th", F.col("start").alias("lo"), to).union(cut)
    if equal is not None:
        whole = whole.union(equal.where("kind = 3").select("doc_id", "th", F.col("start").alias("lo"), to))
    return whole.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, kept_text if with_text, and the columns of carry.

    Removed is every byte covered by a string of `length` bytes that also starts elsewhere, in this document or another;
    strings are judged on the input, and matches never cross documents. A null text is an empty one; texts shorter than
    `length` stay whole. Repeated rows, and rows with a null doc_id, are documents like any other. kept_text lacks
    what a removed span left of a character that it cut in two. No rows give no rows; columns not in carry are ignored.
    """
    kept = {c: f"carry_{i}" for i, c in enumerate(carry)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text", *(F.col(f"`{c}`").alias(x) for c, x in kept.items()))
    more = "".join(f", {x} {rows.schema[x].dataType.simpleString()}" for x in kept.values())
    packed = rows.mapInPandas(_packed, "doc_id long, th long, packed binary" + more)
    found = spans(docs, length, gram, crowd).withColumnsRenamed({"doc_id": "d", "th": "t"})
    met = packed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + more
    out = met.select("doc_id", "packed", "spans", *kept.values()).mapInPandas(lambda it: _cut(it, with_text), schema)
    return out.withColumnsRenamed({x: c for c, x in kept.items()})


def op5_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
