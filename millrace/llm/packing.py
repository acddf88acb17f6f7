"""Packing documents into training sequences by non-negative least squares.

Documents are cut into full windows and one remainder. Over a block of documents, shallow combinations (two or three
lengths that fill a window exactly) are enumerated, their repeat counts are solved against the histogram of remainder
lengths by non-negative least squares and rounded so that their running sum is kept; a combination whose count comes to 0 is
not used. What stock the rounding leaves is solved again, PASSES times in all, and the remainders left over are packed
greedily: the longest that fits, then a piece cut to fill the gap. A block thus has at most one sequence that isn't full.

All pairs that fill a window are enumerated; of the triples, those with one of the HEADS commonest lengths, and of all rows
the COMBINATIONS whose lengths are commonest, pairs first. That bounds a solve; it costs whole documents only (what isn't
enumerated is packed greedily, with cuts), never an id and never a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, table
from millrace.llm.tokens import default_path, encoder

WINDOW, BLOCK_IDS, COMBINATIONS, HEADS, PASSES = 2048, 1 << 22, 20_000, 96, 3
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int, heads: int = HEADS, most: int = COMBINATIONS) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to window, each present: all pairs, the triples that have one of the `heads`
    commonest lengths; `most` at most, those of the commonest lengths, pairs first."""
    there = np.nonzero(histogram)[0]
    there = there[there > 0]
    pairs = there[(2 * there <= window) & (histogram[window - there] > 0)]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for a in there[np.argsort(-histogram[there], kind="stable")[:heads]]:
        b = there[2 * there <= window - a]
        c = window - a - b
        ok = (c > 0) & (histogram[np.maximum(c, 0)] > 0)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    rows = np.unique(np.sort(np.concatenate(out), axis=1)[:, ::-1], axis=0)
    if len(rows) > most:
        weight = np.log1p(histogram[rows]).sum(1) - 5.0 * (rows[:, 2] > 0)
        rows = rows[np.argsort(-weight, kind="stable")[:most]]
    return rows


def solve(rows: np.ndarray, histogram: np.ndarray, rounds: int = 200, close: float = 0.003) -> np.ndarray:
    """x >= 0 that brings the lengths used, each row x times, near to the histogram in least squares.

    Multiplicative updates: x *= A'h / A'Ax keeps x non-negative and never raises the residual. Ends when a round lowers the
    residual by less than the share `close` of it.
    """
    if not len(rows):
        return np.zeros(0)
    h = histogram.astype("f8").copy()
    h[0] = 0
    up = h[rows].sum(1)
    x, last = h[rows].max(1) / 3 + 1e-3, np.inf
    for _ in range(rounds):
        used = sum(np.bincount(rows[:, j], x, len(h)) for j in range(3))
        used[0] = 0
        residual = float(((used - h) ** 2).sum())
        if residual >= last * (1 - close):
            break
        last = residual
        x = x * up / np.maximum(used[rows].sum(1), 1e-12)
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole counts whose running sum is that of x, to the nearest: what one count loses goes to its neighbour."""
    return np.diff(np.floor(np.concatenate([[0.0], np.cumsum(x)]) + 0.5)).astype("i8")


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, heads: int = HEADS, most: int = COMBINATIONS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack remainders (each 1 .. window - 1): piece, start in it, length, sequence, offset of each part."""
    left = np.bincount(lengths, minlength=window + 1) if len(lengths) else np.zeros(window + 1, "i8")
    stock = {int(n): [int(i) for i in np.nonzero(lengths == n)[0][::-1]] for n in np.nonzero(left)[0]} if len(lengths) else {}
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for _ in range(passes):
        rows = combinations(left, window, heads, most)
        counts = rounded(solve(rows, left))
        for i in np.nonzero(counts)[0]:
            part = [int(n) for n in rows[i] if n]
            for _ in range(counts[i]):
                if any(left[n] < part.count(n) for n in part):
                    break
                at = 0
                for n in part:
                    out.append((stock[n].pop(), 0, n, seq, at))
                    left[n] -= 1
                    at += n
                seq += 1
    todo = np.sort(np.nonzero(left)[0])[::-1].tolist()
    rest = [(i, 0, n) for n in todo for i in stock[n]]  # longest first
    head, tail = 0, len(rest) - 1
    part_cut: tuple[int, int, int] | None = None
    while head <= tail or part_cut:
        at = 0
        while at < window and (part_cut or head <= tail):
            if part_cut:
                i, s, n = part_cut
                part_cut = None
            elif rest[head][2] <= window - at:
                i, s, n = rest[head]
                head += 1
            elif rest[tail][2] <= window - at:
                i, s, n = rest[tail]
                tail -= 1
            else:
                i, s, n = rest[head]
                head += 1
            take = min(n, window - at)
            out.append((i, s, take, seq, at))
            at += take
            if take < n:
                part_cut = (i, s + take, n - take)
        seq += 1
    return tuple(np.array(c, "i8") for c in (zip(*out) if out else ([],) * 5))


def _pack_block(keys: list, ids: list[bytes], window: int, first: int, heads: int, most: int) -> tuple[pd.DataFrame, int]:
    total = np.array([len(x) // 4 for x in ids], "i8")
    full = total // window
    doc = np.repeat(np.arange(len(ids)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window
    some = np.nonzero(total % window)[0]
    piece, within, size, seq, at = pack_lengths((total % window)[some], window, heads, most)
    n_full = len(doc)
    docs = np.concatenate([doc, some[piece]]) if len(piece) else doc
    starts = np.concatenate([start, full[docs[n_full:]] * window + within])
    sizes = np.concatenate([np.full(n_full, window, "i8"), size])
    seqs = np.concatenate([np.arange(n_full), n_full + seq]) + first
    crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(docs.tolist(), starts.tolist(), sizes.tolist())]
    frame = pd.DataFrame({"doc_id": pd.array([keys[d] for d in docs], "Int64"), "start": starts, "length": sizes, "ids_crc32": crc, "doc_tokens": total[docs], "sequence_id": seqs, "offset": np.concatenate([np.zeros(n_full, "i8"), at])})
    return frame, int(seqs.max() + 1 - first) if len(seqs) else 0


def _pack(frames: Iterator[pd.DataFrame], path: str, end_id: int, window: int, block: int, heads: int, most: int) -> Iterator[pd.DataFrame]:
    first, n = TaskContext.get().partitionId() << 40, 0
    keys: list = []
    ids: list[bytes] = []
    for frame in frames:
        for lo in range(0, len(frame), 256):
            some = frame.iloc[lo : lo + 256]
            for key, x in zip(some["doc_id"], encoder(path).batch(["" if t is None else t for t in some["text"]], end_id)):
                keys.append(None if pd.isna(key) else int(key))
                ids.append(x)
                n += len(x) // 4
                if n >= block:
                    out, used = _pack_block(keys, ids, window, first, heads, most)
                    yield out
                    keys, ids, n, first = [], [], 0, first + used
    if keys:
        yield _pack_block(keys, ids, window, first, heads, most)[0]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, block: int = BLOCK_IDS, heads: int = HEADS, most: int = COMBINATIONS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    No shuffle: a task packs its documents block by block (`block` ids, or one longer document), so it holds one block's
    ids; sequence ids carry the partition in their high bits and are gapless within it. Only a block's last sequence can
    be short; it is padded to the window unless its length is a power of two. `heads` and `most` bound what combinations()
    enumerates for a block. A null text is an empty one: one piece, of
    the end id. A null doc_id stays null; repeated rows are packed as often as they occur; no rows give none; other
    columns are ignored.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(lambda it: _pack(it, path, end_id, window, block, heads, most), SCHEMA)


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
