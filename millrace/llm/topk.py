"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie in vertical layout (one row a dimension). The inner products of a block of queries with a block of
candidates grow by some dimensions at a time; after each round, the Cauchy-Schwarz bound on the remaining dimensions' mass
says which pairs can still reach the query's k-th best score. Rounds run over whole blocks while many pairs are alive, then
over the pairs that are left. A task holds one group of candidates, in order of their ids, and every query passes it with
the floor that it has reached so far; so a task adds k rows a query, however many candidates it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Query, partitions, table

BLOCK = "dim int, kind string, n int, ids binary, mat binary"
LONG = (-(2**63), 2**63 - 1)
SPARSE = 0.03  # below this share of pairs alive, pairs are followed one by one


def _packed(mat: np.ndarray) -> tuple[str, bytes]:
    """In the narrowest of these types that holds all of it."""
    low, high = mat.min(initial=0), mat.max(initial=0)
    for kind in ("<i2", "<i4"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return kind, mat.astype(kind).tobytes()
    return "<f8", mat.astype("<f8").tobytes()


def _blocks(frames: Iterator[pd.DataFrame], rows: int, scale: float) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}

    def out(d: int, part: list) -> pd.DataFrame:
        ids, mat = np.array([p[0] for p in part], "<i8"), np.array([p[1] for p in part], "<f8").reshape(len(part), d)
        kind, packed = _packed(mat)
        return pd.DataFrame({"dim": [d], "kind": [kind], "n": [len(part)], "ids": [ids.tobytes()], "mat": [packed]})

    for frame in frames:
        for i, v in zip(frame["id"], frame["vec"]):
            v = np.floor(np.asarray(v, "f8") * scale)
            part = held.setdefault(len(v), [])
            part.append((i, v))
            if len(part) >= rows:
                yield out(len(v), held.pop(len(v)))
    for d, part in held.items():
        yield out(d, part)


def _rest(mat: np.ndarray, tops: list[int]) -> np.ndarray:
    """Of each column of mat (dimensions x vectors): the norm of its dimensions from each of tops on."""
    return np.array([np.sqrt((mat[lo:].astype("f8") ** 2).sum(axis=0)) for lo in tops])


def _meet(qs: np.ndarray, q_rest: np.ndarray, owns: np.ndarray, vertical: np.ndarray, rest: np.ndarray, ids: np.ndarray, k: int, step: int, floor: np.ndarray, shares: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pairs of a block of queries (rows of qs) and one of candidates that may be among a query's k best: query's row,
    candidate's column, score; and how many pairs each round still had.

    owns: the queries' ids, which are no candidates of theirs; floor: scores that count at least (-inf: unknown, it is then
    raised by what k candidates are sure to reach). shares: of pairs alive after each round, as last met; rounds that
    dropped few go unchecked.
    """
    d, n, m = len(vertical), len(qs), len(ids)
    score, seen, at, alive = np.zeros((n, m), vertical.dtype), [], 0, n * m
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids, owns, side, sorter=order) for side in ("left", "right"))
    for i in np.nonzero(hi > lo)[0]:
        score[i, order[lo[i] : hi[i]]] = -np.inf
    unknown = bool(np.isneginf(floor).any()) and m > k
    tops = [*range(0, d, step)]
    for b, top in enumerate(tops):
        end = min(top + step, d)
        if b + 1 < len(tops) and not unknown and shares is not None and shares.get(b, 0) > 0.5:
            shares[b] *= 0.99  # looked at again before long
            continue
        seen.append(alive)
        score += qs[:, at:end] @ vertical[at:end]
        at = end
        # sums are whole and exact; the bound is not, so it is widened
        left = np.multiply.outer((q_rest[b + 1] * (1 + 1e-5)).astype(score.dtype), rest[b + 1].astype(score.dtype))
        if unknown:
            low = score - left
            floor = np.maximum(floor, np.partition(low, m - k, axis=1)[:, m - k] - 2)
        left += score
        may = left >= (floor - 2 if end < d else floor)[:, None].astype(score.dtype)
        if end == d:
            may = score >= floor[:, None].astype(score.dtype)
            if np.isneginf(floor).any():
                may &= score > -np.inf
        alive = int(np.count_nonzero(may))
        if shares is not None:
            shares[b] = alive / max(n * m, 1)
        if alive <= SPARSE * n * m:
            break
    if not tops:
        may = score > -np.inf
    r, c = np.divmod(np.flatnonzero(may), m)
    s = score[r, c]
    for b in range(b + 1 if tops else 0, len(tops)):
        top, end = tops[b], min(tops[b] + step, d)
        seen.append(len(r))
        s = s + np.einsum("ij,ji->i", qs[r, top:end], vertical[top:end, c])
        keep = s + (q_rest[b + 1] * (1 + 1e-5))[r] * rest[b + 1][c] >= (floor - (2 if end < d else 0))[r]
        r, c, s = r[keep], c[keep], s[keep]
    other = s > -np.inf  # a query without a floor would else keep its own row
    return r[other], c[other], s[other], seen


def search(q: np.ndarray, own: int, vertical: np.ndarray, rest: np.ndarray, ids: np.ndarray, k: int, step: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block for one query, and how many candidates each round still had.

    vertical: dimensions x candidates; rest[b]: norms of the candidates' dimensions from b * step on; floor: a score that
    k candidates are known to reach (or -inf).
    """
    tops = [*range(0, len(q), step), len(q)]
    _, c, score, seen = _meet(q[None], _rest(q[:, None], tops), np.array([own]), vertical, rest, ids, k, step, np.array([floor]))
    best = np.lexsort((ids[c], -score))[:k]
    return ids[c][best], score[best], np.array(seen)


def _exact(q: np.ndarray, own: int, vertical: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """With integers of any size, for components so large that doubles can't hold the sums."""
    whole, c = [int(x) for x in q], [[int(x) for x in row] for row in vertical]
    held = lambda j: min(max(sum(a * row[j] for a, row in zip(whole, c)), LONG[0]), LONG[1])
    found = sorted((-held(j), int(i)) for j, i in enumerate(ids) if i != own)[:k]
    return np.array([i for _, i in found], "i8"), [-s for s, _ in found]


def _unpacked(blocks: list[tuple[str, bytes, bytes]], d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(i, "<i8") for _, i, _ in blocks])
    mats = [np.frombuffer(m, kind).reshape(-1, d) if d else np.zeros((len(i) // 8, 0), "<i2") for kind, i, m in blocks]
    return ids, np.concatenate(mats)


class _Group:
    """One group's candidates of one length, in order of their ids."""

    def __init__(self, blocks: list, d: int, rows: int, step: int):
        ids, mat = _unpacked(blocks, d)
        order = np.argsort(ids, kind="stable")
        self.d, self.rows, self.step, self.ids, self.mat = d, rows, step, ids[order], mat[order]
        self.most = float(max(abs(float(mat.max(initial=0))), abs(float(mat.min(initial=0)))))
        self.tops = [*range(0, d, step), d] if d else [0]
        self.shares: dict[int, float] = {}

    def best(self, owns: np.ndarray, qs: np.ndarray, k: int) -> pd.DataFrame:
        size = float(np.abs(qs.astype("f8")).max(initial=0)) * self.most * self.d
        if size >= 2**52:
            found = [_exact(q, own, self.mat.T, self.ids, k) for q, own in zip(qs, owns)]
            return pd.DataFrame({"query_id": np.repeat(owns, [len(f) for f, _ in found]), "vec_id": np.concatenate([f for f, _ in found]), "score": [s for _, x in found for s in x]})
        kind = "f4" if size < 2**24 else "f8"  # sums that this type holds exactly
        qs, n = qs.astype(kind), len(qs)
        q_rest = _rest(qs.T, self.tops)
        row, col, score = (np.empty(0, "i8") for _ in range(3))
        floor = np.full(n, -np.inf)
        for lo in range(0, len(self.ids), self.rows):
            ids = self.ids[lo : lo + self.rows]
            vertical = np.ascontiguousarray(self.mat[lo : lo + self.rows].T.astype(kind))
            r, c, s, _ = _meet(qs, q_rest, owns, vertical, _rest(vertical, self.tops), ids, k, self.step, floor, self.shares)
            if not len(r):
                continue
            row, col, score = np.concatenate([row, r]), np.concatenate([col, c + lo]), np.concatenate([score, s.astype("i8")])
            order = np.lexsort((col, -score, row))  # ids rise with the column
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kth = place == k - 1
            floor[row[kth]] = score[kth] + 1  # a tie further on has a larger id
            row, col, score = (x[place < k] for x in (row, col, score))
        return pd.DataFrame({"query_id": owns[row], "vec_id": self.ids[col], "score": score})


def _pairs(frames: Iterator[pd.DataFrame], k: int, step: int, q_rows: int, c_rows: int) -> Iterator[pd.DataFrame]:
    """Of rows sorted by dim, candidates before queries: the k best candidates of each query."""
    dim, cands, queries, group = None, [], [], None

    def met() -> Iterator[pd.DataFrame]:
        nonlocal group, queries, cands
        if cands and queries:
            group = group or _Group(cands, dim, c_rows, step)
            yield group.best(*_unpacked(queries, dim), k)
        queries = []

    for frame in frames:
        for d, is_query, kind, ids, mat in zip(frame["dim"], frame["is_query"], frame["kind"], frame["ids"], frame["mat"]):
            if d != dim:
                yield from met()
                dim, cands, group = d, [], None
            (queries if is_query else cands).append((kind, ids, mat))
            if sum(len(q[1]) for q in queries) >= 8 * q_rows:  # less than twice as many, as a block has q_rows at most
                yield from met()
    yield from met()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, q_rows: int = 512, c_rows: int = 4096, dims: int = 16, groups: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products of floor(scale * x).

    Queries: the rows where is_query holds. Candidates: every row with another id. Ties go to the smaller id. Vectors
    that are null or hold null or non-finite components, and rows without an id, take no part; a vector meets only
    vectors of its own length; repeated rows of one id are each a candidate and, as queries, share k rows. Sums beyond
    the long range saturate. No rows give no rows. Other columns are ignored.

    Candidates are dealt over as many groups as shuffles have partitions, `groups` at most, as each gets every query.
    """
    x = F.col("vec")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False)))
    salts = min(partitions(vectors.sparkSession), groups)
    cand = rows.select("id", "vec").mapInPandas(lambda it: _blocks(it, c_rows // 4, scale), BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    some = rows.where("is_query").dropDuplicates(["id", "vec"]).select("id", "vec").mapInPandas(lambda it: _blocks(it, q_rows, scale), BLOCK)
    some = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = cand.withColumn("is_query", F.lit(False)).unionByName(some.withColumn("is_query", F.lit(True)))
    met = both.repartitionById(salts, F.col("salt")).sortWithinPartitions("dim", "is_query").drop("salt", "n")
    found = met.mapInPandas(lambda it: _pairs(it, k, dims, q_rows, c_rows), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
QUERIES: dict[str, Query] = {"op1_exact_topk": op1_exact_topk}
ORACLES = {"op1_exact_topk": ORACLE}
