"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Terms of a text: its lower-cased words, its words' shapes (first and last characters by class), and a few binned figures
of the whole text. The vocabulary, document weights and latent directions are fitted on a bounded sample of labelled
documents (`sample` rows, `terms` terms, `rank` directions); its vectors are broadcast, and every document's exact cosine
with each of them is computed block by block. The k nearest vote with their label, weighted by similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, table, trimmed

SAMPLE, TERMS, RANK, NEIGHBOURS, POWER, THRESHOLD = 3000, 6000, 48, 15, 4, 0.3
OUT = 1_024  # rows handed back at once
CLASSES = bytes(0x39 if 0x30 <= c <= 0x39 else 0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else c for c in range(256))


def terms(text: str | None) -> Counter:
    """Terms of a whole text and their counts; an empty text has those of its figures alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shapes = raw.translate(CLASSES)
    words = raw.lower().split()
    out = Counter(words)
    distinct, n = len(out), max(1, len(words))
    for shape, count in Counter(shapes.split()).items():
        out[b"\x00" + shape[:2] + shape[-2:]] += count
    lines = raw.split(b"\n")
    size = max(1, len(raw))
    upper, mark = shapes.count(b"A") / size, 1 - (shapes.count(b"a") + shapes.count(b"A") + shapes.count(b"9")) / size
    figures = {
        "length": int(2 * math.log1p(len(raw))), "word": min(20, len(raw) // n), "distinct": int(10 * distinct / n), "upper": int(20 * upper), "mark": int(20 * mark),
        "line": int(2 * math.log1p(len(raw) / len(lines))), "again": int(10 * (1 - len(set(lines)) / len(lines))), "digit": int(20 * shapes.count(b"9") / size),
    }
    for name, bin_ in figures.items():
        out[b"\x01" + f"{name}:{bin_}".encode()] = 3
    return out


@dataclass
class Model:
    """index: term to row of latent (weights included); vectors, labels: of the labelled sample; prior: its mean label."""

    index: dict[bytes, int]
    latent: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def _project(index: dict, latent: np.ndarray, texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), latent.shape[1]), "f4")
    for i, text in enumerate(texts):
        found = [(j, n) for t, n in terms(text).items() if (j := index.get(t)) is not None]
        if found:
            at, n = np.array(found).T
            w = _weights(n).astype("f4")
            out[i] = (w / np.sqrt((w**2).sum())) @ latent[at]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def vote(model: Model, texts: list[str | None], k: int, power: int) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(texts), 0.5)
    score = np.empty(len(texts))
    for lo in range(0, len(texts), 256):
        cosine = _project(model.index, model.latent, texts[lo : lo + 256]) @ model.vectors.T
        k_ = min(k, cosine.shape[1])
        near = np.argpartition(-cosine, k_ - 1, axis=1)[:, :k_]
        w = np.maximum(np.take_along_axis(cosine, near, 1).astype("f8"), 0) ** power
        total = w.sum(1)
        score[lo : lo + 256] = np.where(total > 0, (w * model.labels[near]).sum(1) / np.maximum(total, 1e-300), model.prior)
    return np.clip(score, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_terms: int = TERMS, rank: int = RANK) -> Model:
    """Fit on at most `sample` labelled documents outside the held-out fifth, those whose ids hash lowest.

    Rows with a null id, label or text aren't learned from. With no labelled rows the model scores 0.5 throughout.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = known.join(there, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # `sample` rows at most
    rows = keep(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")), "labelled")

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                yield pd.DataFrame({"term": list(terms(text))})

    common = rows.mapInPandas(distinct, "term binary").groupBy("term").count().orderBy(F.desc("count"), "term").limit(n_terms).collect()
    index = {bytes(r["term"]): i for i, r in enumerate(common)}
    if not index:
        return Model({}, np.zeros((0, 1), "f4"), np.zeros((0, 1), "f4"), np.zeros(0), 0.5)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, quality in zip(frame["doc_id"], frame["text"], frame["quality"]):
                found = [(j, n) for t, n in terms(text).items() if (j := index.get(t)) is not None]
                at, n = np.array(found, "<i4").reshape(-1, 2).T
                out.append((doc_id, quality, at.tobytes(), n.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "at", "n"])

    found = rows.mapInPandas(counted, "doc_id long, quality int, at binary, n binary").orderBy("doc_id").collect()  # `sample` rows of n_terms pairs at most
    m = len(found)
    idf = np.log((1 + m) / np.array([r["count"] for r in common])).astype("f4") + 0.1
    x = np.zeros((m, len(index)), "f4")
    for i, r in enumerate(found):
        at, w = np.frombuffer(r["at"], "<i4"), _weights(np.frombuffer(r["n"], "<i4"))
        x[i, at] = w / np.sqrt((w**2).sum()) * idf[at]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    # right singular vectors by subspace iteration from a fixed start
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype("f4"))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    right = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank]
    latent = np.ascontiguousarray(right.T * idf[:, None])
    vectors = x @ right.T
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    y = np.array([r["quality"] for r in found], "f8")
    return Model(index, latent, np.ascontiguousarray(vectors), y, float(y.mean()))


def _score(frames: Iterator[pd.DataFrame], model, k: int, power: int, names: list[str]) -> Iterator[pd.DataFrame]:
    for whole in frames:
        for lo in range(0, len(whole), OUT):
            frame = whole.iloc[lo : lo + OUT]
            yield frame[names].assign(score=vote(model.value, list(frame["text"]), k, power))


def score(docs: DataFrame, model: Model, k: int = NEIGHBOURS, power: int = POWER, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), and the columns of carry. A null text counts as empty and is scored by its figures; a text
    that shares no term with the sample gets the sample's mean label. Repeated rows stay; other columns are ignored."""
    kept = {c: "text" if c == "text" else f"carry_{i}" for i, c in enumerate(carry)}  # the text goes to Python once
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(x) for c, x in kept.items() if c != "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample, n_terms and rank
    schema = "doc_id long, " + "".join(f"{x} {rows.schema[x].dataType.simpleString()}, " for x in kept.values()) + "score double"
    return rows.mapInPandas(lambda it: trimmed(_score(it, shared, k, power, ["doc_id", *kept.values()])), schema).withColumnsRenamed({x: c for c, x in kept.items()})


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Query] = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
