"""Token ids in binary files: blocks of ids as byte planes, each compressed with zstandard, behind a chunk index.

File, little-endian: magic "MRP1", u32 documents, u32 chunks, u32 ids a chunk; doc_ids i64[], is-null flags u8[], ids of
each document u32[]; the index: for each chunk u32 ids and four times u32 length of a compressed plane (0: all zero
bytes); then the planes in order. A file holds whole documents, in ascending doc_id order (null first).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, partitions, table
from millrace.llm.tokens import default_path, encoder

MAGIC, CHUNK, FILE_IDS = b"MRP1", 1 << 16, 1 << 20


def pack(doc_ids: list, ids: list[bytes], chunk: int = CHUNK) -> bytes:
    """One file's bytes."""
    import zstandard

    z, flat = zstandard.ZstdCompressor(level=1), np.frombuffer(b"".join(ids), "<u4")
    index, planes = [], []
    for lo in range(0, len(flat), chunk):
        part = flat[lo : lo + chunk]
        rows = np.ascontiguousarray(part.view("u1").reshape(-1, 4).T)
        packed = [z.compress(r.tobytes()) if r.any() else b"" for r in rows]
        index.append([len(part), *map(len, packed)])
        planes += packed
    head = MAGIC + struct.pack("<III", len(ids), len(index), chunk)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    return head + known + np.array([len(x) // 4 for x in ids], "<u4").tobytes() + np.array(index, "<u4").tobytes() + b"".join(planes)


def unpack(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    import zstandard

    if content[:4] != MAGIC:
        raise ValueError("not a file of token planes")
    docs, chunks, _ = struct.unpack_from("<III", content, 4)
    at = 16
    keys = np.frombuffer(content, "<i8", docs, at)
    nulls = np.frombuffer(content, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    index = np.frombuffer(content, "<u4", 5 * chunks, at := at + 13 * docs).reshape(-1, 5)
    at, z, out = at + 20 * chunks, zstandard.ZstdDecompressor(), []
    for n, *lengths in index.tolist():
        rows = np.zeros((4, n), "u1")
        for r, size in zip(rows, lengths):
            if size:
                r[:] = np.frombuffer(z.decompress(content[at : at + size]), "u1")
                at += size
        out.append(np.ascontiguousarray(rows.T).view("<u4").ravel())
    return [None if x else int(d) for d, x in zip(keys, nulls)], sizes, np.concatenate(out) if out else np.zeros(0, "<u4")


def _encode(frames: Iterator[pd.DataFrame], path: str, end_id: int | None, file_ids: int) -> Iterator[pd.DataFrame]:
    part, seq, start, n = TaskContext.get().partitionId(), 0, 0, 0
    keys: list = []
    ids: list[bytes] = []

    def out() -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "seq": [seq], "path": [f"part-{part:05d}-{seq:05d}.mrp"], "start_in_part": [start], "n_docs": [len(keys)], "n_tokens": [n], "content": [pack(keys, ids)]})

    for frame in frames:
        for lo in range(0, len(frame), 256):
            some = frame.iloc[lo : lo + 256]
            for key, x in zip(some["doc_id"], encoder(path).batch(["" if t is None else t for t in some["text"]], end_id)):
                keys.append(None if pd.isna(key) else int(key))
                ids.append(x)
                n += len(x) // 4
                if n >= file_ids:
                    yield out()
                    keys, ids, seq, start, n = [], [], seq + 1, start + n, 0
    if keys:
        yield out()


def write_files(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs and write them in the file format: part, seq, path, start_in_part, n_docs, n_tokens, content.

    Files are rows of a Parquet table in the shared folder, since a Python worker can't write to every store that Spark
    can; `content` is a whole file, and export() writes files out where a local folder will do. Order: ascending doc_id, null
    first, equal ids by the text's hash. A null text is an empty one. Documents are range-partitioned, so a hot doc_id is
    split by its texts. No rows give no files. Other columns are ignored.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = "part int, seq int, path string, start_in_part long, n_docs int, n_tokens long, content binary"
    return keep(rows.mapInPandas(lambda it: _encode(it, path, end_id, file_ids), schema), "token-files", "uncompressed")


def _decode(frames: Iterator[pd.DataFrame], before: dict[int, int]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, start, content in zip(frame["part"], frame["start_in_part"], frame["content"]):
            keys, sizes, ids = unpack(content)
            ends = np.cumsum(sizes, dtype="i8")
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
            yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": ends - sizes + start + before[part], "n_tokens": sizes.astype("i8"), "ids_crc32": crc})


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files' bytes."""
    before, total = {}, 0
    for part, n in files.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # a row a partition
        before[part], total = total, total + n
    return files.select("part", "start_in_part", "content").mapInPandas(lambda it: _decode(it, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> int:
    """Write the files into a folder that the driver can open, one at a time."""
    n = 0
    for row in files.select("path", "content").toLocalIterator():
        with open(f"{folder}/{row.path}", "wb") as f:
            f.write(row.content)
        n += 1
    return n


def op2_token_planes(spark, sf_dir):
    return read_files(write_files(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {"op2_token_planes": op2_token_planes}
ORACLES: dict[str, str] = {}
