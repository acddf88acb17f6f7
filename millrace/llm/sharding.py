"""Sharding by minimax contiguous partition over groups of equal texts.

Texts fall into ATOMS buckets by the first hex digits of their MD5, so equal texts share one. The ordered bucket sizes,
never more than ATOMS, are all that the driver sees: it binary-searches the smallest capacity for which a greedy pass
needs no more than the wanted shards, and cuts there, evening out what the capacity leaves open. So the capacity is the least
over buckets; a bucket holds one 65,536th of the texts. Slots come from counts by slice of a bucket, so that neither a hot
text nor a large shard is numbered in one task; rows that agree in id, size and CRC are counted before any is numbered.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, table

DIGITS, SHARDS, ROW_BYTES, SLICE, RUN = 4, 40, 16, 512, 1 << 16
ATOMS = 16**DIGITS


def needed(sums: list[int], capacity: int, start: int = 0) -> int:
    """Shards that a greedy pass fills from atom `start` on; sums: prefix sums, from 0. One more than atoms if none fit."""
    n, at, last = 0, start, len(sums) - 1
    while at < last:
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to == at:
            return len(sums)
        at, n = to, n + 1
    return n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which contiguous atoms fit into `shards` shards."""
    if not sizes:
        return 0
    sums = [0, *accumulate(sizes)]
    lo, hi = max(max(sizes), -(-sums[-1] // shards)), sums[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if needed(sums, mid) <= shards else (mid + 1, hi)
    return lo


def _share(sizes: list[int], shards: int) -> float:
    """What an even shard holds once atoms larger than that have shards of their own."""
    big, rest = 0, sum(sizes)
    for s in sorted(sizes, reverse=True):
        if big + 1 >= shards or s * (shards - big) <= rest:
            break
        big, rest = big + 1, rest - s
    return rest / (shards - big)


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Shard of each atom: contiguous, none above the smallest capacity, and as even as that leaves them."""
    capacity, sums = smallest_capacity(sizes, shards), [0, *accumulate(sizes)]
    out, shard, used = [], 0, 0
    even = _share(sizes, shards) if sizes else 0
    for i, s in enumerate(sizes):
        left = shards - shard - 1
        full = used + s > capacity or used > 0 and used + s - even > even - used
        if used and full and left > 0 and needed(sums, capacity, i) <= left:
            shard, used = shard + 1, 0
            even = _share(sizes[i:], left)  # what is over or short is shared by all that follow
        out.append(shard)
        used += s
    return out


def assign(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in a shard), grown_shard (null under this law).

    Size: UTF-8 bytes of the text plus row_bytes; a null text has none, and CRC 0, and groups with the empty text. Equal
    texts share a shard. A bucket above an even share keeps its shard to itself, as far as order allows. Repeated rows and
    rows with a null doc_id are rows like any other; no rows give none; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("int").alias("atom"))
    rows = keep(rows, "sizes")
    found = {r.atom: r for r in rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # ATOMS rows at most
    spark = docs.sparkSession
    atoms = sorted(found)
    placed = cuts([found[a].bytes for a in atoms], shards)
    # rows of a shard's earlier buckets, and slices of a bucket
    plan, before, last = [], 0, -1
    for a, shard in zip(atoms, placed):
        before = before if shard == last else 0
        plan.append((a, shard, before, -(-found[a].n // SLICE)))
        before, last = before + found[a].n, shard
    plan = spark.createDataFrame(plan, "atom int, shard int, before long, slices long")  # ATOMS rows at most
    same = rows.groupBy("atom", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    dealt = same.join(F.broadcast(plan), "atom").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), "slices"))
    dealt = keep(dealt, "dealt")
    counts = dealt.groupBy("atom", "slice").agg(F.sum("n").alias("rows"))
    offsets = counts.select(F.col("atom").alias("atom_"), F.col("slice").alias("slice_"), (F.sum("rows").over(W.partitionBy("atom").orderBy("slice")) - F.col("rows")).alias("offset"))
    within = F.sum("n").over(W.partitionBy("atom", "slice").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    numbered = dealt.withColumn("within", within).join(offsets, (F.col("atom") == F.col("atom_")) & (F.col("slice") == F.col("slice_")))
    numbered = keep(numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("offset") + F.col("within")).alias("first"), "n"), "numbered")
    few = numbered.where(F.col("n") <= RUN)
    # very many equal rows are dealt over tasks in runs
    runs = numbered.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("run")
    runs = runs.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("run") * RUN).alias("first"), F.least(F.col("n") - F.col("run") * RUN, F.lit(RUN).cast("long")).alias("n"))
    each = few.union(runs).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
