"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each shingle is hashed once; the top bits of the hash choose one of BINS bins, which keeps its smallest hash. An empty
bin takes the value of the first filled bin that hashes of (bin, try) lead to, however many tries (optimal densification). The low eight bits of each
bin are stored, eight bins to a long; the share of equal bins is corrected for chance agreement.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Query, partitions, table

WORDS, BINS, BITS, PROBES = 5, 128, 8, 16
SHIFT = 64 - 7
SIGN = -(1 << 63)
SPACE = "[\\x20\\x09-\\x0D]+"


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _mix(x: int) -> int:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & (1 << 64) - 1
    return x ^ x >> 31


@lru_cache
def order(j: int) -> tuple[int, ...]:
    """All bins, as the hashes of (j, try) lead to them first."""
    seen: dict[int, None] = {}
    at = 0
    while len(seen) < BINS:
        seen.setdefault(_mix((j * BINS + 1) * 0x9E3779B97F4A7C15 + at * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) % BINS)
        at += 1
    return tuple(seen)


def _long(bits: int) -> str:
    return "shiftleft(1L, 63)" if bits == 1 << 63 else f"{bits}L"


def _compiled(j: int) -> str:
    """SQL for the value of bin j: its own, or that of the first filled one of its first PROBES; null if none of them is."""
    probes = dict.fromkeys([j, *order(j)[:PROBES]])
    some = " ".join(f"WHEN (mh_m{b // 64} & {_long(1 << b % 64)}) <> 0 THEN {'mh_c + ' * (b >= 64)}bit_count(mh_m{b // 64} & {_long((1 << b % 64) - 1)})" for b in probes)
    return f"get(mh_f, CASE {some} ELSE -1 END)"


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(F.lit(SIGN)), SHIFT).cast("int")


def add_fingerprint(df: DataFrame, text: str, to: str, words: int = WORDS) -> DataFrame:
    """df with `to`: BINS // 8 longs; all zero for a text without words. Fewer than `words` words are one shingle.

    Words are runs of non-space in the lower-cased text. The steps are columns of their own, so that each is computed once.
    An empty bin's first PROBES tries are in compiled code; where all of those are empty, too (few words), the filled bin
    that comes first in the rest of the bin's order is looked up.
    """
    clean = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn("mh_w", F.split(clean, SPACE))
    df = df.withColumn("mh_h", F.transform("mh_w", lambda w: F.xxhash64(w))).withColumn("mh_n", F.when((F.size("mh_w") == 1) & (F.get("mh_w", F.lit(0)) == ""), 0).otherwise(F.size("mh_w"))).drop("mh_w")
    h = F.col("mh_h")
    several = F.transform(F.slice(h, F.lit(1), F.greatest(F.col("mh_n") - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, words))))
    one = F.array(F.xxhash64(h))
    df = df.withColumn("mh_s", F.sort_array(F.when(F.col("mh_n") >= words, several).when(F.col("mh_n") > 0, one).otherwise(F.slice(one, 1, 0)))).drop("mh_h", "mh_n")
    s = F.col("mh_s")
    df = df.withColumn("mh_f", F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))).drop("mh_s")
    f = F.col("mh_f")
    # the filled bins as two words of 64 bits
    half = lambda k: F.aggregate(f, F.lit(0).cast("long"), lambda acc, x: F.when(F.shiftright(_bin(x), 6) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bin(x).bitwiseAND(63)))).otherwise(acc))
    df = df.withColumns({"mh_m0": half(0), "mh_m1": half(1)}).withColumn("mh_c", F.bit_count("mh_m0"))
    compiled = F.expr(f"array({', '.join(map(_compiled, range(BINS)))})")
    # the higher-order function keeps this projection out of one huge method, so that it is compiled in parts
    none = F.transform(F.array_repeat(F.lit(0).cast("long"), BINS), lambda x: x)
    df = df.withColumn("mh_v", F.when(F.size(f) > 0, compiled).otherwise(none)).drop("mh_m0", "mh_m1", "mh_c")
    # place of each bin in the order of bin j, as the j-th string's characters
    ranks = F.array(*(F.lit("".join(chr(order(j).index(b)) for b in range(BINS))) for j in range(BINS)))
    place = lambda j, x: F.ascii(F.substring(F.get(ranks, j), _bin(x) + 1, F.lit(1)))
    later = lambda j: F.get(f, F.array_min(F.transform(f, lambda x, i: place(j, x) * BINS + i)) % BINS)
    df = df.withColumn("mh_v", F.when(F.exists("mh_v", lambda v: v.isNull()), F.transform("mh_v", lambda v, j: F.coalesce(v, later(j)))).otherwise(F.col("mh_v"))).drop("mh_f")
    pack = lambda g: F.aggregate(F.slice("mh_v", g * 8 + 1, F.lit(8)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 8).bitwiseOR(x.bitwiseAND(255)))
    # named twice, the array is not computed anew for each long
    return df.withColumn(to, F.when(F.size("mh_v") > 0, F.transform(_range(BINS // 8), pack))).drop("mh_v")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness of two packed fingerprints, 0 to 1: equal bins, less those equal by chance."""
    fold = lambda z, n, mask: z.bitwiseOR(F.shiftrightunsigned(z, n)).bitwiseAND(F.lit(mask))
    # each byte of x ^ y becomes its lowest bit: 1 if any was set
    unequal = lambda z: F.bit_count(fold(fold(fold(z, 4, 0x0F0F0F0F0F0F0F0F), 2, 0x0303030303030303), 1, 0x0101010101010101))
    equal = F.lit(BINS) - F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))


def as_hex(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, carry: tuple[str, ...], by: str = "doc_id") -> DataFrame:
    """docs with next_<c> of each carried column c: its value in the next row by doc_id, null first (after the last: the first).

    No global window: rows are dealt over ranges of doc_id, bounded by quantiles, and the first row of each range is also
    sent to the range before. Ties go by the text's hash. One shuffle.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    bounds = sorted(set(docs.select(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000)).first()[0] or []))
    some = lambda x: F.array(*(F.lit(b).cast("long") for b in x)).cast("array<bigint>")
    fine, step = some(bounds), max(1, math.isqrt(len(bounds)))
    # how many bounds are at or below an id: every step-th one first, then the step that follows
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col(by)))
    coarse = upto(some(bounds[step - 1 :: step])) * step
    range_ = F.when(F.col(by).isNull(), -1).otherwise(coarse + upto(F.slice(fine, coarse + 1, F.lit(step))))
    key = F.struct(F.col(by).isNotNull().alias("known"), F.col(by).alias("id"), F.xxhash64("text").alias("th"))
    rows = docs.withColumn("nx_key", key).withColumn("nx_range", range_)
    firsts = docs.select(by, "text").withColumn("nx_key", key).withColumn("nx_range", range_)
    first = {r.nx_range: r.k for r in firsts.groupBy("nx_range").agg(F.min("nx_key").alias("k")).collect()}  # n ranges at most
    order = sorted(first)
    before = spark.createDataFrame([(r, first[r].known, first[r].id, first[r].th, order[i - 1]) for i, r in enumerate(order)], "f_range int, f_known boolean, f_id long, f_th long, nx_before int")
    met = rows.join(F.broadcast(before), (F.col("nx_range") == F.col("f_range")) & (F.col("nx_key.known") == F.col("f_known")) & F.col("nx_key.id").eqNullSafe(F.col("f_id")) & (F.col("nx_key.th") == F.col("f_th")), "left")
    here = F.struct(F.col("nx_range").alias("r"), F.lit(False).alias("ghost"))
    place = F.when(F.col("nx_before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("nx_before").alias("r"), F.lit(True).alias("ghost"))))
    dealt = met.withColumn("nx_place", F.explode(place)).select(*docs.columns, "nx_key", F.col("nx_place.r").alias("nx_range"), F.col("nx_place.ghost").alias("nx_ghost"))
    over = W.partitionBy("nx_range").orderBy("nx_ghost", "nx_key")
    out = dealt
    for c in carry:
        out = out.withColumn(f"next_{c}", F.lead(c).over(over))
    return out.where(~F.col("nx_ghost")).drop("nx_key", "nx_range", "nx_ghost")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, ascending doc_id. A null text is an empty one; a text without words has an all-zero fingerprint, like any
    other such text. Repeated rows follow each other; a null doc_id comes first. A single row is its own next. No rows give
    none; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = with_next(add_fingerprint(rows, "text", "fp"), ("text", "fp"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    met = met.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    met = add_fingerprint(met, "edited", "edited_fp")
    return met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op9_minhash(spark, sf_dir):
    return compare_with_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op9_minhash": op9_minhash}
ORACLES: dict[str, str] = {}
