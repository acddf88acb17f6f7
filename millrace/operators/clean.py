"""Cleaning, filtering with reasons, order-preserving dedup, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.functions import values as V
from millrace.operators.shared import keep


def with_reason(df: DataFrame, content: str = "content", summary: str = "summary", others: dict = S.CJK, low_ratio: float = 0.6) -> DataFrame:
    """df with clean_summary, attributes ('key=value' array) and reason: the first of V.REASONS that holds, else null.

    The cascade's branches are lazy, cheapest first; n-grams are only made for rows that come so far.
    """
    e = S.SPARK
    df = df.withColumns({"wr_raw": F.expr(S.normalize(e, summary)), "wr_c": F.expr(S.normalize(e, content)), "clean_summary": F.expr(S.clean_summary(e, summary)), "wr_pairs": F.expr(S.content_pairs(e, content))})
    df = df.withColumn("attributes", F.expr(S.distinct_pairs(e, "wr_pairs"))).withColumns({"wr_words": F.expr(S.word_list(e, "clean_summary")), "wr_only": F.expr(S.only(e, "clean_summary", others))})
    n = F.length("clean_summary")
    reason = (
        F.when((F.col("wr_c") == "") | (F.col("clean_summary") == ""), V.REASONS[0]).when(F.col("wr_raw").contains("<UNK>"), V.REASONS[1]).when(~n.between(30, 220), V.REASONS[2])
        .when(F.size("attributes") < 2, V.REASONS[3]).when(F.expr(S.class_ratio(e, "clean_summary", others)) < low_ratio, V.REASONS[4])
        .when(F.expr(S.repeated_phrase(e, "clean_summary")) | (F.expr(S.frequent_share(e, "wr_words")) > 0.35), V.REASONS[5]).when(F.expr(S.repetition(e, S.grams(e, "wr_only"))) > 0.25, V.REASONS[6])
    )
    return df.withColumn("reason", reason).drop("wr_raw", "wr_c", "wr_pairs", "wr_words", "wr_only")


def reason_counts(df: DataFrame, reasons: list[str], passed: str = "passed") -> DataFrame:
    """reason, n for each of reasons and `passed`, zero counts included."""
    got = df.groupBy(F.coalesce("reason", F.lit(passed)).alias("reason")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(r,) for r in [*reasons, passed]], "reason string")
    return all_.join(got, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keep_first(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The first row by pos of each key."""
    w = W.partitionBy(*keys).orderBy(pos)
    return df.withColumn("kf_n", F.row_number().over(w)).where("kf_n = 1").drop("kf_n")


def keep_last(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The last row of each key, at the place of the first: what a dictionary filled in order holds."""
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), pos).alias("r"), F.min(pos).alias("p"))
    return one.select(*(F.col("p").alias(c) if c == pos else F.col(f"r.{c}").alias(c) for c in df.columns))


def numbered(df: DataFrame, order: list[Column], to: str = "rn", slices: int | None = None) -> DataFrame:
    """df with a gapless row number from 1 in a global order, without one task that sees all rows.

    Rows are range-partitioned by the order, sorted and numbered within their slice, and written once to the shared folder:
    range bounds are sampled anew at each evaluation, so both the rows and the sizes of the slices before come from that one
    table. Rows that tie in the whole order get numbers in any order.
    """
    slices = slices or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("nb_id", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumns({"nb_part": F.shiftright("nb_id", 33).cast("int"), "nb_n": F.col("nb_id").bitwiseAND((1 << 33) - 1) + 1}).drop("nb_id"), "numbered")
    sizes = dealt.groupBy("nb_part").agg(F.max("nb_n").alias("nb_size"))  # a row a slice
    before = sizes.select(F.col("nb_part").alias("nb_p"), (F.sum("nb_size").over(W.orderBy("nb_part")) - F.col("nb_size")).alias("nb_before"))
    return dealt.join(F.broadcast(before), F.col("nb_part") == F.col("nb_p")).withColumn(to, F.col("nb_n") + F.col("nb_before")).drop("nb_part", "nb_n", "nb_p", "nb_before")


def positional_split(df: DataFrame, bounds: list[tuple[str, int]], pos: Column) -> DataFrame:
    """split by place in the order of pos: bounds are (name, end), ends exclusive and rising; later rows go."""
    df = numbered(df, [pos])
    split = F.lit(None)
    for name, end in reversed(bounds):
        split = F.when(F.col("rn") <= end, name).otherwise(split)
    return df.withColumn("split", split).where("split is not null")


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def hash_split(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """split 'val' for floor(n * ratio) rows, the first in a seeded hash order, else 'train'. ratio is held to 0 .. 0.9."""
    n = df.count()
    val = int(n * min(0.9, max(0.0, ratio)))
    return numbered(df.withColumn("hs_h", hash_order(key, seed)), [F.col("hs_h"), F.col(key)]).withColumn("split", F.when(F.col("rn") <= val, "val").otherwise("train")).drop("hs_h", "rn")


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, the first in a seeded hash order (top-k, no full sort)."""
    return df.orderBy(hash_order(key, seed), key).limit(k)


def head(df: DataFrame, n: int, pos: str = "pos", none_below_one: bool = False) -> DataFrame:
    """First n rows by pos; n <= 0: all, or none if none_below_one."""
    return df.orderBy(pos).limit(n) if n > 0 else df.limit(0) if none_below_one else df
