"""Summaries, comparisons, audit sheets and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.operators import clean, rules


def summary(scored: DataFrame, systems: list[str] | None = None, by: str = "system", length_digits: int = 4) -> DataFrame:
    """Averages of the rounded metrics of each system; systems without rows get zeros if named."""
    out = scored.groupBy(by).agg(F.count("*").alias("num_samples"), *(F.bround(F.avg(c), d).alias(f"avg_{c}") for c, d in (("coverage", 4), ("forbidden_count", 4), ("repetition_ratio", 4), ("length", length_digits), ("total_score", 4))))
    if systems is None:
        return out
    all_ = scored.sparkSession.createDataFrame([(s,) for s in systems], f"{by} string")
    return all_.join(out, by, "left").na.fill(0)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Counts of a column, '' and null as 'unknown', most frequent first, then by name."""
    return df.groupBy(F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("unknown")).alias(col)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def length_stats(df: DataFrame, col: str) -> DataFrame:
    n = F.length(F.expr(S.normalize(S.SPARK, col)))
    return df.agg(F.coalesce(F.bround(F.avg(n), 2), F.lit(0.0)).alias("avg_len"), F.coalesce(F.min(n), F.lit(0)).alias("min_len"), F.coalesce(F.max(n), F.lit(0)).alias("max_len"))


def missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.expr(S.normalize(S.SPARK, c)) == "").alias(f"missing_{c}") for c in cols))


def score_report(pairs: DataFrame) -> DataFrame:
    """Average chosen and rejected score and how many pairs are abnormal; scores that aren't numbers are passed over."""
    a, b = F.col("chosen_score").try_cast("double"), F.col("rejected_score").try_cast("double")
    return pairs.agg(F.bround(F.avg(a), 4).alias("avg_chosen"), F.bround(F.avg(b), 4).alias("avg_rejected"), F.count_if(a <= b).alias("abnormal"), F.count("*").alias("n"))


def compare(systems: dict[str, DataFrame], key: str = "id", pos: str = "pos", n: int | None = None, preview: int = 500) -> DataFrame:
    """Inner join of the systems' predictions by id, in the first one's order; a repeated id counts with its last row."""
    out = None
    for name, df in systems.items():
        one = clean.keep_last(df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(key, pos, "prediction"), [key], pos)
        one = one.select(key, *([pos] if out is None else []), F.expr(S.shorten(S.normalize(S.SPARK, "prediction"), preview)).alias(name))
        out = one if out is None else out.join(one, key)
    out = out.orderBy(pos)
    return out.limit(n) if n else out


def audit_sheet(a: DataFrame, b: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k ids that both systems have (null: 'None'), drawn by hash, with both predictions and empty winner and reason."""
    named = lambda df: df.select(F.coalesce(F.col("id").cast("string"), F.lit("None")).alias("id"), *(c for c in ("pos",) if c in df.columns), "prediction")
    # a repeated id counts with its last row
    ident = lambda df, n: clean.keep_last(named(df), ["id"], "pos" if "pos" in df.columns else "prediction").select("id", F.col("prediction").alias(n))
    both = ident(a, "a_prediction").join(ident(b, "b_prediction"), "id")
    return clean.hash_sample(both, "id", k, seed).orderBy("id").withColumns({"winner": F.lit(""), "reason": F.lit("")})


def as_text(col: str):
    """A column as text, null as ''."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def inspect_pairs(pairs: DataFrame) -> DataFrame:
    """Counts over pairs (input, chosen, rejected, chosen_score, rejected_score): all, equal texts, forbidden words in either,
    the share of rejected ones with any, and pairs not in order. A score that is missing is computed by the rules."""
    rows = pairs
    for side in ("chosen", "rejected"):
        rows = rules.score(rows.withColumns({"ip_text": F.col(side), "ip_stored": F.col(f"{side}_score")}), "input", "ip_text")
        rows = rows.withColumns({f"ip_{side}": F.coalesce(F.col("ip_stored").try_cast("double"), "total_score"), f"ip_{side}_bad": F.col("forbidden_count") > 0})
        rows = rows.drop(*rules.METRICS, "ip_text", "ip_stored")
    n = F.count("*")
    bad = F.count_if("ip_rejected_bad")
    return rows.agg(
        n.alias("n"), F.count_if(F.col("chosen") == F.col("rejected")).alias("same_text"), F.count_if("ip_chosen_bad").alias("chosen_forbidden"), bad.alias("rejected_forbidden"),
        F.coalesce(F.bround(bad / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("rejected_forbidden_ratio"), F.count_if(F.col("ip_chosen") <= F.col("ip_rejected")).alias("abnormal"),
    )


def win_rates(sheet: DataFrame, labels: tuple[str, ...] = ("a", "b", "tie")) -> DataFrame:
    """Counts and percentages of each winner label, and b's win or tie; raises with the first rows that have another label."""
    w = F.lower(F.trim("winner"))
    if bad := sheet.where(~F.coalesce(w.isin(*labels), F.lit(False))).limit(10).collect():
        raise ValueError(f"winner not in {labels}: {bad}")
    n = F.count("*")
    pct = lambda c: F.coalesce(F.round(100 * c / F.nullif(n, F.lit(0)), 2), F.lit(0.0))
    return sheet.agg(n.alias("n"), *(F.count_if(w == x).alias(f"n_{x}") for x in labels), *(pct(F.count_if(w == x)).alias(f"pct_{x}") for x in labels), pct(F.count_if(w.isin(labels[1], labels[2]))).alias("pct_win_or_tie"))


def key_frequency(df: DataFrame, json_col: str, top: int = 2) -> DataFrame:
    """The most frequent keys of JSON objects, ties by name."""
    keys = df.select(F.explode(F.json_object_keys(json_col)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
