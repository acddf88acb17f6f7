"""Rule metrics of (input, text) rows as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import sql as S

METRICS = ["coverage", "forbidden_count", "forbidden_words", "conflicts", "conflict_count", "repetition_ratio", "length", "length_score", "total_score"]


def segments(input_col: str = "input"):
    """An input's 'key=value' segments, for rows that are exploded before they are scored."""
    return F.expr(S.attr_segments(S.SPARK, input_col))


def score(df: DataFrame, input_col: str = "input", text_col: str = "text", others: dict = S.CJK, parsed: str | None = None) -> DataFrame:
    """df with the nine rule metrics as columns. others: regex of the characters outside the class that is counted; parsed:
    a column with the input's segments(), which is then dropped.

    Narrow: no shuffle. Each step is a projection of its own, so that values used several times are computed once.
    """
    e = S.SPARK
    df = df.withColumns({"rs_t": F.expr(S.normalize(e, text_col)), "rs_s": F.col(parsed) if parsed else segments(input_col)})
    df = df.drop(parsed) if parsed else df
    df = df.withColumns({f"rs_{i}": F.expr(S.segment_value(e, "rs_s", k)) for i, k in enumerate(("类型", "颜色", "材质"))})
    df = df.withColumns({"rs_v": F.expr(S.segment_values(e, "rs_s")), "rs_c": F.expr(S.only(e, "rs_t", others))})
    df = df.withColumns({"rs_g": F.expr(S.grams(e, "rs_c")), "rs_n": F.length("rs_c"), "rs_cov": F.expr(S.coverage(e, "rs_v", "rs_t")), "forbidden_words": F.expr(S.forbidden(e, "rs_t")), "conflicts": F.expr(S.conflicts(e, "rs_0", "rs_1", "rs_2", "rs_t"))})
    df = df.withColumns({"rs_rep": F.expr(S.repetition(e, "rs_g")), "rs_len": F.expr(S.length_score("rs_n")), "forbidden_count": F.size("forbidden_words"), "conflict_count": F.size("conflicts")})
    total = F.expr(S.total_score("rs_cov", "rs_len", "rs_rep", "forbidden_count", "conflict_count"))
    out = {"coverage": F.bround("rs_cov", 4), "repetition_ratio": F.bround("rs_rep", 4), "length": F.col("rs_n"), "length_score": F.bround("rs_len", 4), "total_score": F.bround(total, 4)}
    return df.withColumns(out).drop(*(c for c in df.columns if c.startswith("rs_")))


def keep_by_rule(shortest: int = 30, longest: int = 180, forbidden: int = 0, repetition: float = 0.12):
    """Flag of a scored row."""
    return F.col("length").between(shortest, longest) & (F.col("forbidden_count") <= forbidden) & (F.col("repetition_ratio") <= repetition)


def judge_by_rule(df: DataFrame) -> DataFrame:
    """df, scored, with the five judge scores that the rules alone give, and judge_total."""
    cov, forb = F.col("coverage"), F.col("forbidden_count")
    scores = {
        "attribute_coverage": F.when(cov >= 0.95, 5).when(cov >= 0.75, 4).when(cov >= 0.5, 3).otherwise(2),
        "factual_consistency": F.when((cov >= 0.75) & (forb == 0), 5).otherwise(3),
        "naturalness": F.when(F.col("repetition_ratio") > 0.1, 3).otherwise(4),
        "attractiveness": F.when(F.col("length").between(55, 130), 4).otherwise(3),
        "compliance": F.when(forb > 0, 1).otherwise(5),
    }
    return df.withColumns(scores).withColumn("judge_total", sum((F.col(k) for k in scores), F.lit(0)))


def parse_judgement(raw, default: int = 1):
    """Five clipped scores and their total from a model's text: whole JSON, else its widest {...}; bad values: default."""
    j = F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))

    def one(k: str):
        d = F.try_variant_get(j, f"$.{k}", "double")
        ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
        return F.when(ok, F.greatest(F.lit(1.0), F.least(F.lit(5.0), d)).cast("int")).otherwise(default).alias(k)

    from millrace.functions.values import JUDGE_KEYS

    got = [one(k) for k in JUDGE_KEYS]
    return F.struct(*got, sum(got[1:], got[0]).alias("total"))


def combined_for_pairs():
    """The pair builder's score of a judged row."""
    return 0.45 * F.col("total_score") + 0.35 * F.col("judge_total") / 5 + 0.20 * F.col("coverage") * 5 - 0.50 * F.col("forbidden_count") - 1.00 * F.col("repetition_ratio")


def combined_for_agent(judged=None, rewritten=None):
    """The agent's score; judged, rewritten: conditions (default: judge_total is known; never)."""
    judged = F.col("judge_total").isNotNull() if judged is None else judged
    t, c, f, r = F.col("total_score"), F.col("coverage"), F.col("forbidden_count"), F.col("repetition_ratio")
    full = 0.55 * t + 0.35 * (F.col("judge_total") / 25 * 3.5) + 0.10 * c * 3.5 - 0.50 * f - 0.30 * r
    rule = 0.70 * t + 0.25 * c * 3.5 - 0.40 * f - 0.50 * r
    return F.when(judged, full).otherwise(rule) + (F.when(rewritten, 0.005).otherwise(0.0) if rewritten is not None else 0.0)
