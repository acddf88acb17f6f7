"""Candidates, chosen and rejected texts, preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.functions.values import JUDGE_KEYS
from millrace.operators import rules
from millrace.operators.shared import keep

NEGATIVE_ORDER = ["exaggerated", "generic", "weak"]


def candidates(df: DataFrame, extra: int = 0) -> DataFrame:
    """id, input, reference rows to candidate rows: pos (from 1), source, text; gold, weak, exaggerated, generic, generic_i.
    parsed: the input's segments, found once a prompt, for rules.score()."""
    e = S.SPARK
    df = df.withColumn("parsed", rules.segments("input"))
    df = df.withColumn("cd_v", F.expr(S.attr_values(e, "input", False)))
    made = [("gold", S.normalize(e, "reference")), ("weak", S.weaken(e, "reference", "cd_v")), ("exaggerated", S.exaggerate(e, "reference")), ("generic", S.generic(e, "cd_v"))]
    made += [(f"generic_{i}", S.generic(e, "cd_v")) for i in range(5, 5 + extra)]
    rows = F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.lit(s).alias("source"), F.expr(t).alias("text")) for i, (s, t) in enumerate(made)))
    return df.withColumn("cd_r", F.explode(rows)).select(*(c for c in df.columns if c != "cd_v"), "cd_r.*")


def clear_issue():
    return (F.col("forbidden_count") > 0) | (F.col("conflict_count") > 0) | (F.col("coverage") < 0.55) | (F.col("length_score") < 0.45) | (F.col("repetition_ratio") > 0.2)


def qualified():
    return (F.col("forbidden_count") == 0) & (F.col("conflict_count") == 0) & (F.col("length_score") >= 0.5)


def _tier():
    plain = ~F.col("source").isin("generic", "weak")
    return F.when(qualified() & (F.col("source") == "gold"), 1).when(qualified() & plain, 2).when(plain, 3).otherwise(4)


def pick_chosen(scored: DataFrame, key: str = "id") -> DataFrame:
    """One row a prompt: qualified gold, else qualified and neither generic nor weak, else any such, else any; best first."""
    w = W.partitionBy(key).orderBy("tier", F.desc("total_score"), "pos")
    return scored.where("text <> ''").withColumn("tier", _tier()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def negatives(scored: DataFrame, key: str = "id", least_gap: float = 0.3) -> DataFrame:
    """Up to three pairs a prompt: for each negative source, in order, the lowest candidate that is far below or faulty.

    A text that the chosen one or an earlier source has used is passed over. Scores are computed once and shuffled once: the
    chosen candidate comes by a window over its prompt, and the prompt's few candidates are folded in one array.
    """
    w = W.partitionBy(key).orderBy("tier", F.desc("total_score"), "pos")
    best = F.first(F.struct("text", "source", "total_score")).over(w)
    rows = scored.where("text <> ''").withColumn("tier", _tier()).withColumn("best", best)
    rows = rows.withColumns({"chosen": F.col("best.text"), "chosen_source": F.col("best.source"), "chosen_score": F.col("best.total_score")})
    low = rows.where(F.col("source").isin(*NEGATIVE_ORDER) & (F.col("text") != F.col("chosen")) & ((F.col("chosen_score") - F.col("total_score") >= least_gap) | clear_issue()))
    rank = F.when(F.col("source") == NEGATIVE_ORDER[0], 1).when(F.col("source") == NEGATIVE_ORDER[1], 2).otherwise(3)
    item = F.struct(rank.alias("order"), F.col("total_score").alias("score"), "pos", "source", "text")
    by = low.groupBy(key, "chosen", "chosen_source", "chosen_score", *(c for c in ("input",) if c in scored.columns)).agg(F.sort_array(F.collect_list(item)).alias("items"))
    # sorted by source and score: take the first of a source whose text no earlier source took
    step = lambda acc, x: F.when(F.exists(acc, lambda a: (a["order"] == x["order"]) | (a["text"] == x["text"])), acc).otherwise(F.concat(acc, F.array(x)))
    taken = F.aggregate("items", F.slice("items", 1, 0), step)
    out = by.withColumn("neg", F.explode(taken))
    return out.select(*(c for c in by.columns if c != "items"), F.col("neg.text").alias("rejected"), F.col("neg.source").alias("rejected_source"), F.col("neg.score").alias("rejected_score"))


def strict_reason(pairs: DataFrame, gap: float = 0.5) -> DataFrame:
    """pairs with the first strict reason that holds, or null. chosen_forbidden_count counts as 0 where it isn't there."""
    forb = F.col("chosen_forbidden_count") if "chosen_forbidden_count" in pairs.columns else F.lit(0)
    from millrace.functions.values import PAIR_REASONS as R

    bad = F.col("chosen_source").startswith("generic") | F.col("chosen_source").startswith("weak")
    reason = F.when(F.col("chosen_score") <= F.col("rejected_score"), R[0]).when(F.col("chosen_score") - F.col("rejected_score") < gap, R[1]).when(forb > 0, R[2]).when(F.col("chosen") == F.col("rejected"), R[3]).when(bad, R[4])
    return pairs.withColumn("reason", reason)


RULE_METRICS = ("coverage", "forbidden_count", "repetition_ratio", "length", "total_score")


def _meta(key: str):
    """What a pair's meta column holds of the two candidates."""
    rule = lambda p: F.struct(*(F.col(p + c).alias(c) for c in RULE_METRICS))
    judge = lambda p: F.struct(*(F.col(p + c).alias(c) for c in JUDGE_KEYS), F.col(p + "judge_total").alias("total"))
    return F.struct(
        F.lit("dpo_v2_model_generated_judge").alias("source"), F.col(key).alias("prompt_id"), F.col("best.candidate_id").alias("chosen_candidate_id"), F.col("candidate_id").alias("rejected_candidate_id"),
        F.col("best.combined").alias("chosen_combined_score"), F.col("combined").alias("rejected_combined_score"), (F.col("best.combined") - F.col("combined")).alias("score_gap"),
        rule("best.").alias("chosen_rule_metrics"), rule("").alias("rejected_rule_metrics"), judge("best.").alias("chosen_judge_scores"), judge("").alias("rejected_judge_scores"),
    ).alias("meta")


def trainer_columns(pairs: DataFrame) -> DataFrame:
    """Preference pairs under the names that a trainer reads: prompt, query, chosen, rejected."""
    return pairs.select(F.col("instruction").alias("prompt"), F.col("input").alias("query"), "chosen", "rejected")


def trainer_rows(rows: DataFrame) -> DataFrame:
    """Tuning rows under the names that a trainer reads: prompt, query, response."""
    return rows.select(F.col("instruction").alias("prompt"), F.col("input").alias("query"), F.col("output").alias("response"))


PAIR = ("instruction", "input", "chosen", "rejected")
PAIR_META = (*PAIR, "chosen_source", "rejected_source", "chosen_score", "rejected_score")


def pair_stats(judged: DataFrame, val_ratio: float = 0.15, key: str = "id", **gates) -> DataFrame:
    """Prompts, those with pairs, pairs, and how many go to train and val. Candidates are scored once, into a kept table."""
    judged = keep(judged, "judged")
    got = best_vs_rest(judged, key, **gates).agg(F.count_distinct(key).alias("with_pairs"), F.count("*").alias("n_pairs"))  # one row
    out = judged.agg(F.count_distinct(key).alias("prompts")).join(F.broadcast(got))
    val = F.floor(F.col("n_pairs") * F.lit(val_ratio)).cast("long")
    return out.select("prompts", "with_pairs", "n_pairs", (F.col("n_pairs") - val).alias("n_train"), val.alias("n_val"))


def best_vs_rest(judged: DataFrame, key: str = "id", gap: float = 0.3, judge_gap: int = 2, most: int = 2) -> DataFrame:
    """Pairs of a prompt's best candidate by combined score with others far enough below, `most` at most, the best first."""
    ok = judged.where(F.length(F.expr(S.normalize(S.SPARK, "text"))).between(20, 220)).withColumn("combined", rules.combined_for_pairs())
    w = W.partitionBy(key)
    o = w.orderBy(F.desc("combined"), "pos")
    best = F.first(F.struct("candidate_id", "combined", "judge_total", "text", *RULE_METRICS, *JUDGE_KEYS)).over(o)
    rows = ok.withColumns({"n": F.count("*").over(w), "best": best, "rn": F.row_number().over(o)}).where("n >= 2 and rn > 1")
    gates = (F.col("best.combined") - F.col("combined") >= gap) & (F.col("best.total_score") > F.col("total_score")) & (F.col("best.judge_total") > F.col("judge_total")) & (F.col("best.judge_total") - F.col("judge_total") >= judge_gap)
    out = rows.where(gates).withColumn("k", F.row_number().over(o)).where(F.col("k") <= most)
    return out.select(key, F.concat(key, F.lit("_pair_"), F.col("k")).alias("pair_id"), F.col("best.candidate_id").alias("chosen_id"), F.col("candidate_id").alias("rejected_id"), F.col("best.text").alias("chosen"), F.col("text").alias("rejected"), (F.col("best.combined") - F.col("combined")).alias("score_gap"), _meta(key))
