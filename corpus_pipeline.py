"""documents -> quality filter -> near-dedup -> removal of repeats -> mixture -> packed sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. ORACLE_SQL is None: SQL can't
express the classifier, the suffix arrays or the tokenizer; tests hold near_dedup and the operators below the stages
against brute-force versions, not the other stages or run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, simhash, suffixes
from millrace.llm.common import keep, table
from millrace.operators.shared import mark, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS, NEAR_LIKENESS, NEAR_BITS = 5, 0.8, 11


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least its threshold)."""
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), carry=rest)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: of the smallest doc_id (a null one only where there is no other), and of the
    smallest text_hash among that doc_id's texts in the group. Groups are of texts, so rows that share a doc_id, or have none, stay
    if their texts aren't near copies."""
    groups = simhash.like_groups(docs, words=NEAR_WORDS, least=NEAR_LIKENESS, bits=NEAR_BITS)
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_head")))
    kept = keep(heads.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count("*").alias("n")), "heads")
    hashed = docs.select(*COLUMNS, simhash.text_hash().alias("text_hash"))
    of = lambda some: hashed.join(some, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    # only rows that repeat both id and text need another shuffle
    out = of(kept.where("n = 1")).union(of(kept.where("n > 1")).dropDuplicates(["text_hash"]))
    return out.select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur more than once; what then has no text goes."""
    out = suffixes.remove_repeats(docs, carry=("lang", "source"), with_text=True)
    text = F.col("kept_text")
    return out.where((F.col("n_removed") == 0) | (F.trim(text) != "")).select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights by repeating or leaving out documents, in shuffled order."""
    return mixing.mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = keep(stage(spark, docs, sf_dir), name)
        release(since)
    return STAGES[-1][1](spark, docs, sf_dir)
