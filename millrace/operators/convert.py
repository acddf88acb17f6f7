"""Records brought to one shape: default ids, fallbacks, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.operators import clean


def _plain(c: str) -> Column:
    return F.expr(S.normalize(S.SPARK, c))


def row_id(prefix: str, n: str, cut: bool = False) -> Column:
    """prefix and a row's number in six digits, or in more from a million on. cut: in its first six, as SQL's lpad has it, so
    that ids repeat from a million on."""
    return F.concat(F.lit(f"{prefix}_"), F.lpad(F.col(n).cast("string"), 6, "0")) if cut else F.format_string(f"{prefix}_%06d", n)


def _with_ids(df: DataFrame, prefix: str, pos: str, cut: bool) -> DataFrame:
    """id, or where it is null or empty the prefix and the row's number in the order of pos."""
    df = clean.numbered(df, [F.col(pos)], "cv_n")
    made = row_id(prefix, "cv_n", cut)
    return df.withColumn("id", F.coalesce(F.nullif(_plain("id"), F.lit("")), made)).drop("cv_n")


def records(df: DataFrame, prefix: str = "sample", pos: str = "pos", cut: bool = False) -> DataFrame:
    """id, instruction, input, reference (output where that is null or empty), normalised. cut: see row_id()."""
    df = _with_ids(df, prefix, pos, cut).withColumn("reference", F.coalesce(F.nullif(F.col("reference"), F.lit("")), "output"))
    return df.select("id", *(_plain(c).alias(c) for c in ("instruction", "input", "reference")))


def generations(df: DataFrame, json_col: str = "generations", systems: tuple[str, ...] = ("base", "sft", "dpo"), pos: str = "pos", cut: bool = False) -> DataFrame:
    """id and each system's text from a column of JSON; what isn't an object counts as one without entries. cut: see row_id()."""
    df = _with_ids(df, "test", pos, cut).withColumn("cv_j", F.try_parse_json(json_col))
    df = df.withColumn("cv_o", F.when(F.coalesce(F.schema_of_variant("cv_j").startswith("OBJECT"), F.lit(False)), F.col("cv_j")))
    df = df.withColumns({f"cv_{s}": F.try_variant_get("cv_o", f"$.{s}", "string") for s in systems})
    return df.select("id", *(_plain(f"cv_{s}").alias(s) for s in systems))


def mock_generations(df: DataFrame) -> DataFrame:
    """id, base, sft, dpo: made-up outputs of three systems from input and reference."""
    e = S.SPARK
    df = df.withColumn("cv_v", F.expr(S.attr_values(e, "input", False)))
    made = {"base": S.base_text, "sft": S.sft_text, "dpo": S.dpo_text}
    return df.select("id", *(F.expr(f(e, "reference", "cv_v")).alias(name) for name, f in made.items()))


def eval_rows(df: DataFrame, prefix: str, instruction: str, pos: str = "pos", cut: bool = False) -> DataFrame:
    """id (prefix and number in the order of pos; cut: see row_id()), instruction, input, reference, raw_content."""
    df = clean.numbered(df, [F.col(pos)], "cv_n")
    return df.select(row_id(prefix, "cv_n", cut).alias("id"), F.lit(instruction).alias("instruction"), "input", "reference", F.col("content").alias("raw_content"))
