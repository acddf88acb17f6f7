"""Boundaries of models: prompts as columns, an injected callable over batches of prompts, and what is done with its answers.

`load` is called once a Python worker and returns a function from a list of prompts to a list of answers. If a batch fails,
its prompts are asked one by one, so only those that fail themselves are left without an answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.functions import values as V
from millrace.operators import agent, rules

Load = Callable[[], Callable[[list[str]], list[str]]]


def filled(template: str, **columns: Column) -> Column:
    """A template with each {name} replaced by a column; what a column says is not searched again."""
    parts, rest = [], template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest), default=(len(rest), None))
        parts.append(F.lit(rest[:at]))
        if name is None:
            break
        parts.append(F.coalesce(columns[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def plain_prompt(instruction: str = "instruction", text: str = "input") -> Column:
    return F.concat_ws("\n", F.coalesce(instruction, F.lit("")), F.coalesce(text, F.lit("")), F.lit(V.PLAIN_PROMPT_END))


def messages(system: str | Column, user: Column) -> Column:
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(one("system", F.lit(system) if isinstance(system, str) else system), one("user", user))


def user_text(instruction: str = "instruction", text: str = "input") -> Column:
    """What the user says to a chat model: the instruction, and the input on a line of its own unless it is empty."""
    said, given = (F.expr(S.normalize(S.SPARK, c)) for c in (instruction, text))
    return F.when(given == "", said).otherwise(F.concat(said, F.lit("\n"), given))


def judge_prompt(text: str = "text") -> Column:
    return filled(V.JUDGE_PROMPT, input=F.col("input"), text=F.col(text))


def agent_judge_prompt(text: str = "text") -> Column:
    return filled(V.AGENT_JUDGE_PROMPT, input=F.col("input"), text=F.col(text))


def rewrite_prompt(comment: str | None = None) -> Column:
    listed = F.when(F.size("issues") > 0, F.array_join(F.transform("issues", lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- No explicit issue")
    return filled(V.REWRITE_PROMPT, input=F.col("input"), text=F.col("text"), issues=listed, comment=F.trim(F.col(comment)) if comment else F.lit(""))


def ask(answer: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Answer or error of each prompt."""
    try:
        got = answer(prompts)
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return [(x, None) for x in got]
    except Exception as e:
        if len(prompts) == 1:
            return [(None, str(e))]
        return [x for p in prompts for x in ask(answer, [p])]


def answers(prompt: Column, load: Load, n: int = 1) -> Column:
    """Array of n structs text, error for each prompt."""

    @F.pandas_udf("array<struct<text:string,error:string>>")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = load()
        for batch in batches:
            got = ask(answer, [p for p in batch for _ in range(n)]) if len(batch) else []
            yield pd.Series([[{"text": t, "error": e} for t, e in got[i * n : (i + 1) * n]] for i in range(len(batch))], dtype="object")

    return asked(prompt)


def predict(df: DataFrame, prompt: Column, load: Load) -> DataFrame:
    """df with prediction: the model's text, normalised; '' where it failed."""
    df = df.withColumn("mo_a", answers(prompt, load)).withColumn("mo_t", F.col("mo_a")[0]["text"])
    return df.withColumn("prediction", F.expr(S.normalize(S.SPARK, "mo_t"))).drop("mo_a", "mo_t")


def sample(df: DataFrame, prompt: Column, load: Load, n: int = 4) -> DataFrame:
    """df with candidates: up to n different texts in the order given, empty and failed ones dropped."""
    df = df.withColumn("mo_a", answers(prompt, load, n))
    texts = F.transform("mo_a", lambda a: F.trim(F.regexp_replace(F.coalesce(a["text"], F.lit("")), "[\\s\\x1c-\\x1f\\x85\\p{Z}]+", " ")))
    return df.withColumn("candidates", F.array_distinct(F.filter(texts, lambda x: x != ""))).drop("mo_a")


def judge_by_model(load: Load, default: int = 3, most: int | None = None):
    """A judge for agent.run() and pairs: scores from the model's JSON, of the rules with judge_error where it failed or gave
    no object, and its issues as 'judge_issue: ...' after those that are there. Rows with pos above `most` stay unjudged."""

    def judge(df: DataFrame) -> DataFrame:
        prompt = agent_judge_prompt() if most is None else F.when(F.col("pos") <= most, agent_judge_prompt())
        known = [c for c in df.columns if c != "issues"]
        df = rules.judge_by_rule(df.withColumn("mo_a", answers(F.coalesce(prompt, F.lit("")), load)[0]))
        raw = F.col("mo_a.text")
        j = F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))
        object_ = F.coalesce(F.schema_of_variant(j).startswith("OBJECT"), F.lit(False))
        error = F.when(F.col("mo_a.error").isNotNull(), F.col("mo_a.error")).when(j.isNotNull() & ~object_, "not an object")
        df = df.withColumns({"mo_j": rules.parse_judgement(raw, default), "judge_error": error, "mo_i": F.when(object_, F.try_variant_get(j, "$.issues", "array<string>")), "judge_comment": F.when(object_, F.try_variant_get(j, "$.comment", "string")), "judge_response": raw})
        said = lambda by, c: F.when(F.lit(True) if most is None else F.col("pos") <= most, F.when(F.col("judge_error").isNull(), F.col(f"mo_j.{by}")).otherwise(F.col(c)))
        df = df.withColumns({**{k: said(k, k) for k in V.JUDGE_KEYS}, "judge_total": said("total", "judge_total")})
        if "issues" in df.columns:
            told = F.transform(F.coalesce("mo_i", F.array().cast("array<string>")), lambda x: F.concat(F.lit("judge_issue: "), x))
            df = df.withColumn("issues", F.array_union("issues", F.when(F.col("judge_error").isNull(), told).otherwise(F.array().cast("array<string>"))))
        return df.select(*known, *(c for c in df.columns if c not in known and not c.startswith("mo_")))

    return judge


def rewrite_by_model(load: Load):
    """A rewriter for agent.run(): the model's text without its lead-ins; the rules' rewrite where it failed or said nothing."""

    def rewrite(df: DataFrame) -> DataFrame:
        comment = "judge_comment" if "judge_comment" in df.columns else None
        df = df.withColumn("mo_a", answers(rewrite_prompt(comment), load)[0]).withColumn("mo_t", F.coalesce("mo_a.text", F.lit("")))
        df = df.withColumn("mo_c", F.expr(agent.clean_rewrite(S.SPARK, "mo_t")))
        ok = F.col("mo_c") != ""
        simple = F.expr(agent.rewrite(S.SPARK, "text", "gone"))
        out = {"source": F.when(ok, "llm_rewrite").otherwise("simple_rewrite_fallback"), "rewritten": F.when(ok, F.col("mo_c")).otherwise(simple), "rewrite_error": F.when(~ok, F.coalesce("mo_a.error", F.lit("empty rewrite output")))}
        return df.withColumns(out).drop("mo_a", "mo_t", "mo_c")

    return rewrite
