"""The copy-writing agent as a bounded plan: parse, generate, score, diagnose, judge, select, rewrite once, finish.

One row a candidate throughout; the only shuffle is the ranking by request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.functions import values as V
from millrace.operators import rules
from millrace.operators.shared import keep


def attributes(e: str, s: str) -> str:
    """'key=value' array of an input; empty keys and values stay; a repeated key keeps its first place and last value."""
    bare = f"replace(replace(trim({s}), '商品属性：', ''), '商品属性:', '')"
    parts = S.split(e, f"replace({S.strip(e, bare, '。；; ')}, ';', '；')", "；")
    some = S.where(e, S.each(e, parts, "x", "trim(x)"), "x", "contains(x, '=')")
    value = S.strip(e, "trim(substr(x, instr(x, '=') + 1))", "。")
    return S.distinct_pairs(e, S.each(e, some, "x", f"trim(substr(x, 1, instr(x, '=') - 1)) || '=' || {value}"))


def lookup(e: str, pairs: str, key: str, default: str = "") -> str:
    found = S.where(e, pairs, "x", f"substr(x, 1, instr(x, '=') - 1) = {S.text(key)}")
    one = f"get({found}, 0)" if e == S.SPARK else f"{found}[1]"
    return f"coalesce(substr({one}, instr({one}, '=') + 1), {S.text(default)})"


def drafts(kind: str, colour: str, material: str, style: str, pattern: str) -> list[str]:
    """The four mock candidates."""
    opt = lambda c, a, b: f"case when {c} <> '' then '{a}' || {c} || '{b}' else '' end"
    first = f"'这款' || {kind} || '整体设计简约耐看' || {opt(colour, '，', '配色更显气质')} || {opt(material, '，', '材质带来舒适穿着体验')} || {opt(style, '，轻松展现', '风格')} || {opt(pattern, '，', '元素丰富视觉层次')} || '，日常搭配也很出彩。'"
    second = f"'这是一款适合多场景穿搭的' || {kind} || '，版型自然大方，能够提升整体造型感，穿着舒适又百搭。'"
    third = f"{kind} || '采用精致设计，兼具实穿性与时尚感。' || {opt(style, '整体呈现', '气质，')} || '让造型更有亮点。'"
    return [first, second, third, f"{first} || '全网第一，必买神级单品。'"]


def missing(e: str, pairs: str, text: str, style: str) -> str:
    """Pairs whose value the text doesn't show; broad types count as shown by their kinds."""
    key, value = "substr(x, 1, instr(x, '=') - 1)", "substr(x, instr(x, '=') + 1)"
    shown = " or ".join(f"(x = {S.text('类型=' + k)} and {S.has_any(text, a)})" for k, a in V.DIAGNOSE_ALIASES.items())
    return S.where(e, pairs, "x", f"{value} <> '' and not contains({text}, {value}) and not ({shown} or (x = '类型=上衣' and {style} <> '' and contains({text}, {style}))) and {key} is not null")


def issues(e: str, gone: str, text: str, colour: str, fixed4) -> str:
    """Ordered issue texts of a scored candidate; gone: missing(); fixed4: SQL of a number with four decimals."""
    parts = [f"case when {S.size(e, gone)} > 0 then 'missing_attributes: ' || {S.join(e, gone, ', ')} end"]
    parts += [f"case when contains({text}, {S.text(w)}) then {S.text('forbidden_word: ' + w)} end" for w in V.AGENT_FORBIDDEN]
    hit = " ".join(f"when contains({text}, {S.text(p)}) then {S.text('unsupported_color_description: input_color=黑色, phrase=' + p)}" for p in V.UNSUPPORTED_COLOURS)
    parts += [f"case when {colour} = '黑色' then case {hit} end end", f"case when coverage < 0.75 then 'low_coverage: ' || {fixed4('coverage')} end"]
    parts += ["case when length < 45 then 'too_short: ' || length end", "case when length > 160 then 'too_long: ' || length end", f"case when repetition_ratio > 0.10 then 'high_repetition: ' || {fixed4('repetition_ratio')} end"]
    return S.where(e, S.array(e, parts), "x", "x is not null")


def rewrite(e: str, text: str, gone: str) -> str:
    """Forbidden words out, missing values but the type's in, long texts cut."""
    t = S.without(text, [S.text(w) for w in V.AGENT_FORBIDDEN])
    values = S.each(e, S.where(e, gone, "x", "not startswith(x, '类型=')" if e == S.SPARK else "not starts_with(x, '类型=')"), "x", "substr(x, instr(x, '=') + 1)")
    joined = S.join(e, values, "、")
    full = f"case when {joined} <> '' then {S.strip(e, t, '。', 'trailing')} || '。同时突出' || {joined} || '等细节，丰富整体卖点。' else {t} end"
    cut = S.strip(e, f"substr({full}, 1, 160)", "，,。", "trailing")
    return f"case when length({full}) > 170 then {cut} || '。' else {full} end"


def fixed4(x: str) -> str:
    return f"format_string('%.4f', {x})"


def generate(requests: DataFrame) -> DataFrame:
    """id, input to candidate rows: candidate_id, pos, source, text and the parsed attributes."""
    df = requests.withColumn("attributes", F.expr(attributes(S.SPARK, "input")))
    df = df.withColumns({f"ag_{i}": F.expr(lookup(S.SPARK, "attributes", k, d)) for i, (k, d) in enumerate((("类型", "单品"), ("颜色", ""), ("材质", ""), ("风格", ""), ("图案", "")))})
    texts = F.array(*(F.expr(t) for t in drafts(*(f"ag_{i}" for i in range(5)))))
    out = df.select("id", "input", "attributes", F.posexplode(texts).alias("pos", "text"))
    return out.select("id", "input", "attributes", (F.col("pos") + 1).alias("pos"), F.format_string("cand_%d", F.col("pos") + 1).alias("candidate_id"), F.lit("mock_generator").alias("source"), "text")


def diagnose(scored: DataFrame) -> DataFrame:
    e = S.SPARK
    df = scored.withColumns({"ag_style": F.expr(lookup(e, "attributes", "衣样式")), "ag_colour": F.expr(lookup(e, "attributes", "颜色"))}).withColumn("gone", F.expr(missing(e, "attributes", "text", "ag_style")))
    return df.withColumn("issues", F.expr(issues(e, "gone", "text", "ag_colour", fixed4))).drop("ag_style", "ag_colour")


def needs_rewrite():
    """Condition on a scored, diagnosed row; judge scores count where they are known."""
    hard = (F.col("forbidden_count") > 0) | (F.col("conflict_count") > 0) | (F.col("coverage") < 0.75) | (F.col("repetition_ratio") > 0.12) | ~F.col("length").between(45, 170)
    judged = F.coalesce(F.col("judge_total"), F.lit(0)) > 0
    low = judged & ((F.col("judge_total") < 20) | (F.col("factual_consistency") < 4) | (F.col("compliance") < 5) | (F.col("attribute_coverage") < 4))
    return hard | low | (F.size(F.filter("issues", lambda x: ~x.startswith("judge_issue:"))) > 0)


def _evaluated(df: DataFrame, judge) -> DataFrame:
    df = judge(diagnose(rules.score(df)))
    return df.withColumn("combined_score", rules.combined_for_agent(rewritten=F.col("source") == "llm_rewrite"))


def _best(df: DataFrame) -> DataFrame:
    w = W.partitionBy("id").orderBy(F.desc("combined_score"), "pos")
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def rewrite_by_rule(df: DataFrame) -> DataFrame:
    """Diagnosed rows with source and rewritten."""
    return df.withColumns({"source": F.lit("rewrite"), "rewritten": F.expr(rewrite(S.SPARK, "text", "gone"))})


def finish(requests: DataFrame, chosen: DataFrame) -> DataFrame:
    """One report a request: final_copy, and an error where no candidate was chosen."""
    got = chosen.select("id", F.col("candidate_id").alias("final_candidate_id"), F.col("text").alias("final_text"), "combined_score", "issues", "source")
    out = requests.select("id", "input").join(got, "id", "left")
    return out.withColumn("final_copy", F.coalesce("final_text", F.lit(""))).withColumn("error", F.when(F.col("final_candidate_id").isNull(), "no final candidate")).drop("final_text")


def run(requests: DataFrame, judge=rules.judge_by_rule, rewriter=rewrite_by_rule) -> DataFrame:
    """One row a request: the candidate chosen, its scores and issues, whether it was rewritten, and the steps taken.

    judge: DataFrame to DataFrame with the five judge scores and judge_total; rewriter: DataFrame to DataFrame with source and
    rewritten (both may be a model's boundary: see models). At most one rewrite, which replaces the best candidate if it
    scores higher, ties to the earlier candidate. The first cycle is evaluated once, into a kept table.
    """
    best = keep(_best(_evaluated(generate(requests.select("id", "input")), judge)), "best")
    again = rewriter(best.where(needs_rewrite()))
    new = again.select("id", "input", "attributes", F.lit(5).alias("pos"), F.concat("candidate_id", F.lit("_rewrite")).alias("candidate_id"), "source", F.col("rewritten").alias("text"))
    both = best.withColumn("was_rewritten", F.lit(False)).unionByName(_evaluated(new, judge).withColumn("was_rewritten", F.lit(True)))
    steps = F.when(F.col("tried"), "parse,generate,rule_evaluate,diagnose,judge,select,rewrite,rule_evaluate,diagnose,judge,select,finish").otherwise("parse,generate,rule_evaluate,diagnose,judge,select,finish")
    out = _best(both.withColumn("tried", F.max("was_rewritten").over(W.partitionBy("id"))))
    return out.withColumn("trace", steps).drop("was_rewritten", "tried")


def api_drafts(kind: str, colour: str, material: str, style: str, extra: str, hint: str) -> list[str]:
    """The endpoint's five templates over its parts; extra, hint: joined values."""
    core = f"case when {colour} || {material} || {kind} = '' then '这款单品' else {colour} || {material} || {kind} end"
    mood = f"case when {style} <> '' then {style} || '风格' else '整体风格' end"
    thing, cloth, tone = (f"case when {c} <> '' then {c} else '{d}' end" for c, d in ((kind, "单品"), (material, "面料"), (colour, "经典")))
    return [
        f"{core} || '清爽百搭，' || {mood} || '耐看不挑人。结合' || {extra} || '的设计思路，日常通勤与休闲场景都能轻松驾驭，上身舒适自然，穿搭省心。'",
        f"'如果你偏爱' || {mood} || '，这款' || {thing} || '会是不错选择。' || {core} || '在视觉上干净利落，同时通过' || {extra} || '增强层次感，既保留实用性，也兼顾时尚感。'",
        f"'从细节到气质都很在线的一款' || {thing} || '，重点突出' || {hint} || '。' || {cloth} || '质感与版型相互平衡，搭配' || {tone} || '色调，日常上身不挑人，轻松穿出利落感。'",
        f"'这款' || {core} || '以' || {hint} || '为灵感，视觉上简洁大方。再加上' || {extra} || '等元素，能够在保持舒适体验的同时，提升整体穿搭质感。'",
        f"'一件真正好搭配的' || {thing} || '，往往在细节上足够克制。这款围绕' || {hint} || '展开设计，' || {mood} || '自然不张扬，日常出门随手搭配就很出彩。'",
    ]


def serve(requests: DataFrame, n: int = 3) -> DataFrame:
    """Online generate, score and rank over rows id, input: every candidate with its rank (1: best), n in 1 .. 10."""
    if not 1 <= n <= 10:
        raise ValueError("n must be in 1 .. 10")
    e = S.SPARK
    df = requests.select("id", "input").withColumn("attributes", F.filter(F.expr(attributes(e, "input")), lambda x: ~x.endswith("=")))
    df = df.withColumns({f"ag_{i}": F.expr(lookup(e, "attributes", k)) for i, k in enumerate(("类型", "颜色", "材质", "风格"))})
    value = lambda x: F.regexp_replace(x, "^[^=]*=", "")
    named = F.array(*(F.lit(k) for k in ("类型", "材质", "颜色", "风格")))
    joined = lambda a, d: F.when(F.size(a) > 0, F.array_join(F.slice(F.transform(a, value), 1, 3), "、")).otherwise(d)
    df = df.withColumns({"ag_x": joined(F.filter("attributes", lambda x: ~F.array_contains(named, F.substring_index(x, "=", 1))), "版型与细节"), "ag_h": joined(F.col("attributes"), "核心卖点")})
    made = [F.expr(t) for t in api_drafts("ag_0", "ag_1", "ag_2", "ag_3", "ag_x", "ag_h")]
    core = "case when ag_1 || ag_2 || ag_0 = '' then '这款单品' else ag_1 || ag_2 || ag_0 end"
    filler = F.expr(f"'这款' || {core} || '围绕' || ag_h || '进行设计，整体风格自然百搭，兼顾舒适与实用，能够满足通勤和日常休闲等多种场景需求。'")
    rows = df.select("id", "input", F.posexplode(F.array(*(made + [filler] * max(0, n - len(made))))).alias("pos", "text"))
    if n < len(made):
        order = W.partitionBy("id").orderBy(F.md5(F.concat(F.lit("42-"), F.col("id").cast("string"), F.lit("-"), F.col("pos").cast("string"))))
        rows = rows.withColumn("ag_n", F.row_number().over(order)).where(F.col("ag_n") <= n).drop("ag_n")
    out = rules.score(rows)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("total_score"), "pos")))


def clean_rewrite(e: str, s: str) -> str:
    """A model's rewrite without its lead-ins and quotes."""
    t = S.normalize(e, s)
    for p in V.REWRITE_PREFIXES:
        t = f"case when substr({t}, 1, {len(p)}) = {S.text(p)} then trim(substr({t}, {len(p) + 1})) else {t} end" if e == S.DUCK else f"trim(regexp_replace({t}, '^{p}', ''))"
    return S.strip(e, t, "“”\"' ")
