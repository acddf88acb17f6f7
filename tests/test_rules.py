"""Golden cases, edge cases and invariants of the operators outside the optional subpackage."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import sql as S
from millrace.functions import values as V
from millrace.operators import agent, clean, convert, evaluate, models, pairs, rules
from millrace.plans import catalogue
from millrace.sources import records
from millrace.streaming import scoring

E = S.SPARK


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(F.expr(expr).alias("r")).first().r


@pytest.mark.parametrize(
    ("content", "formatted"),
    [
        ("类型#裙*版型#宽松*风格#通勤*图案#纯色*裙型#A字裙", "商品属性：类型=裙；版型=宽松；风格=通勤；图案=纯色；裙型=A字裙。"),
        (" 类型#上衣 * 风格#简约 \n* 图案#刺绣 ", "商品属性：类型=上衣；风格=简约；图案=刺绣。"),
        ("类型#裤*异常片段*颜色#黑色*无效#*#缺失key", "商品属性：类型=裤；颜色=黑色。"),
        ("", "商品属性：无。"),
        (None, "商品属性：无。"),
        ("a#1*b#2*a#3#4", "商品属性：a=3#4；b=2。"),
    ],
)
def test_attributes(spark, content, formatted):
    assert one(spark, S.format_attributes(E, S.distinct_pairs(E, S.content_pairs(E, "c"))), c=content) == formatted


def test_text(spark):
    assert one(spark, S.normalize(E, "c"), c=" a　b\x1c\tc\x85 ") == "a b c"
    assert one(spark, S.clean_summary(E, "c"), c="wan全 BRAND 好") == "完全 好"
    assert one(spark, S.attr_values(E, "c"), c="商品属性:a=1;b= ;=3；a=4。.") == ["1", "3", "4"]
    assert one(spark, S.attr(E, "c", "a"), c="a=1；a=；a=2") == "2"
    assert one(spark, S.repeated_phrase(E, "c"), c="好看好看好看") and not one(spark, S.repeated_phrase(E, "c"), c="好看好看")
    assert one(spark, S.frequent_share(E, S.word_list(E, "c")), c="aa bb aa cc aa dd") == 0.5
    assert one(spark, S.repetition(E, S.grams(E, "c")), c="abcabc") == 0.25
    assert one(spark, S.repetition(E, S.grams(E, "c")), c="ab") == 0
    assert one(spark, S.weaken(E, "r", S.attr_values(E, "i")), r="", i="") == V.WEAK_EMPTY
    assert one(spark, agent.clean_rewrite(E, "c"), c=' 改写文案：文案：“好的” ') == "好的"


def test_conflicts(spark):
    rows = [("裙", "", "", "裤子"), ("裙", "", "", "长裙配裤子"), ("", "深色", "", "白色"), ("", "红色", "棉", "绿色真丝"), ("裙", "黑色", "棉", "")]
    df = spark.createDataFrame(rows, "k string, c string, m string, t string")
    got = [r.r for r in df.select(F.expr(S.conflicts(E, "k", "c", "m", "t")).alias("r")).collect()]
    assert got == [["类型疑似冲突: 输入=裙, 文案出现=裤"], ["类型冲突: 输入=裙, 文案出现=裤"], ["颜色冲突: 输入=深色, 文案出现=白色/浅色"], ["颜色冲突: 输入=红色, 文案出现=绿色", "材质冲突: 输入=棉, 文案出现=真丝"], []]


def test_conflicts_are_filtered_once_computed(spark, sf):
    df = catalogue.attr_conflicts(spark, sf)
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 50_000  # a filter that is pushed down writes out 467,000
    assert 0 < df.count() < catalogue.rule_score(spark, sf).count()


def test_score_edges(spark):
    df = spark.createDataFrame([(None, None), ("", ""), ("a=好", "好" * 100), ("a=好", "治疗100%永久")], "input string, text string")
    got = rules.score(df).collect()
    assert [r.total_score for r in got[:2]] == [0.0, 0.0] and got[2].coverage == 1 and got[2].length == 100 and got[2].repetition_ratio == 0.9898
    assert got[3].forbidden_words == ["100%", "永久", "治疗"] and got[3].forbidden_count == 3
    assert rules.score(df.limit(0)).count() == 0


def test_judge(spark):
    raw = ['{"attribute_coverage": "4.9", "compliance": true, "naturalness": 9}', 'so {"attractiveness": -3} it is', "[1]", "", None, '{"compliance": NaN}']
    got = [r.j for r in spark.createDataFrame([(r,) for r in raw], "r string").select(rules.parse_judgement(F.col("r"), 3).alias("j")).collect()]
    assert tuple(got[0]) == (4, 3, 5, 3, 1, 16) and got[1].attractiveness == 1 and all(tuple(g) == (3, 3, 3, 3, 3, 15) for g in got[2:])


def test_order_and_splits(spark):
    df = spark.createDataFrame([(i, i % 3, f"t{i % 4}") for i in range(100)], "pos long, k long, t string")
    assert sorted(r.pos for r in clean.keep_first(df, ["t"]).collect()) == [0, 1, 2, 3]
    assert sorted((r.pos, r.t) for r in clean.keep_last(df.select("pos", "k", "t"), ["k"]).collect()) == [(0, "t3"), (1, "t1"), (2, "t2")]
    assert [r.rn for r in clean.numbered(df, [F.col("pos")], slices=7).orderBy("pos").collect()] == list(range(1, 101))
    split = clean.positional_split(df, [("a", 10), ("b", 30)], F.col("pos")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"a": 10, "b": 20}
    assert clean.hash_split(df, "pos", 0.2).where("split = 'val'").count() == 20
    assert clean.hash_split(df.limit(0), "pos").count() == 0
    assert clean.head(df, 0).count() == 100 and clean.head(df, 0, none_below_one=True).count() == 0 and clean.head(df, 3).count() == 3


def test_numbers_of_many_rows(spark):
    """500,000 rows with a wide column, numbered by a hash order: every number once, the split exact, each time alike."""
    df = spark.range(500_000, numPartitions=7).select(F.col("id").alias("pos"), F.concat(F.lit("x" * 80), F.md5(F.col("id").cast("string"))).alias("text"))
    got = clean.numbered(df.withColumn("h", clean.hash_order("pos")), [F.col("h"), F.col("pos")]).agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first()
    assert tuple(got) == (500_000, 1, 500_000)
    seen = set()
    for _ in range(3):
        val = clean.hash_split(df, "pos", 0.2).where("split = 'val'").agg(F.count("*").alias("n"), F.sum("pos").alias("s")).first()
        seen.add((val.n, val.s))
    assert len(seen) == 1 and seen.pop()[0] == 100_000


def test_scoring_demo(spark):
    """The demo case: values derived by hand from the rules."""
    r = rules.score(spark.createDataFrame([("商品属性：类型=裙；版型=宽松；风格=通勤。", "裙宽松通勤" + "".join(chr(0x5000 + i) for i in range(41)))], "input string, text string")).first()
    assert (r.coverage, r.forbidden_count, r.conflict_count, r.length, r.length_score, r.repetition_ratio, r.total_score) == (1.0, 0, 0, 46, 0.6703, 0.0, 3.0879)


@pytest.mark.parametrize(
    ("total", "coverage", "repetition", "judge", "combined"),
    [(3.0, 1.0, 0.0, 24, 3.176), (3.5, 1.0, 0.0, 24, 3.451), (3.2742, 1.0, 0.0385, 24, 3.31526), (3.5, 1.0, 0.0, 24, 3.451)],
)
def test_combined_scores_of_a_known_trace(spark, total, coverage, repetition, judge, combined):
    df = spark.createDataFrame([(total, coverage, 0, repetition, judge)], "total_score double, coverage double, forbidden_count int, repetition_ratio double, judge_total int")
    assert abs(df.select(rules.combined_for_agent().alias("c")).first().c - combined) < 1e-9


def test_models(spark):
    def load():
        def answer(prompts):
            if "bad" in prompts:
                raise RuntimeError("out of memory")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([(1, "a  b"), (2, "bad"), (3, ""), (4, None)], "id long, p string").coalesce(1)
    assert {r.id: r.prediction for r in models.predict(df, F.coalesce("p", F.lit("")), load).collect()} == {1: "A B", 2: "", 3: "", 4: ""}
    assert {r.id: r.candidates for r in models.sample(df, F.coalesce("p", F.lit("")), load, 3).collect()} == {1: ["A B"], 2: [], 3: [], 4: []}
    assert models.predict(df.limit(0), F.col("p"), load).count() == 0
    assert df.select(models.filled("{x} and {y}{x}", x=F.lit("{y}"), y=F.col("p")).alias("t")).first().t == "{y} and a  b{y}"


def test_agent_with_models(spark):
    df = spark.createDataFrame([(1, "商品属性：类型=裙；颜色=黑色；材质=雪纺；风格=优雅。")], "id long, input string")
    judge = models.judge_by_model(lambda: lambda prompts: ['{"attribute_coverage": 5, "issues": ["x", "x"], "comment": "ok"}'] * len(prompts), most=2)
    editor = models.rewrite_by_model(lambda: lambda prompts: ["改写文案：黑色雪纺裙优雅"] * len(prompts))
    r = agent.run(df, judge, editor).first()
    assert r.trace.endswith("finish") and "judge_issue: x" in r.issues and r.issues.count("judge_issue: x") == 1
    none = agent.finish(df.union(df.select(F.lit(2).cast("long"), "input")), agent.run(df)).collect()
    assert {x.id: x.error for x in none} == {1: None, 2: "no final candidate"} and {x.id for x in none if x.final_copy} == {1}


def test_odd_records(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, " ", "x", "y", "", "out", '{"base": 1}'), (3, "k", "x", "y", "ref", "out", "5")], "pos long, id string, instruction string, input string, reference string, output string, generations string")
    assert [(r.id, r.reference) for r in convert.records(df).orderBy("id").collect()] == [("k", "ref"), ("sample_000001", ""), ("sample_000002", "out")]
    assert [tuple(r) for r in convert.generations(df).orderBy("id").collect()] == [("k", "", "", ""), ("test_000001", "", "", ""), ("test_000002", "1", "", "")]
    assert convert.records(df.limit(0)).count() == 0


def test_pairs_keep_their_promises(spark, sf):
    made = pairs.strict_reason(pairs.negatives(rules.score(pairs.candidates(catalogue.requests(spark, sf).select("id", "input", "reference"), extra=2)))).collect()
    assert made and all(r.chosen != r.rejected for r in made)
    assert len({(r.id, r.rejected_source) for r in made}) == len(made) == len({(r.id, r.rejected) for r in made})
    assert all(r.chosen_score - r.rejected_score >= 0.5 for r in made if r.reason is None)
    counts = catalogue.QUERIES["filter_reason_counts"](spark, sf).collect()
    assert sum(r.n for r in counts) == catalogue.requests(spark, sf).count() and len(counts) == len(V.REASONS) + 1


def test_win_rates(spark):
    rows = [("a",)] * 9 + [("b",)] * 28 + [("tie",)] * 13
    r = evaluate.win_rates(spark.createDataFrame(rows, "winner string")).first()
    assert (r.pct_a, r.pct_b, r.pct_tie, r.pct_win_or_tie) == (18.0, 56.0, 26.0, 82.0)
    with pytest.raises(ValueError):
        evaluate.win_rates(spark.createDataFrame([("c",)], "winner string"))


def test_agent(spark):
    df = spark.createDataFrame([(1, "商品属性：类型=裙；颜色=黑色；材质=雪纺；风格=优雅。"), (2, "")], "id long, input string")
    got = {r.id: r for r in agent.run(df).collect()}
    assert set(got) == {1, 2} and "finish" in got[1].trace and "雪纺" in got[1].text
    assert agent.serve(df, 7).groupBy("id").count().where("count = 7").count() == 2
    with pytest.raises(ValueError):
        agent.serve(df, 11)


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": "1", "b": 2}, 5, {"a": "é"}]))
    (tmp_path / "l.jsonl").write_text('{"a": "1"}\nbroken\n[1]\n\n{"a": "2", "b": 3}\n')
    (tmp_path / "o.json").write_text('{\n "a": "x"\n}')
    read = lambda n, **k: records.read_records(spark, str(tmp_path / n), "a string, b int", **k).orderBy("pos")
    assert [(r.a, r.b) for r in read("a.json").collect()] == [("1", 2), ("é", None)]
    assert [(r.a, r.b) for r in read("l.jsonl").collect()] == [("1", None), ("2", 3)]
    assert [r.a for r in read("o.json").collect()] == ["x"]
    assert [r._corrupt for r in read("l.jsonl", bad="keep").collect()] == [None, "broken", None]
    with pytest.raises(ValueError):
        read("l.jsonl", bad="fail")
    with pytest.raises(FileNotFoundError):
        read("none.json")
    assert read("none.json", missing_ok=True).count() == 0
    (tmp_path / "s.csv").write_text('﻿id,text\n1,"a ""b""\nc"\n')
    assert records.read_csv(spark, str(tmp_path / "s.csv")).first().text == 'a "b"\nc'
    records.write_jsonl(read("a.json"), str(tmp_path / "out"))
    assert records.read_records(spark, str(tmp_path / "out"), "a string, b int").count() == 2
    assert "é" in records.report(read("a.json")) and records.markdown(read("a.json")).startswith("| a | b | pos |")


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a=好", "好" * 80)] * 3, "input string, text string").write.json(str(tmp_path / "in"))
    rows = spark.readStream.schema("input string, text string").json(str(tmp_path / "in"))
    scoring.score_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("coverage = 1").count() == 3


def test_row_ids(spark):
    df = spark.createDataFrame([(7,), (999_999,), (1_000_000,)], "n long")
    assert [r.r for r in df.select(convert.row_id("s", "n").alias("r")).collect()] == ["s_000007", "s_999999", "s_1000000"]
    assert [r.r for r in df.select(convert.row_id("s", "n", cut=True).alias("r")).collect()] == ["s_000007", "s_999999", "s_100000"]


@pytest.mark.parametrize("name", ["convert_records", "eval_ids", "eval_rows", "generations_normalized"])
def test_ids_past_a_million_are_as_in_sql(spark, sf, name, monkeypatch):
    numbered, later = clean.numbered, 999_900
    monkeypatch.setattr(clean, "numbered", lambda df, order, to="rn", **more: numbered(df, order, to, **more).withColumn(to, F.col(to) + later))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    sql = re.sub(r"row_number\(\) over \([^)]*\)", rf"({later} + \g<0>)", catalogue.ORACLES[name])
    assert str(later) in sql
    want = con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in {*catalogue.NAMES, "pages"}:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key)
