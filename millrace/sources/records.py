"""Record files to DataFrames with a stable position, and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, on any file system that Spark reads; raises if none does."""
    for p in paths:
        if _exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_records(spark: SparkSession, path: str, schema: StructType | str, bad: str = "skip", missing_ok: bool = False) -> DataFrame:
    """A JSON array, a single object or JSON lines as rows of schema, with pos (order in the file).

    bad: 'skip' drops lines that don't parse, 'keep' returns them with the text in _corrupt, 'fail' raises naming the
    first. Array elements and lines that aren't objects are dropped. A missing path raises, or gives no rows if missing_ok.
    Lines stay distributed; only a file that is one JSON value is read whole, as it has no lines to split at.
    """
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        if missing_ok:
            return empty.withColumn("pos", F.lit(None).cast("long")).limit(0)
        raise FileNotFoundError(path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos")).where(F.trim("value") != "")
    start = lines.orderBy("pos").limit(1).collect()
    opens = start and start[0].value.lstrip()[:1]
    whole = spark.read.text(path, wholetext=True) if opens and (opens == "[" or (opens == "{" and not lines.where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()).limit(1).count())) else None
    if whole is not None:
        parsed = whole.select(F.try_parse_json("value").alias("v"), F.col("value").alias("text"))
        if opens == "[" and parsed.where("v is not null").count():
            rows = parsed.select(F.posexplode(F.from_json("text", "array<string>")).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
        else:
            rows = parsed.select(F.col("text").alias("value"), F.lit(0).cast("long").alias("pos"))
    else:
        rows = lines
    names = empty.columns
    rows = rows.withColumn("ok", F.try_parse_json("value").isNotNull())
    if bad == "fail" and (first := rows.where("not ok").orderBy("pos").limit(1).collect()):
        raise ValueError(f"bad JSON record: {first[0].value[:200]}")
    is_object = F.col("value").startswith("{") | F.ltrim("value").startswith("{")
    kept = rows.where((F.col("ok") & is_object) | (F.lit(bad == "keep") & ~F.col("ok")))
    out = kept.select("pos", F.from_json("value", empty.schema).alias("r"), F.when(~F.col("ok"), F.col("value")).alias("_corrupt"))
    return out.select(*(F.col(f"r.{c}").alias(c) for c in names), "pos", *(["_corrupt"] if bad == "keep" else []))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, quotes doubled, line breaks in fields; a BOM goes."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in UTF-8, nulls written; one file only for an export that is known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(df: DataFrame, most: int = 10_000) -> str:
    """A small result as indented JSON; raises if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    return json.dumps([r.asDict(True) for r in rows], ensure_ascii=False, indent=2)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a Markdown table; raises if it has more than `most` rows."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a report")
    rows = [df.columns, ["---"] * len(df.columns), *(["" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in r] for r in found)]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
