"""Tables written once into the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one under a local master; elsewhere raises,
    as executors would each write to a folder of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is then left to its owner
        pass


def _drop_all() -> None:
    for spark, path in _written:
        drop(spark, path)


atexit.register(_drop_all)


def keep(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def where_computed(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows of df where condition holds on its columns as computed once. A plain filter is pushed below the projections that
    make them, each of their steps written out in it wherever it is used; one over a generator's rows stays where it is."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("wc_row")).select("wc_row.*").where(condition)


def mark() -> int:
    """A point to release() from."""
    return len(_written)


def release(since: int) -> None:
    """Drop the tables kept since mark(), but the last one, which no longer needs them."""
    for spark, path in _written[since:-1]:
        drop(spark, path)
    del _written[since:-1]
