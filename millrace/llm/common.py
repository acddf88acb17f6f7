"""Shared helpers: tables in the shared folder and streams of whole groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.shared import keep, shared_dir  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand Python workers batches of at most `most` bytes (one row, if longer): rows that hold whole
    texts or packed groups would else fill 64 MB a batch, a copy in the JVM and several in the worker."""
    was = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, was) if was is not None else spark.conf.unset(ARROW_BYTES)


def trimmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """frames; at their end the worker, which other stages use again, returns what it has freed to the system."""
    yield from frames
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(frames: Iterator[pd.DataFrame], key: str, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, regrouped so that no key spans two of them; each has at least `rows` rows but the last."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        last = frame[key].iloc[-1]
        if held[0][key].iloc[0] == last:
            continue
        both = pd.concat(held, ignore_index=True)
        cut = int((both[key].to_numpy() != last).nonzero()[0][-1]) + 1
        yield both.iloc[:cut].reset_index(drop=True)
        held, n = [both.iloc[cut:].reset_index(drop=True)], len(both) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
