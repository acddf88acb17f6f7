"""Rule scoring over a stream: the operators are row-local, so a streaming DataFrame goes through the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators import rules


def score_stream(rows: DataFrame, path: str, checkpoint: str, input_col: str = "input", text_col: str = "text") -> StreamingQuery:
    """Append scored rows to Parquet as they come; a restart goes on from the checkpoint."""
    return rules.score(rows, input_col, text_col).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
