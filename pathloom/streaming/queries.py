"""Extraction over a stream, and counts of matches in time windows.

`extract`, `summarise` and `match` of pathloom.operators.documents take streaming DataFrames as they are: they work row by
row and keep no state. What is here adds state and sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.documents import Exprs, extract


def window_counts(docs: DataFrame, exprs: Exprs, time_col: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour", json_col: str = "json") -> DataFrame:
    """Rows (start, end, pattern_id, matches): how many paths each expression matched, by windows of event time.

    Matches later than `late` behind the newest match are dropped by the watermark, and state older than that is freed.
    """
    hits = extract(docs, exprs, json_col, keep=[time_col], which=True, strategy="walk")
    grouped = hits.withWatermark(time_col, late).groupBy(F.window(F.col(time_col), window, slide).alias("w"), "pattern_id")
    return grouped.agg(F.count("*").alias("matches")).select("w.start", "w.end", "pattern_id", "matches")


def write_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", mode: str = "append", once: bool = False, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Start writing a stream to files, each row exactly once across restarts with the same checkpoint folder.

    once: take what is there now and stop.
    """
    writer = df.writeStream.format(form).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if once else writer).start()
