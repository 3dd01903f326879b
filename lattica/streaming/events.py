"""Extensions for streams: windowed counts of events, and basic graph patterns over append-only triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.mapping import TableMap


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum per tumbling window and key; on a stream, events later than ``late`` are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def stream_triples(table: TableMap) -> DataFrame:
    """The triples of a mapped table; of a streaming frame, as they arrive."""
    return table.triples()


def stream_match(triples: DataFrame, static: DataFrame, predicate: str, static_predicate: str) -> DataFrame:
    """``?s predicate ?o . ?o static_predicate ?x``: arriving triples joined with a static graph, which Spark reads once a batch."""
    a = triples.where(F.col("p") == predicate).select("s", "o")
    b = static.where(F.col("p") == static_predicate).select(F.col("s").alias("o"), F.col("o").alias("x"))
    return a.join(b, "o").select("s", "o", "x")
