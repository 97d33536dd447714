"""Streams of events: first events and windowed counts with a watermark, as extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_events(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first event of each key to arrive within the watermark; later repeats are dropped with bounded state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
