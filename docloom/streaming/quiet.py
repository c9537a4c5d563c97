"""Streams of events: bursts ended by a quiet period, last writes, running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, first_ts, last_ts, n): events of a user less than `gap` apart. Works on tables and on streams; a stream needs `late`, how long late events are waited for.

    The last burst of a stream comes out in update or complete mode, or once a later event has closed it.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return out.drop("w")


def progress(steps: DataFrame, most: float = 0.95) -> DataFrame:
    """Running share of work done per run, at most `most`. steps: (run_id, step, weight)."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("done", F.least(F.lit(most), F.sum("weight").over(w)))
