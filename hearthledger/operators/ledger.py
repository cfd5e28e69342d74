"""Event-sourced quantities: running amounts without a row-by-row fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["chat_key", "item_id"]
ORDER = ["moment", "event_id"]


def running(events: DataFrame) -> DataFrame:
    """before and after of each event; amounts stop at zero.

    A "set" starts a new run.  Within a run, an amount that stops at zero is the running sum less its lowest value so
    far (or zero, if that is lower), so two windows over one sort give the fold's result.
    """
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("run", F.sum((F.col("operation") == "set").cast("long")).over(rows))
    e = e.withColumn("change", F.when(F.col("operation") == "decrease", -F.col("amount")).otherwise(F.col("amount")))
    r = Window.partitionBy(*KEYS, "run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("total", F.sum("change").over(r))
    e = e.withColumn("after", F.col("total") - F.least(F.lit(0.0), F.min("total").over(r)))
    return e.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0.0))).drop("run", "change", "total")


def latest(states: DataFrame) -> DataFrame:
    return states.groupBy(*KEYS).agg(F.max_by("after", F.struct(*ORDER)).alias("amount"), F.count("*").alias("events"))


def changed(states: DataFrame) -> DataFrame:
    """Without events that change nothing."""
    return states.where(~F.col("before").eqNullSafe(F.col("after")))
