"""Structured Streaming forms; each equals its batch replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def floor_counts(blocks: DataFrame) -> DataFrame:
    """Running number and last floor of visible floors of each chat (complete or update mode)."""
    return blocks.where(F.col("role").isin("user", "assistant")).groupBy("chat_key").agg(F.count("*").alias("floors"), F.max("floor").alias("last_floor"))


def windowed_traces(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window, with a watermark for late data."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("w.start", "event_type", "events", "value")


STATE = "last_floor long, pending string"


def summary_trigger(interval: int):
    """For applyInPandasWithState: emits a window of floors once more than `interval` new ones wait."""
    import json

    import pandas as pd

    def step(key, frames, state):
        last, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (-1, [])
        for frame in frames:
            waiting = sorted(set(waiting) | {int(f) for f in frame["floor"] if f > last})
        out = []
        while len(waiting) > interval:
            now, waiting = waiting[:interval], waiting[interval:]
            last = now[-1]
            out.append((key[0], now[0], now[-1]))
        state.update((last, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["chat_key", "first_floor", "last_floor"])

    return step


def summary_windows(blocks: DataFrame, interval: int = 5) -> DataFrame:
    shown = blocks.where(F.col("role").isin("user", "assistant")).select("chat_key", "floor")
    return shown.groupBy("chat_key").applyInPandasWithState(summary_trigger(interval), "chat_key long, first_floor long, last_floor long", STATE, "append", "NoTimeout")


def upsert_once(table: str, key: str):
    """foreachBatch sink: appends the rows whose key the table lacks, so that a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if spark.catalog.tableExists(table):
            new = new.join(spark.table(table).select(key), key, "left_anti")
        new.write.mode("append").saveAsTable(table)

    return write
