"""Aggregates, pages and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counted_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts by `column`, including values that don't occur."""
    spark: SparkSession = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def known_sums(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sums over known values with their number; a sum of unknown values only is null."""
    return df.groupBy(*by).agg(*(x for c in columns for x in (F.sum(c).alias(c), F.count(c).alias(f"{c}_known"))), F.count("*").alias("calls"))


def p95(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Nearest-rank 95th percentile."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p95"), F.count("*").alias("n"))


def page(df: DataFrame, order: list[str], after: dict | None, limit: int) -> DataFrame:
    """Keyset page: rows after the given key, `limit` (1 to 500) of them."""
    if after:
        parts = [reduce(lambda a, b: a & b, [F.col(o) == after[o] for o in order[:i]] + [F.col(c) > after[c]]) for i, c in enumerate(order)]
        df = df.where(reduce(lambda a, b: a | b, parts))
    return df.orderBy(*order).limit(max(1, min(500, limit)))


def contains(needle: str, *columns: Column) -> Column:
    low = needle.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in columns])


def floor_batches(blocks: DataFrame, per_batch: int = 10, max_chars: int = 16_000) -> DataFrame:
    """Visible user and assistant floors of each chat in batches of `per_batch`; size and token estimate of each."""
    shown = blocks.where(F.col("role").isin("user", "assistant")).groupBy("chat_key", "floor").agg(F.sum(F.length("content")).alias("chars"))
    n = F.row_number().over(Window.partitionBy("chat_key").orderBy("floor")) - 1
    b = shown.withColumn("batch", F.floor(n / per_batch).cast("long"))
    b = b.groupBy("chat_key", "batch").agg(F.min("floor").alias("first_floor"), F.max("floor").alias("last_floor"), F.count("*").alias("floors"), F.sum("chars").alias("chars"))
    return b.withColumn("tokens", F.ceil(F.col("chars") * 0.9).cast("long") + 1200).withColumn("oversize", F.col("chars") > max_chars)


def summary_window(blocks: DataFrame, cursor: int, interval: int = 5, overlap: int = 2) -> DataFrame:
    """Per chat, the floors of the next automatic summary: the first `interval` after the cursor and overlap + 1 before.

    It fires only where more than `interval` floors wait.
    """
    shown = blocks.where(F.col("role").isin("user", "assistant")).select("chat_key", "floor").distinct()
    waiting = shown.where(F.col("floor") > cursor)
    up = F.row_number().over(Window.partitionBy("chat_key").orderBy("floor"))
    new = waiting.withColumn("k", up).withColumn("waiting", F.count("*").over(Window.partitionBy("chat_key"))).where(f"waiting > {interval} and k <= {interval}")
    down = F.row_number().over(Window.partitionBy("chat_key").orderBy(F.desc("floor")))
    old = shown.where(F.col("floor") <= cursor).withColumn("k", down).where(f"k <= {overlap} + 1")
    fired = new.select("chat_key").distinct()
    return new.select("chat_key", "floor", F.lit(True).alias("writable")).unionByName(old.join(fired, "chat_key", "left_semi").select("chat_key", "floor", F.lit(False).alias("writable")))


def repair_groups(rejections: DataFrame) -> DataFrame:
    """Rejections of one item as one record."""
    return rejections.groupBy("job_id", "request_id", "batch", "collection", "item").agg(
        F.count("*").alias("rejections"), F.max("attempts").alias("attempts"), F.array_join(F.sort_array(F.collect_set("source_ref")), ",").alias("sources"), F.min("collection_rank").alias("collection_rank")
    )


def repair_blockers(queue: DataFrame) -> DataFrame:
    """Whether a waiting record of a lower collection, with a source in common, must go first: lowest rank per source, no self-join of groups."""
    open_ = queue.where("status <> 'resolved'")
    least = open_.groupBy("job_id", "source_ref").agg(F.min("collection_rank").alias("least"))
    return open_.join(least, ["job_id", "source_ref"]).select("id", F.col("least") < F.col("collection_rank"), "attempts", "status").toDF("id", "blocked", "attempts", "status")


def intervals_holding(points: DataFrame, intervals: DataFrame, width: int = 16) -> DataFrame:
    """Points (chat_key, floor) in intervals (start_floor, end_floor, open if null), by buckets of `width` floors.

    Bounded intervals are spread over the buckets that they meet, so the join is an equi-join; an open one is joined by
    chat alone, below its start.
    """
    bounded = intervals.where("end_floor is not null").withColumn("bucket", F.explode(F.expr(f"sequence(floor(start_floor / {width}), floor(end_floor / {width}))")))
    p = points.withColumn("bucket", F.expr(f"floor(floor / {width})"))
    shut = p.join(bounded, ["chat_key", "bucket"]).where("floor between start_floor and end_floor").drop("bucket")
    free = points.join(intervals.where("end_floor is null"), "chat_key").where("floor >= start_floor")
    return shut.unionByName(free)


def sharing_items(left: DataFrame, right: DataFrame, items: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs whose arrays overlap: explode both, equi-join on the item, once per pair."""
    a, b = left.select(left_id, F.explode(items).alias("item")), right.select(right_id, F.explode(items).alias("item"))
    return a.join(b, "item").select(left_id, right_id).distinct()


def counted_in_intervals(points: DataFrame, intervals: DataFrame, key: str, point: str, width: int = 16) -> DataFrame:
    """(key, n, first): how many points an interval holds and the smallest `point`; intervals without points are left out.

    Bounded intervals meet points by buckets.  Open ones need no pairs: points and starts of a chat in one order, from the last floor down, and a
    running count and minimum, after points came down to one row a floor.
    """
    bounded = intervals_holding(points, intervals.where("end_floor is not null"), width).groupBy(key).agg(F.count("*").alias("n"), F.min(point).alias("first"))
    none = F.lit(None).cast(dict(intervals.dtypes)[key])
    floors = points.groupBy("chat_key", "floor").agg(F.count("*").alias("n"), F.min(point).alias("first")).withColumn(key, none)
    starts = intervals.where("end_floor is null").select("chat_key", F.col("start_floor").alias("floor"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(dict(points.dtypes)[point]).alias("first"), key)
    down = Window.partitionBy("chat_key").orderBy(F.desc("floor"))  # of equal floors all count
    open_ = floors.unionByName(starts).withColumns({"n": F.sum("n").over(down), "first": F.min("first").over(down)})
    return bounded.unionByName(open_.where(F.col(key).isNotNull() & (F.col("n") > 0)).select(key, "n", "first"))


def counted_sharing(left: DataFrame, right: DataFrame, items: str, left_id: str, right_id: str) -> DataFrame:
    """(right_id, n, first) of rows of `right` that share an item with rows of `left`: how many, and the smallest.

    Rows of equal items are one class, on either side; classes meet by item, once a pair, and each row of `left` is in one class only.
    Rows that repeat an id count once each.
    """
    a = left.select(F.array_sort(F.array_distinct(items)).alias("own"), left_id).groupBy("own").agg(F.count("*").alias("n"), F.min(left_id).alias("first"))
    r = right.select(F.array_sort(F.array_distinct(items)).alias("theirs"), right_id)
    b = r.select("theirs").distinct()
    met = a.select("own", F.explode("own").alias("item")).join(b.select("theirs", F.explode("theirs").alias("item")), "item").select("own", "theirs").distinct()
    sums = met.join(a, "own").groupBy("theirs").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return r.join(sums, "theirs").select(right_id, "n", "first")
