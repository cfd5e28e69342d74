"""Rows within a budget, in order: up to the first that doesn't fit, or passing over those that don't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger import ship

c = F.col
WAITING = 262_144  # rows that a task gathers before it looks which it can leave out


def stopping(rows: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, up to the first that goes over the budget; `used` is their running size.  A null size is 0."""
    used = F.sum(F.coalesce(size, F.lit(0))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used.cast("long")).where(c("used") <= budget)


def near(rows: DataFrame, by: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """`rows` without those that ``stopping`` can do without: each task exchanges a budget's worth of a group, and the row that goes over it.

    `order` names columns that hold no null, smallest first; sizes are 0 or more, a null size is 0.  A task leaves out a row if those before it (in
    its order, ties aside) go over the budget; these stay, so whatever comes after the row, in any task, still goes over it.
    """
    ship(rows.sparkSession)

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= WAITING:
                held = _within(pa.Table.from_batches(held), by, order, size, budget).to_batches()
                waiting = sum(b.num_rows for b in held)
                if 2 * waiting > WAITING:  # many groups or small sizes: what is left goes on as it is
                    yield from held
                    held, waiting = [], 0
        if held:
            yield from _within(pa.Table.from_batches(held), by, order, size, budget).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _within(rows: pa.Table, by: list[str], order: list[str], size: str, budget: int) -> pa.Table:
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return rows
    groups = [pc.fill_null(rows[b].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for b in by]
    values = [rows[o].to_numpy() for o in order]
    at = np.lexsort([*values[::-1], *groups[::-1]])
    begins = lambda xs: np.append(True, np.any([x[at][1:] != x[at][:-1] for x in xs], axis=0))
    sizes = pc.fill_null(rows[size], 0).to_numpy()[at].astype(np.int64)
    before = np.cumsum(sizes) - sizes
    start = lambda begin: before[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
    keep = start(begins(groups + values)) - start(begins(groups)) <= budget
    return rows.take(pa.array(np.sort(at[keep])))


def passing(rows: DataFrame, by: list[str], order: list[str], key: str, size: str, budget: int, pool: int = 120) -> DataFrame:
    """(*by, key, used): rows that fit, in order: one that doesn't is passed over, and smaller ones after it may still fit.

    What is taken depends on what was taken before, which is a fold: over the first `pool` rows of a group by `order` (columns, smallest first),
    the feature's own bound on candidates, as one sorted array a group.  Ties of `order` go by key.  A null size is 0.
    """
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order, key))
    some = rows.withColumn("turn", turn).where(c("turn") <= pool).select(*by, "turn", c(key).alias("key"), F.coalesce(c(size), F.lit(0)).cast("long").alias("size"))
    each = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("turn", "key", "size"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<key: {dict(rows.dtypes)[key]}, used: bigint>>").alias("taken"))

    def step(state: Column, row: Column) -> Column:
        used = state["used"] + row["size"]
        more = F.struct(used.alias("used"), F.concat(state["taken"], F.array(F.struct(row["key"].alias("key"), used.alias("used")))).alias("taken"))
        return F.when(used <= budget, more).otherwise(state)

    taken = F.aggregate("rows", start, step)["taken"]
    return each.select(*by, F.explode(taken).alias("t")).select(*by, c("t.key").alias(key), "t.used")


def last_text(parts: DataFrame, by: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """(*by, text): the last `budget` characters of each group's texts, joined by line ends in order.

    Only texts that reach into the budget, if only by the line end behind them, are gathered: a running size from the end on tells which, so a row holds
    no more than budget plus one text.  Null orders come last.
    """
    size = F.length(F.coalesce(text, F.lit(""))) + 1
    behind = F.sum(size).over(Window.partitionBy(*by).orderBy(*(F.desc_nulls_first(o) for o in order)).rowsBetween(Window.unboundedPreceding, -1))
    near = parts.withColumn("behind", F.coalesce(behind, F.lit(0))).where(c("behind") <= budget)
    turn = [x for o in order for x in (c(o).isNull().alias(f"no_{o}"), c(o))]
    held = near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*turn, F.coalesce(text, F.lit("")).alias("text")))).alias("texts"))
    return held.select(*by, F.right(F.array_join(F.transform("texts", lambda x: x["text"]), "\n"), F.lit(budget)).alias("text"))
