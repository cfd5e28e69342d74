"""The graph of facts: edges are backed facts, searches are joins of a frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.memory import CONFIDENT, GRAPH_KINDS


def edges(facts: DataFrame) -> DataFrame:
    """One edge for each active, backed, confident fact of a graph kind with an object."""
    return facts.where(F.col("kind").isin(GRAPH_KINDS) & (F.col("status") == "active") & (F.col("confidence") >= CONFIDENT) & F.col("evidence") & F.col("object_key").isNotNull()).selectExpr(
        "id as fact_id", "chat_key", "subject_key as from_key", "object_key as to_key", "predicate_key", "kind", "confidence", "updated_at"
    )


def ends(e: DataFrame) -> DataFrame:
    """Both ends of each edge, as rows; a map-side explode, no self-join."""
    return e.select("*", F.explode(F.array("from_key", "to_key")).alias("entity_key"))


def nodes(e: DataFrame) -> DataFrame:
    return ends(e).groupBy("chat_key", "entity_key").agg(
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.count("*").alias("degree"), F.sum("confidence").alias("frequency")
    )


def search(e: DataFrame, seeds: DataFrame, budget: int = 24) -> DataFrame:
    """Two hops from `seeds` (chat_key, entity_key): facts with score = confidence / hop, at most `budget` edges in all.

    Edges are taken by hop, then confidence, recency and id; each edge once.
    """
    order = [F.desc("confidence"), F.desc("updated_at"), F.asc("fact_id")]
    spread = ends(e)
    first = spread.join(seeds, ["chat_key", "entity_key"], "left_semi").drop("entity_key").distinct().orderBy(*order).limit(budget)
    # The first hop holds at most `budget` edges, so these joins are against that many rows.
    frontier = ends(first).select("chat_key", "entity_key").distinct()
    second = spread.join(F.broadcast(frontier), ["chat_key", "entity_key"], "left_semi").drop("entity_key").distinct().join(F.broadcast(first.select("fact_id")), "fact_id", "left_anti")
    both = first.select("fact_id", "confidence", "updated_at", F.lit(1).alias("hop")).unionByName(second.select("fact_id", "confidence", "updated_at", F.lit(2).alias("hop")))
    taken = both.orderBy(F.asc("hop"), *order).limit(budget)
    return taken.select("fact_id", F.col("hop").cast("long").alias("hop"), (F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("confidence"))) / F.col("hop")).alias("score"))


def difference(stored: DataFrame, desired: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What brings `stored` to `desired`: upsert, delete or keep, by key."""
    mark = lambda d, n: d.select(key, F.xxhash64(*columns).alias(n))
    j = mark(stored, "has").join(mark(desired, "wants"), key, "full")
    return j.select(key, F.when(F.col("wants").isNull(), "delete").when(F.col("has").eqNullSafe(F.col("wants")), "keep").otherwise("upsert").alias("action"))
