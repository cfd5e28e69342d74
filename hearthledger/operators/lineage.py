"""Lineage: every chain of a graph of links, from its starts to its ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.cuts import cut

c = F.col


def chains(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path, closed): every chain from a start (`starts`: node) along `links` (source, target), once.

    A chain ends where nothing follows, or, `closed`, where all that follows lies on it already: circles are cut before they repeat a node.  A round
    makes all open chains one link longer by one equi-join and sets ended ones aside, so rounds are as many as the longest chain has links.
    """
    links = cut(links.where("source is not null and target is not null").select("source", "target").distinct())
    open_ = cut(starts.where("node is not null").select(c("node").alias("start"), c("node").alias("end"), F.array("node").alias("path")).distinct())
    done = None
    while not open_.isEmpty():
        met = cut(open_.join(links, open_["end"] == links["source"], "left").withColumn("again", F.array_contains("path", c("target"))))
        ends = met.groupBy("start", "path").agg(F.count(F.when(~c("again"), 1)).alias("on"), F.count("target").alias("links")).where("on = 0").select("start", "path", (c("links") > 0).alias("closed"))
        done = ends if done is None else done.unionByName(ends)
        open_ = cut(met.where(~c("again")).select("start", c("target").alias("end"), F.concat("path", F.array("target")).alias("path")))
    return done if done is not None else open_.select("start", "path", F.lit(False).alias("closed"))


def last_stage(paths: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(start, stage, chains): how far each start came: the last of `stages` (name by the prefix of a node's key, in order) that any of its chains reaches."""
    rank = F.lit(0)
    for i, prefix in enumerate(stages, 1):
        rank = F.when(F.exists("path", _begins(prefix)), i).otherwise(rank)
    names = F.array(F.lit("none"), *(F.lit(n) for n in stages.values()))
    return paths.withColumn("rank", rank).groupBy("start").agg(F.max("rank").alias("rank"), F.count("*").alias("chains")).select("start", F.get(names, c("rank")).alias("stage"), "chains")


def _begins(prefix: str):
    return lambda x: F.startswith(x, F.lit(prefix))
