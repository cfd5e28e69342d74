"""Communities of a weighted graph: spread seeds, nearest seed by distance, labels, all by joins of tables of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.cuts import cut, dropped

c = F.col
DIGITS = 9  # of distances; sums that agree to so many are ties
MOST = 6  # seeds of a group


def both_ways(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, other, cost) both ways, the cheapest of parallel edges; cost = 1 / confidence, of 0.05 at least.  Loops and null ends are left out."""
    e = edges.where("from_key <> to_key").select(group, "from_key", "to_key", (1 / F.greatest(F.lit(0.05), "confidence")).alias("cost"))
    flat = e.select(group, F.explode(F.array(F.struct(c("from_key").alias("node"), c("to_key").alias("other")), F.struct(c("to_key").alias("node"), c("from_key").alias("other")))).alias("x"), "cost")
    return flat.groupBy(group, "x.node", "x.other").agg(F.min("cost").alias("cost"))


def distances(arcs: DataFrame, seeds: DataFrame, group: str) -> DataFrame:
    """(group, seed, node, far): the shortest way from each seed to every node that it reaches.

    A round sends on only what became nearer in the round before (Bellman-Ford over a frontier), one equi-join on the node, and writes one table; it
    ends when nothing became nearer.
    """
    way = [group, "seed", "node"]
    state = cut(seeds.select(group, c("node").alias("seed"), "node", F.lit(0.0).alias("far"), F.lit(True).alias("nearer")))
    while not (open_ := state.where("nearer")).isEmpty():
        sent = open_.join(arcs, [group, "node"]).select(group, "seed", c("other").alias("node"), F.round(c("far") + c("cost"), DIGITS).alias("far"), F.lit(None).cast("double").alias("old"))
        best = state.select(*way, "far", c("far").alias("old")).unionByName(sent).groupBy(*way).agg(F.min("far").alias("far"), F.min("old").alias("old"))
        later = cut(best.select(*way, "far", (c("old").isNull() | (c("far") < c("old"))).alias("nearer")))
        dropped(state)
        state = later
    out = state.select(*way, "far")
    out.cut = state.cut
    return out


def spread_seeds(arcs: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, distances): seeds of every group at once: first the node of most edges, then, again and again, the one farthest from all before.

    A group of n nodes has round(sqrt(n / 2)) seeds, two to six; nodes that no seed reaches are farthest.  Ties: more edges, then smaller keys.
    So the loop runs six rounds at most, whatever the number of groups.
    """
    nodes = cut(arcs.groupBy(group, "node").agg(F.count("*").alias("degree")))
    want = nodes.groupBy(group).agg(F.least(F.lit(MOST), F.greatest(F.lit(2), F.round(F.sqrt(F.count("*") / 2)))).cast("int").alias("want"), F.count("*").alias("size"))
    nodes = cut(nodes.join(want.where("size > 4"), group))
    first = nodes.groupBy(group).agg(F.min(F.struct((-c("degree")).alias("d"), "node")).alias("x")).select(group, "x.node")
    seeds = new = cut(first.withColumn("turn", F.lit(1)))
    far = None
    for turn in range(2, MOST + 1):
        more = distances(arcs, new, group)
        if far is not None:
            whole = cut(far.unionByName(more))
            dropped(far)
            dropped(more)
            more = whole
        far = more
        near = far.groupBy(group, "node").agg(F.min("far").alias("far"))
        rest = nodes.where(c("want") >= turn).join(seeds.select(group, "node"), [group, "node"], "left_anti").join(near, [group, "node"], "left")
        best = rest.groupBy(group).agg(F.min(F.struct((-F.coalesce("far", F.lit(float("inf")))).alias("a"), (-c("degree")).alias("b"), "node")).alias("x"))
        new = cut(best.select(group, "x.node", F.lit(turn).alias("turn")))
        if new.isEmpty():
            return seeds, far
        seeds = cut(seeds.unionByName(new))
    return seeds, cut(far.unionByName(distances(arcs, new, group)))


def labels(edges: DataFrame, group: str, weight: float = 0.6) -> DataFrame:
    """(group, node, community): each node's seed; groups of four nodes or fewer are one community, named by their smallest key.

    Nodes take places in order of edges, then key: the nearest seed, where each member that a community has already counts `weight` (ties: fewer
    members, then the smaller seed).  That order is a chain, so a group's nodes stream through one task, sorted, which holds six counts.
    """
    arcs = cut(both_ways(edges, group))
    seeds, far = spread_seeds(arcs, group)
    size = arcs.groupBy(group).agg(F.count_distinct("node").alias("n"), F.min("node").alias("community")).where("n <= 4")
    small = arcs.select(group, "node").distinct().join(size, group).select(group, "node", "community")
    degree = arcs.groupBy(group, "node").agg(F.count("*").alias("degree"))
    names = seeds.groupBy(group).agg(F.array_sort(F.collect_list("node")).alias("seeds"))  # MOST at most, as are a node's ways
    ways = far.groupBy(group, "node").agg(F.map_from_entries(F.collect_list(F.struct("seed", "far"))).alias("ways"))
    rest = degree.join(names, group).where(~F.array_contains("seeds", c("node"))).join(ways, [group, "node"], "left")
    costs = F.transform("seeds", lambda s: F.coalesce(F.element_at("ways", s), F.lit(float("inf"))))
    rows = rest.select(group, "degree", "node", "seeds", costs.alias("costs")).repartition(group).sortWithinPartitions(group, F.desc("degree"), "node")

    def place(batches):
        import pyarrow as pa

        now, members = None, []
        for batch in batches:
            taken = []
            for g, _, _, given, far_ in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != now:
                    now, members = g, [1] * len(given)
                at = min(range(len(given)), key=lambda i: (far_[i] + weight * members[i], members[i], i))
                members[at] += 1
                taken.append(given[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(taken, pa.string())], names=[group, "node", "community"])

    large = rows.mapInArrow(place, f"{group} {dict(arcs.dtypes)[group]}, node string, community string")
    return small.unionByName(large).unionByName(seeds.select(group, "node", c("node").alias("community")))
