"""Queries over communities of graphs."""

from __future__ import annotations

from hearthledger import ship
from hearthledger.operators import communities as C
from hearthledger.plans.catalogue import query, read


@query()
def graph_communities(spark, sf_dir):
    """Communities of who deals in what, a graph for each way of return; tests hold labels against a plain loop."""
    ship(spark)
    e = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag as chat_key", "concat('s', l_suppkey % 40) as from_key", "concat('p', l_partkey % 60) as to_key", "l_discount * 10 as confidence")
    return C.labels(e, "chat_key")
