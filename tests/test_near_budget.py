"""Rows within a budget, left out in tasks before any is exchanged: the same rows as without, and what the query's plan does."""

import random

import pytest
from pyspark.sql import functions as F

from hearthledger.operators import budgets


@pytest.mark.parametrize("waiting", [3, 50, 262_144])
def test_rows_near_a_budget(spark, monkeypatch, waiting):
    monkeypatch.setattr(budgets, "WAITING", waiting)
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), i, float(rng.randrange(40)), rng.choice([None, 0, 1, 3, 9, 60])) for i in range(600)] + [(9, 1, 0.0, 100), (9, 2, 1.0, 1), (10, 1, 0.0, 50), (10, 2, 1.0, 1)]
    df = spark.createDataFrame(rows, "g long, id long, place double, size int").repartition(3)
    stop = lambda d: sorted(map(str, budgets.stopping(d, ["g"], [F.asc("place"), F.asc("id")], "size", 50).collect()))
    some = budgets.near(df, ["g"], ["place", "id"], "size", 50)
    assert stop(some) == stop(df) and some.schema == df.schema
    if waiting > 100:
        assert some.count() < 300
    # The row that goes over the budget stays, and so do rows that tie with it; none behind them does.
    ties = spark.createDataFrame([(1, 7, 0.0, 30), (1, 8, 0.0, 40), (1, 8, 0.0, 1), (1, 9, 0.0, 0)], "g long, id long, place double, size int").coalesce(1)
    assert sorted(r["size"] for r in budgets.near(ties, ["g"], ["place", "id"], "size", 50).collect()) == [1, 30, 40]
    assert budgets.near(df.limit(0), ["g"], ["place", "id"], "size", 50).count() == 0


def test_context_is_cut_before_it_is_exchanged(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["context_up_to_budget"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "order#" in below[below.index("MapInArrow") :].splitlines()[0]  # what the window gets was cut in tasks
