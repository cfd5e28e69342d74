"""Communities against a plain loop with Dijkstra's rule, over groups of all sizes at once."""

import heapq
import random

import pytest

from hearthledger.operators import communities as C

COLUMNS = "chat_key string, from_key string, to_key string, confidence double"


def plain(edges, weight=0.6):
    """Labels of one group by the rules, one step after another."""
    arcs = {}
    for a, b, conf in edges:
        if a is None or b is None or a == b:
            continue
        for x, y in ((a, b), (b, a)):
            arcs.setdefault(x, {})[y] = min(arcs.get(x, {}).get(y, 1e9), 1 / max(0.05, conf))
    nodes = sorted(arcs)
    if len(nodes) <= 4:
        return {n: nodes[0] for n in nodes}
    degree = {n: len(arcs[n]) for n in nodes}

    def ways(seed):
        far, todo = {seed: 0.0}, [(0.0, seed)]
        while todo:
            d, n = heapq.heappop(todo)
            if d > far[n]:
                continue
            for m, cost in arcs[n].items():
                if (e := round(d + cost, C.DIGITS)) < far.get(m, 1e18):
                    far[m] = e
                    heapq.heappush(todo, (e, m))
        return far

    inf = float("inf")
    k = min(6, max(2, round((len(nodes) / 2) ** 0.5)))
    seeds = [min(nodes, key=lambda n: (-degree[n], n))]
    far = {seeds[0]: ways(seeds[0])}
    while len(seeds) < k and len(seeds) < len(nodes):
        seeds.append(min((n for n in nodes if n not in seeds), key=lambda n: (-min(far[s].get(n, inf) for s in seeds), -degree[n], n)))
        far[seeds[-1]] = ways(seeds[-1])
    seeds.sort()
    members, out = {s: 1 for s in seeds}, {s: s for s in seeds}
    for n in sorted((n for n in nodes if n not in seeds), key=lambda n: (-degree[n], n)):
        best = min(seeds, key=lambda s: (far[s].get(n, inf) + weight * members[s], members[s], s))
        members[best] += 1
        out[n] = best
    return out


def test_against_a_plain_loop(spark):
    rng = random.Random(5)
    groups = {"one": [("a", "b", 0.9)], "loop": [("a", "a", 1.0), ("b", "c", 0.5), ("c", "d", 0.01), (None, "x", 1.0)]}
    for g, (n, m) in {"five": (5, 6), "parts": (30, 26), "wide": (60, 400), "big": (200, 1_500)}.items():
        groups[g] = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice([0.2, 0.5, 0.75, 0.9, 1.0])) for _ in range(m)]
    df = spark.createDataFrame([(g, *e) for g, es in groups.items() for e in es], COLUMNS)
    got = {}
    for r in C.labels(df, "chat_key").collect():
        assert (r.chat_key, r.node) not in got
        got[r.chat_key, r.node] = r.community
    want = {(g, n): label for g, es in groups.items() for n, label in plain(es).items()}
    assert got == want


def test_empty(spark):
    assert C.labels(spark.createDataFrame([], COLUMNS), "chat_key").count() == 0


@pytest.mark.parametrize("n, seeds", [(5, 2), (200, 6)])
def test_number_of_seeds(spark, n, seeds):
    df = spark.createDataFrame([("g", f"n{i:03}", f"n{i // 4:03}", 1.0) for i in range(1, n)], COLUMNS)
    assert C.spread_seeds(C.both_ways(df, "chat_key"), "chat_key")[0].count() == seeds
