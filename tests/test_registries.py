"""Provisional persons from proposal to known owner, chains of merges, and numbered references."""

import random

from hearthledger.operators import registries as R

PROPOSALS, SOURCES = "scope int, name string, aliases array<string>", "scope int, version int, content string"


def histories(spark, proposals, sources, moments):
    edits = R.provisional_edits(spark.createDataFrame(proposals, PROPOSALS), spark.createDataFrame(sources, SOURCES))
    return {(r.scope, r.moment, r.alias): (r.owner_id.split(":")[0], r.root.split(":")[0], r.confirmed) for r in R.replayed(edits, moments).collect()}


def test_a_proposed_person_becomes_known(spark):
    proposals = [(1, "穿着红衣的女子", None), (2, "店主", ["老板"]), (2, "车夫", []), (3, "林川", []), (4, "无人", [])]
    sources = [
        (1, 1, "一名红衣女子走来"), (1, 2, "她说：我叫艾琳。"),  # known without words of description
        (2, 1, "老板在"), (2, 2, "车夫也在"), (2, 3, "我叫老王。"),  # two wait: nobody can tell
        (3, 1, "林川来了"), (3, 2, "我的名字是“林川”"),
        (4, 1, "我叫叶一。"), (4, 2, None),
    ]
    got = histories(spark, proposals, sources, [3, 8, 20])
    assert got == {
        (1, 3, "穿着红衣的女子"): ("provisional", "provisional", False), (1, 8, "穿着红衣的女子"): ("provisional", "actor", True), (1, 20, "穿着红衣的女子"): ("provisional", "actor", True),
        (1, 8, "艾琳"): ("actor", "actor", True), (1, 20, "艾琳"): ("actor", "actor", True),
        (2, 3, "店主"): ("provisional", "provisional", False), (2, 8, "店主"): ("provisional", "provisional", False), (2, 20, "店主"): ("provisional", "provisional", False),
        (2, 8, "车夫"): ("provisional", "provisional", False), (2, 20, "车夫"): ("provisional", "provisional", False),
        (3, 3, "林川"): ("provisional", "provisional", False), (3, 8, "林川"): ("provisional", "provisional", True), (3, 20, "林川"): ("provisional", "provisional", True),
    }


def test_roots_of_long_chains_and_circles(spark):
    rng = random.Random(6)
    parents = {(s, f"n{i:03}"): f"n{rng.randrange(90):03}" for s in range(4) for i in rng.sample(range(90), 70)}
    parents |= {(9, f"n{i:03}"): f"n{i + 1:03}" for i in range(200)}

    def root(s, n):
        way = [n]
        while (nxt := parents.get((s, way[-1]))) is not None:
            if nxt in way:
                return min(way[way.index(nxt) :])
            way.append(nxt)
        return way[-1]

    df = spark.createDataFrame([(s, 1, n, p) for (s, n), p in parents.items()], "scope int, moment int, owner_id string, parent string")
    assert {(r.scope, r.owner_id): r.root for r in R.roots(df).collect()} == {(s, n): root(s, n) for s, n in parents}
    assert R.roots(df.limit(0)).count() == 0


def test_prefetched_references(spark):
    known = [(1, "actor", i, [f"name{i}!", ""], i % 3) for i in range(1, 80)] + [(1, "location", 5, ["HALL"], 0), (2, "actor", 1, ["name1!"], 0), (1, "item", 7, [], 0)]
    text = " ".join(f"name{i}!" for i in range(1, 80) if i % 10)
    k = spark.createDataFrame(known, "chat_key int, kind string, id int, names array<string>, place int")
    s = spark.createDataFrame([(1, text), (1, "in the hall"), (1, None), (3, text)], "chat_key int, content string")
    got = {(r.kind, r.id): r.reference for r in R.prefetched(s, k).collect()}
    first = sorted((i for i in range(1, 80) if i % 10), key=lambda i: (i % 3, i))[:50]
    assert got == {("actor", i): f"A{n:02}" for n, i in enumerate(first, 1)} | {("location", 5): "L01"}
