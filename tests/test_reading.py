"""Literal cases of reading queries, names and sources, and brute force where there is no SQL."""

import random

from pyspark.sql import functions as F

from hearthledger.operators import audits, planning, retrieval
from hearthledger.operators import entities as E
from hearthledger.plans import planning as asked


def test_intents(spark):
    rows = [
        (1, "艾琳和林川是什么关系", ["艾琳", "林川"], "relationship"),
        (2, "林川知不知道密码", ["林川"], "actor_knowledge"),
        (3, "艾琳现在的位置", ["艾琳"], "actor_entity"),
        (4, "防护服的作用", [], "world_knowledge"),
        (5, "接下来应该怎么行动", [], "scene_action"),
        (6, "最早发生了什么", [], "timeline"),
        (7, "魔法是什么", [], "world_knowledge"),
        (8, "你好", [], "general"),
        (9, None, [], "general"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id long, query string, named array<string>")
    got = {r.id: r for r in planning.plan(df, "id", "query", "named").collect()}
    assert {k: r.intent_kind for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert got[1].kinds == "relationship,world_rule" and got[5].kinds == "event,commitment,goal" and got[3].temporal == "current" and got[9].parts == 0


def test_parts_of_queries(spark):
    df = spark.createDataFrame([(1, "a是谁？b在哪；c"), (2, "天气，今天为什么变冷"), (3, "苹果，梨"), (4, "  "), (5, "？")], "id long, query string")
    got = {}
    for r in planning.sub_queries(df, "id", "query").orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r["query"])
    assert got == {1: ["a是谁", "b在哪", "c"], 2: ["天气", "今天为什么变冷"], 3: ["苹果，梨"], 5: ["？"]}


def test_quantities(spark):
    said = ["水（可维持约29天份）", "绷带 22个", "罐头 x15", "电池 10包", "大米 2公斤", "旧弓（已丢弃）", "种子（约120株）", "药水 400毫升", "子弹若干"]
    q = E.quantity(F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame([(s,) for s in said], "s string").select(q["amount"], q["unit"], q["precision"], q["operation"]).collect()]
    assert got == [(29, "天份", "approximate", "set"), (22, "个", "exact", "set"), (15, "个", "exact", "set"), (10, "包", "exact", "set"), (2, "kg", "exact", "set"), (None, "", "unknown", "remove"), (120, "株", "approximate", "set"), (400, "ml", "exact", "set"), (None, "", "unknown", "set")]


def test_gists_never_give_the_whole(spark):
    said = ["短", "abc", "first part. 第一句。第二句", "x" * 300, " "]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(E.gist(F.col("s"))).collect()]
    assert got == ["短…", "ab…", "first part…", "x" * 71 + "…", "一段相关记忆"]


def test_chunks_are_whole_characters(spark):
    draw = random.Random(2)
    texts = ["", None, "é" * 7, "a" * 10] + ["".join(draw.choice("aé漢😀") for _ in range(draw.randrange(60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in audits.utf8_chunks(df, "id", "text", 7).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, t in enumerate(texts):
        want, now = [], ""
        for ch in t or "":
            if now and len((now + ch).encode()) > 7:
                want.append(now)
                now = ""
            now += ch
        assert got[i] == [*want, now]


def test_vectors_in_blocks_of_queries(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(900, [0.0] * 6)]
    v = spark.createDataFrame(rows, "fact_id long, embedding array<double>")
    q = v.where("fact_id % 10 = 0").selectExpr("fact_id as query_id", "embedding as vector")
    whole = sorted(map(tuple, retrieval.vector_search(v, q, 7).collect()))
    monkeypatch.setattr(retrieval, "ASKED", 5)
    assert sorted(map(tuple, retrieval.vector_search(v, q, 7).collect())) == whole and len({r[0] for r in whole}) == 30


def test_first_key_that_finds_decides(spark):
    left = spark.createDataFrame([(1, 10, 20), (2, 11, 20), (3, 12, 21)], "l long, a long, b long")
    right = spark.createDataFrame([(7, 10, 20), (8, 10, 5), (9, 99, 20)], "r long, a long, b long")
    assert sorted(map(tuple, audits.matched_in_turn(left, right, "l", "r", ["a", "b"]).collect())) == [(1, 7, 1), (2, 7, 2)]


def test_asked_texts_reach_every_cue():
    import re

    assert [n for n, cue in planning.CUES.items() if not any(re.search(cue, q) for q in asked.ASKED)] == []
