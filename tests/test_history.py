"""Scenes floor by floor, batches by characters, counts without pairs and directories against plain loops."""

import random

from hearthledger.operators import audits, rollups
from hearthledger.operators import scenes as S


def plain_history(rows):
    out = []
    for chat in sorted({r[0] for r in rows}):
        places, epoch, started, previous, now = [], 0, None, False, {}
        for floor in sorted({r[1] for r in rows if r[0] == chat}):
            told = [(k, v) for ch, f, k, v in rows if (ch, f) == (chat, floor)]
            here = sorted({v for k, v in told if k == "place"})
            moved = previous and bool(here) and here != places
            jump, reset = (any(k == x for k, _ in told) for x in ("time_jump", "reset"))
            if moved or jump or reset:
                epoch, started = epoch + 1, floor
            started = floor if started is None else started
            places = here or places
            enters, exits = ({v for k, v in told if k == x} for x in ("entered", "exited"))
            fresh = any(now.get(o) != "in" for o in enters)
            for o in enters | exits:
                now[o] = "" if o in enters and o in exits else "in" if o in enters else "out"
            reason = "scene_reset" if reset else "time_jump" if jump else "explicit_exit" if exits else "location_change" if moved else "explicit_entry" if fresh else None
            out.append((chat, floor, epoch, started, "|".join(places) or None, sum(x == "in" for x in now.values()), sum(x == "out" for x in now.values()), reason))
            previous = True
    return out


def test_history(spark):
    rng = random.Random(11)
    rows = []
    for chat in range(5):
        for floor in range(30):
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                kind = rng.choice(["place", "place", "entered", "exited", "entered", "time_jump", "reset"] if floor % 4 == 0 else ["place", "entered", "exited"])
                rows.append((chat, floor, kind, rng.choice("abc") if kind != "time_jump" and kind != "reset" else ""))
    df = spark.createDataFrame(rows, "chat_key long, floor long, kind string, value string")
    got = [tuple(r) for r in S.history(df).orderBy("chat_key", "floor").collect()]
    assert got == plain_history(rows)
    assert S.history(df.limit(0)).count() == 0


def test_character_batches(spark):
    rng = random.Random(4)
    rows = [(chat, floor, rng.choice(["user", "assistant", "system"]), "x" * rng.choice([0, 3, 9, 25, 60])) for chat in range(6) for floor in range(40)]
    want = []
    for chat in range(6):
        batch = used = held = 0
        for _, floor, role, text in (r for r in rows if r[0] == chat):
            if role == "system":
                continue
            if held and (used >= 50 or used + len(text) > 50 or held >= 4):
                batch, used, held = batch + 1, 0, 0
            used, held = used + len(text), held + 1
            want.append((chat, floor, batch, used))
    df = spark.createDataFrame(rows, "chat_key long, floor long, role string, content string")
    assert sorted(map(tuple, audits.character_batches(df, 50, 4).collect())) == want


def test_counts_equal_those_of_pairs(spark):
    rng = random.Random(8)
    points = [(rng.randrange(4), rng.randrange(60), i) for i in range(300)]
    spans = [(rng.randrange(5), s := rng.randrange(70), s + rng.randrange(20) if rng.random() < 0.6 else None, i) for i in range(80)]
    p = spark.createDataFrame(points, "chat_key int, floor int, id int")
    s = spark.createDataFrame(spans, "chat_key int, start_floor int, end_floor int, scene_id int")
    want = []
    for chat, start, end, i in spans:
        held = [x for ch, f, x in points if ch == chat and f >= start and (end is None or f <= end)]
        if held:
            want.append((i, len(held), min(held)))
    assert sorted(map(tuple, rollups.counted_in_intervals(p, s, "scene_id", "id").collect())) == sorted(want)
    left = [(i, rng.choices("abcdef", k=rng.randrange(0, 4))) for i in range(60)]
    right = [(i, rng.choices("abcdefg", k=rng.randrange(0, 4))) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, refs array<string>"), spark.createDataFrame(right, "audit_id int, refs array<string>")
    want = [(i, len(own), min(own)) for i, refs in right if (own := [j for j, x in left if set(x) & set(refs)])]
    assert sorted(map(tuple, rollups.counted_sharing(a, b, "refs", "id", "audit_id").collect())) == sorted(want)


def test_work_of_counts_follows_the_input(spark):
    """Ten times the rows of one key give ten times the rows that joins make, not a hundred times."""

    def made(n):
        a = spark.range(n).selectExpr("id", "array('x') as refs")
        met = rollups.counted_sharing(a, a.withColumnRenamed("id", "audit_id"), "refs", "id", "audit_id")
        left = spark.range(n).selectExpr("id as message", "id * 10 as a", "1 as b")
        right = spark.range(n).selectExpr("id as detail", "id * 10 + 5 as a", "1 as b")
        return met.count(), audits.matched_in_turn(left, right, "message", "detail", ["a", "b"]).count()

    assert made(3_000) == (3_000, 3_000)  # nine million pairs if each met each


def test_directory(spark):
    names = [(1, "a", "艾琳", 0.5), (1, "a", "小艾", 0.9), (1, "b", "林川", 1.0), (1, "c", "阿川", 1.0), (2, "d", "叶", 1.0)]
    sources = [(5, 1, "林川来了"), (3, 1, "小艾和林川"), (9, 2, "叶片"), (10, 1, None)]
    n = spark.createDataFrame(names, "chat_key int, owner_id string, name string, confidence double")
    s = spark.createDataFrame(sources, "id int, chat_key int, content string")
    got = sorted((r.chat_key, r.rank, r.owner_id, r.label, r.referenced, r.first_source) for r in S.directory(s, n).collect())
    assert got == [(1, 1, "a", "小艾", True, 3), (1, 2, "b", "林川", True, 3), (1, 3, "c", "阿川", False, None), (2, 1, "d", "叶", False, None)]
