import math

import pytest
from pyspark.sql import functions as F

from hearthledger.functions import memory as M
from hearthledger.operators import capture, graph, ledger, owners, retrieval, rollups, temporal
from hearthledger.streaming import summaries


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).collect()[0][0]


def test_tokens_of_latin_and_han(spark):
    assert one(spark, M.tokens(F.col("t")), t="The a x1 foo-bar") == ["the", "x1", "foo-bar"]
    assert one(spark, M.tokens(F.col("t")), t="星图的门") == ["星", "图", "门", "星图"]


def test_keys_and_hashes(spark):
    assert one(spark, M.canonical_key(F.col("a"), F.col("b"), F.col("c")), a=" 艾琳 ", b=" 会　送达 ", c=" STAR MAP ") == "艾琳::会 送达::star map"
    assert one(spark, M.fnv1a(F.col("t")), t="abc") == 0x1A47E90B


def test_record_keys_have_128_bits_and_variants_of_the_nfkc_form(spark):
    import unicodedata

    def key(text):
        parts = []
        for variant in range(4):
            h = 2166136261
            for ch in f"{variant}\0{unicodedata.normalize('NFKC', text)}":
                h = (h ^ ord(ch)) * 16777619 % 2**32
            parts.append(f"{h:08x}")
        return "".join(parts)

    texts = ["abc", "", None, "ﬁn", "fin", "Ａ　星图", "e\u0301", "😀 x", "costarring", "liquid"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r[0]: r[1] for r in df.select("id", M.record_key(F.col("t"))).collect()}
    assert got == {i: None if t is None else key(t) for i, t in enumerate(texts)}
    assert got[3] == got[4] and got[8] != got[9]  # the last two share 32 bits of plain FNV-1a


def test_strength_and_levels(spark):
    s = M.effective_strength(F.lit(80.0), F.lit(100.0), F.lit(0.5), F.lit(2), F.lit(0), now=int(M.MONTH))
    assert one(spark, s) == pytest.approx(80 * math.exp(-1) * 1.08 * 1.075)
    assert [one(spark, M.level(F.lit(x))) for x in (85, 84.9, 45, 25, 0)] == ["exact", "clear", "gist", "fragment", "forgotten"]


def test_affinity(spark):
    assert [one(spark, M.kind_affinity(F.lit(k), ["State"])) for k in ("state", "location", "capability", "event")] == [1.0, 0.8, 0.25, 0.0]
    assert one(spark, M.kind_affinity(F.lit("state"), [])) == 0.0


def test_eligibility_names_the_first_reason(spark):
    rows = [("c", "active", 0.9, True, None, None), ("c", "pending", 0.1, False, None, None), ("c", "active", 0.74, True, None, None), ("c", "active", 0.9, False, None, None), ("c", "active", 0.9, True, 20, None), ("c", "active", 0.9, True, None, 5), ("d", "active", 0.9, True, None, None)]
    df = spark.createDataFrame(rows, "chat_key string, status string, confidence double, evidence boolean, valid_from long, valid_until long")
    assert [r[0] for r in df.select(retrieval.ineligible_reason("c", 10)).collect()] == [None, "status", "confidence", "evidence", "future", "expired", "other_chat"]


def fold(ops):
    now, out = 0.0, []
    for kind, x in ops:
        before = now
        now = x if kind == "set" else now + x if kind == "increase" else max(0.0, now - x)
        out.append((before, now))
    return out


def test_running_amounts_equal_a_fold(spark):
    import random

    draw = random.Random(4)
    ops = [(draw.choice(["set", "increase", "decrease", "decrease"]), float(draw.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(1, 1, i, i, k, x) for i, (k, x) in enumerate(ops)], "chat_key int, item_id int, event_id int, moment int, operation string, amount double")
    got = [(r.before, r.after) for r in ledger.running(df).orderBy("event_id").collect()]
    assert got == fold(ops)


def test_reconciliation(spark):
    f = "id long, chat_key string, subject_key string, predicate_key string, object_key string, kind string, content string, status string, updated_at long, confidence double"
    held = spark.createDataFrame([(1, "c", "s", "p", None, "state", "At  Home", "active", 5, 0.9), (2, "c", "s", "q", None, "goal", "win", "active", 5, 0.9)], f)
    new = spark.createDataFrame([(3, "c", "s", "p", None, "state", "at home", "active", 9, 0.9), (4, "c", "s", "p", None, "state", "away", "active", 9, 0.9), (5, "c", "s", "p", None, "state", "away", "active", 4, 0.9), (6, "c", "s", "q", None, "goal", "lose", "active", 9, 0.9), (7, "c", "t", "p", None, "state", "x", "active", 1, 0.1)], f)
    got = {r.id: r.action for r in temporal.update_plan(temporal.reconcile(held, new)).collect()}
    assert got == {3: "duplicate_noop", 4: "supersede", 5: "pending_review", 6: "append_history", 7: "create"}


def test_graph_search_in_a_cycle(spark):
    rows = [("f-a-b", "c", "A", "B", 0.9, 1), ("f-b-c", "c", "B", "C", 0.9, 1), ("f-c-a", "c", "C", "A", 0.9, 1), ("f-x", "d", "A", "B", 0.9, 1)]
    e = spark.createDataFrame(rows, "fact_id string, chat_key string, from_key string, to_key string, confidence double, updated_at long")
    seeds = spark.createDataFrame([("c", "A")], "chat_key string, entity_key string")
    assert {r.fact_id: r.hop for r in graph.search(e, seeds).collect()} == {"f-a-b": 1, "f-c-a": 1, "f-b-c": 2}
    assert graph.search(e, seeds, 2).count() == 2


def test_permissions(spark):
    ask = lambda p, privacy, kind, anchor=False, learned=0: one(spark, owners.allowed(F.lit(p), F.lit(privacy), F.lit(kind), F.lit(anchor), F.lit(learned), 10))
    assert ask("full", "secret", "event") and not ask("none", "public", "event") and not ask("full", "public", "event", learned=11)
    assert ask("focused", "secret", "goal") and ask("focused", "public", "preference") and not ask("focused", "public", "identity") and ask("focused", "public", "identity", True)
    assert ask("identity_only", "public", "state") and not ask("identity_only", "limited", "state") and not ask("public_only", "private", "goal")


def test_summary_window_of_floors(spark):
    blocks = spark.createDataFrame([("c", f, "user", "x") for f in range(1, 67)] + [("d", f, "user", "x") for f in range(1, 65)], "chat_key string, floor long, role string, content string")
    got = rollups.summary_window(blocks, cursor=60).orderBy("floor").collect()
    assert [(r.floor, r.writable) for r in got] == [(f, f > 60) for f in range(58, 66)]


def test_intervals_and_overlaps_without_nested_loops(spark):
    p = spark.createDataFrame([("c", f, f) for f in range(100)], "chat_key string, floor long, id long")
    s = spark.createDataFrame([("c", 1, 10, 40), ("c", 2, 90, None), ("d", 3, 0, None)], "chat_key string, scene_id long, start_floor long, end_floor long")
    got = sorted((r.scene_id, r.id) for r in rollups.intervals_holding(p, s).collect())
    assert got == [(1, f) for f in range(10, 41)] + [(2, f) for f in range(90, 100)]
    assert "NestedLoop" not in rollups.intervals_holding(p, s)._jdf.queryExecution().toString()


def test_validation(spark):
    ask = lambda **v: one(spark, capture.validation_code({k: F.col(k) for k in v}), **v)
    assert ask(source="a long source", excerpt="long", content="long enough", confidence=0.9) == "ok"
    assert ask(source="a long source", excerpt="short", content="long enough", confidence=0.9) == "excerpt_mismatch"
    assert ask(source="a long source", excerpt="long", content="tiny", confidence=0.9) == "content_length"
    assert ask(source="a long source", excerpt="long", content="long enough", confidence=0.7) == "pending"


def test_fusion(spark):
    one_list = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    other = spark.createDataFrame([(0, "b", 1)], "query_id int, id string, rank int")
    got = {r.id: r.fusion for r in retrieval.fused({"lexical": (one_list, 0.4), "vector": (other, 0.4)}).collect()}
    assert got == {"a": pytest.approx(0.4 / 61), "b": pytest.approx(0.4 / 62 + 0.4 / 61)}


def test_streaming_equals_batch(spark, tmp_path):
    blocks = spark.createDataFrame([(c, f, "user" if f % 2 else "assistant") for c in (1, 2) for f in range(1, 14 + c)], "chat_key long, floor long, role string")
    for i in range(3):
        blocks.where(f"floor between {i * 5 + 1} and {i * 5 + 5}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(blocks.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = summaries.floor_counts(stream).writeStream.outputMode("complete").format("memory").queryName("floors").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(map(tuple, spark.table("floors").collect())) == sorted(map(tuple, summaries.floor_counts(blocks).collect()))


def test_summary_windows_stream(spark, tmp_path):
    blocks = spark.createDataFrame([(1, f, "user") for f in range(1, 13)] + [(2, f, "user") for f in range(1, 5)], "chat_key long, floor long, role string")
    blocks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(blocks.schema).parquet(str(tmp_path / "in"))
    out = summaries.summary_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == [(1, 1, 5), (1, 6, 10)]


def test_appends_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string")
    write = summaries.upsert_once("ledger_once", "id")
    write(rows, 0)
    write(rows, 0)
    assert spark.table("ledger_once").count() == 2
