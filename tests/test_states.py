"""Patches folded in order against a plain loop; excerpts, budgets, lineage and choices against theirs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hearthledger.operators import budgets, evidence, lineage, proposals, registries, selection, states


def leaves(value, path=()):
    inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    if inner:
        for k, v in inner:
            yield from leaves(v, (*path, str(k)))
    else:
        yield path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def test_leaves(spark):
    texts = ['{"a":{"b":[1,{"c":null}],"d":{}},"e":"x"}', "[]", '"s"', "7", "{", None, "[[[true]]]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: [(tuple(x["path"]), x["value"]) for x in r.l] for r in df.select("id", states.leaves(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(texts):
        try:
            want = list(leaves(json.loads(t)))
        except (ValueError, TypeError):
            want = []
        assert got[i] == want


def test_folded_patches(spark):
    rng = random.Random(1)
    value = lambda d: rng.choice([1, "x", None, {}, [], True]) if d == 0 or rng.random() < 0.4 else {rng.choice("ab"): value(d - 1), "c": value(0)} if rng.random() < 0.6 else [value(d - 1)]
    rows, state = [], {}
    for chat in range(6):
        for seq in range(25):
            ops = [{"op": rng.choice(["add", "replace", "remove", "Remove", "test"]), "path": "/" + "/".join(rng.choices(["a", "b", "c", "0", "x~1y"], k=rng.randrange(1, 4))), "value": value(2)} for _ in range(rng.randrange(0, 3))]
            rows.append((chat, seq, json.dumps(ops) if seq % 9 else "no patch"))
            for o in ops if seq % 9 else []:
                if o["op"] == "test":
                    continue
                path = tuple(k.replace("~1", "/") for k in o["path"].split("/") if k)
                held = state.setdefault(chat, {})
                for p in [p for p in held if p[: len(path)] == path]:
                    del held[p]
                if o["op"].lower() != "remove":
                    for p in [p for p in held if path[: len(p)] == p]:
                        del held[p]
                    held.update(leaves(o["value"], path))
    df = spark.createDataFrame(rows, "chat int, seq int, t string")
    got = {(r.chat, tuple(r.path)): r.value for r in states.folded(states.operations(df, "chat", ["seq"], "t"), "chat", ["seq"]).collect()}
    assert got == {(chat, p): v for chat, held in state.items() for p, v in held.items()}
    assert states.folded(states.operations(df.limit(0), "chat", ["seq"], "t"), "chat", ["seq"]).count() == 0


def test_places_of_excerpts_of_any_length(spark):
    texts = ["one two three four five six", "xone two", "a, b! c", "", None, "two two two three four five", "é two three four é"]
    excerpts = ["two", "e t", "one two three four five six", "two three", "two three four", "a, b! c", "wo three four fi", "", None, ", ", "zzz", "one two"]
    s = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    b = spark.createDataFrame(list(enumerate(excerpts)), "item_id int, excerpt string")
    got = sorted((r.item_id, r.doc_id, r.start, r.places) for r in evidence.places(b, s, "item_id", "doc_id").collect())
    assert got == sorted((i, d, t.index(e), t.count(e)) for i, e in enumerate(excerpts) if e for d, t in enumerate(texts) if t and e in t)
    assert evidence.places(b.limit(0), s, "item_id", "doc_id").count() == 0


def test_budgets(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(5), rng.choice([1, 2, 3, 5, 9, 40, None])) for g in range(8) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, id int, place int, size int")
    passed, stopped = [], []
    for g in range(8):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        used = 0
        for _, i, _, size in own:
            if used + (size or 0) <= 20:
                used += size or 0
                passed.append((g, i, used))
        used = 0
        for _, i, _, size in own:
            used += size or 0
            if used > 20:
                break
            stopped.append((g, i, used))
    assert sorted(map(tuple, budgets.passing(df, ["g"], ["place"], "id", "size", 20).select("g", "id", "used").collect())) == sorted(passed)
    assert sorted(map(tuple, budgets.stopping(df, ["g"], [F.asc("place"), F.asc("id")], "size", 20).select("g", "id", "used").collect())) == sorted(stopped)


def test_last_text(spark):
    rows = [(1, i, t) for i, t in enumerate(["aaaa", None, "bb", "c" * 9])] + [(2, 0, "x")]
    got = {r.g: r.text for r in budgets.last_text(spark.createDataFrame(rows, "g int, at int, text string"), ["g"], ["at"], "text", 12).collect()}
    assert got == {1: "aaaa\n\nbb\nccccccccc"[-12:], 2: "x"}


def test_lineage_cuts_circles(spark):
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("b", "d"), ("d", "a"), ("c", None), ("e", "e"), ("d", "f")]
    df = spark.createDataFrame(links, "source string, target string")
    got = sorted((r.start, "".join(r.path), r.closed) for r in lineage.chains(df, spark.createDataFrame([("a",), ("e",), ("z",), (None,), ("a",)], "node string")).collect())
    assert got == [("a", "abc", False), ("a", "abdf", False), ("e", "e", True), ("z", "z", False)]
    assert lineage.chains(df, spark.createDataFrame([], "node string")).count() == 0


def test_registry_merges_splits_and_undoes(spark):
    edits = [
        (1, "discover", "x", " Ann ", None), (2, "discover", "y", "bob", None), (3, "merge", "x", None, "y"), (4, "merge", "y", None, "z"), (5, "confirm", "z", None, None),
        (6, "split", "y", None, None), (7, "undo", "-", None, "6"), (8, "correct", "x", "ANN", "w"), (9, "merge", "z", None, "x"), (10, "undo", "-", None, "8"),
    ]
    df = spark.createDataFrame([(0, *e) for e in edits] + [(None, 1, "discover", "q", "q", None)], "scope int, version int, action string, owner_id string, alias string, target string")
    got = {(r.moment, r.alias): (r.owner_id, r.root, r.confirmed) for r in registries.replayed(df, [0, 1, 3, 4, 6, 7, 8, 10]).collect()}
    assert got == {
        (1, "ann"): ("x", "x", False), (3, "ann"): ("x", "y", False), (3, "bob"): ("y", "y", False), (4, "ann"): ("x", "z", False), (4, "bob"): ("y", "z", False),
        (6, "ann"): ("x", "y", False), (6, "bob"): ("y", "y", False), (7, "ann"): ("x", "z", True), (7, "bob"): ("y", "z", True), (8, "ann"): ("w", "w", False), (8, "bob"): ("y", "z", True),
        (10, "ann"): ("x", "x", False), (10, "bob"): ("y", "x", False),  # x, y and z now go in a circle, for which x stands
    }


def greedy(rows, historical, earliest, items=12):
    rows = sorted(rows, key=lambda r: (-r["score"], -r["updated_at"], r["id"]))[: selection.POOL]
    anchors = [r["id"] for r in rows if r["anchor"]][:3]
    rest = [r for r in rows if not r["anchor"]]
    chosen = []
    fitting = [r for r in rest if r["affinity"] >= 0.8]
    if earliest and fitting:
        chosen.append(min(fitting, key=lambda r: (r["floor"] if r["floor"] is not None else 2**53, -r["score"], r["updated_at"], r["id"]))["id"])
    asked = len(rows[0]["hits"]) if rows else 0
    if historical and asked >= 3:
        chosen += [r["id"] for r in sorted((r for r in rest if r["id"] not in chosen), key=lambda r: (r["updated_at"], r["id"]))][:items]
    elif asked >= 2:
        for i in range(asked):
            free = [r for r in rest if r["id"] not in chosen and r["hits"][i] > 0]
            if free:
                chosen.append(min(free, key=lambda r: (r["updated_at"] if historical else 0, -r["hits"][i], -r["score"], r["id"]))["id"])
    return anchors + [*chosen, *(r["id"] for r in rest if r["id"] not in chosen)][: items - len(anchors)]


def test_diversified_choice(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(40):
        asked, historical, earliest = rng.randrange(0, 6), bool(q % 2), q % 3 == 0
        own = [{"id": i, "score": rng.randrange(9) / 10, "updated_at": rng.randrange(6), "floor": rng.choice([None, 1, 2, 3]), "affinity": rng.choice([0.0, 0.8, 1.0]), "anchor": rng.random() < 0.2, "hits": [rng.choice([0, 0, 1, 2]) for _ in range(asked)]} for i in range(rng.choice([1, 5, 30, 150]))]
        rows += [(q, *r.values(), historical, earliest) for r in own]
        want[q] = greedy(own, historical, earliest)
    df = spark.createDataFrame(rows, "query_id int, id long, score double, updated_at long, floor long, affinity double, anchor boolean, hits array<int>, historical boolean, earliest boolean")
    got = {}
    for r in selection.diversified(df).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


@pytest.mark.parametrize("response, keyword", [("[1]", "type"), ("no json", "type"), (None, "type"), ("{}", "required"), ('{"claims":[]}', "required")])
def test_responses_that_are_none(spark, response, keyword):
    df = spark.createDataFrame([(1, response)], "k int, t string")
    records, wrong = proposals.responses(df, "k", "t")
    assert records.count() == 0
    assert [tuple(r) for r in wrong.collect()] == [(1, "$", keyword)]


def test_verdicts(spark):
    """Literal cases: each record breaks one rule."""
    source = "艾琳走进旧港口，拿起三瓶药水。"
    thing = lambda i, name, span="s1", conf=0.9, **more: {"localId": i, "displayName": name, "aliases": [], "evidenceSpanId": span, "confidence": conf, **more}
    claim = lambda i, content="艾琳走进了旧港口", kind="event", span="s1", subject="a1", **more: {"localId": i, "kind": kind, "predicateKey": "p", "content": content, "evidenceSpanId": span, "confidence": 0.9, "subjectRef": subject, **more}
    whole = {
        "actorCandidates": [thing("a1", "艾琳"), thing("a1", "艾琳"), thing("", "x"), thing("a3", "林川", span="s9"), thing("a4", "艾琳", conf=2), thing("a5", "夏洛特"), thing("a6", "艾琳", span="s2")],
        "locationCandidates": [thing("l1", "旧港口"), thing("a1", "旧港口")],
        "itemCandidates": [thing("i1", "药水"), thing("i2", "绷带"), thing("i3", "x", span="s3")],
        "episodes": [{"localId": "e1", "summary": "艾琳到了港口", "evidenceSpanIds": ["s1"], "participantRefs": ["a1"], "presentRefs": ["world"], "mentionedRefs": []}, {"localId": "e2", "summary": "短", "evidenceSpanIds": ["s1"]}, {"localId": "e3", "summary": "艾琳到了港口", "evidenceSpanIds": []}, {"localId": "e4", "summary": "艾琳到了港口", "evidenceSpanIds": ["s1", "s9"]}],
        "claims": [claim("c1"), claim("c2", kind="rumour"), claim("c3", content="短"), claim("c4", subject="q"), claim("c5", subject="a5"), claim("c6", subject=""), claim("c1")],
        "inventoryOperations": [{"localId": "o1", "itemRef": "i1", "operation": "remove", "precision": "exact", "amount": 3, "evidenceSpanId": "s1", "confidence": 1}],
    }
    df = spark.createDataFrame([(7, json.dumps(whole, ensure_ascii=False))], "k int, t string")
    spans = spark.createDataFrame([(7, "s1", "m1", source), (7, "s2", "m2", source), (7, "s3", "m1", "不在其中")], "k int, span_id string, source_ref string, text string")
    sources = spark.createDataFrame([(7, "m1", source, True), (7, "m2", source, False)], "k int, source_ref string, content string, writable boolean")
    records, _ = proposals.responses(df, "k", "t")
    rows = proposals.with_evidence(proposals.fields(records, "k"), spans, "k")
    got = {}
    for r in proposals.validated(rows, sources, "k").orderBy("rank", "place").collect():
        got.setdefault(r.type, []).append(r.reason)
    assert got == {
        "actor": [None, "duplicate_proposal", "invalid_shape", "schema_validation_failed", "invalid_confidence", None, "invalid_reference"],
        "location": [None, "duplicate_proposal"],
        "item": [None, "excerpt_mismatch", "excerpt_mismatch"],
        "episode": [None, "invalid_shape", "invalid_reference", "schema_validation_failed"],
        "claim": [None, "invalid_enum", "invalid_shape", "invalid_reference", "entity_ref_unsupported", None, "duplicate_proposal"],
        "inventory": [None],
    }
    assert [r.amount for r in rows.where("type = 'inventory'").collect()] == [None]


def test_revisions_whatever_the_order_of_keys(spark):
    texts = ['{"a":1,"b":{"x":[1,2],"y":"z"}}', '{"b": {"y":"z", "x":[1, 2]}, "a":1}', '{"a":1,"b":{"x":[2,1],"y":"z"}}', None, "no json", '{"a":1}', '{"a":"1"}', '{"a":1,"a2":null}']
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, None)], "k int, at int, t string")
    got = [tuple(r) for r in states.revisions(df, "k", "at", "t").orderBy("k", "at").collect()]
    same = [False, True, False, False, True, False, False, False]
    assert got == [(1, i, s, i + 1 - sum(same[: i + 1])) for i, s in enumerate(same)] + [(2, 0, False, 1)]
