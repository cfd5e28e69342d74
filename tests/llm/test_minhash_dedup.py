import re

import numpy as np
import pytest

from hearthledger.llm import minhash_dedup as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data, width=4, percent=80):
    sets = {}
    for d, t in data:
        w = WORDS.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def corpus():
    rng = np.random.default_rng(7)
    base = [[f"w{x}" for x in rng.integers(0, 500, rng.integers(30, 90))] for _ in range(25)]
    out = []
    for k, words in enumerate(base):
        for j in range(k % 6 + 1):
            copy = list(words)
            for _ in range(j % 4):
                copy[rng.integers(len(copy))] = "new" + str(rng.integers(1000))
            out.append(" ".join(copy))
    out += ["", None, "one", "One", "two words", " \t ", "A b C d e f g", "a B c D e f g"]
    return [(int(i) * 3, t) for i, t in zip(rng.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("family", [M.FAMILY_SHINGLES, 150])
def test_against_all_pairs(spark, monkeypatch, family):
    monkeypatch.setattr(M, "FAMILY_SHINGLES", family)
    data = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, component_id int, band string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.components(df).collect())
    assert got == brute(data)


def test_deduplicated_keeps_columns_and_singles(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (3, None, 7), (None, "a b c d e f g", 8)], "doc_id long, text string, root int")
    got = M.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(r.root for r in got.collect()) == [5, 7, 8]


def test_connected_joins_long_chains(spark):
    n = 400
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(1000, 1001)], "a long, b long").repartition(8)
    got = dict(tuple(r) for r in M.connected(edges).collect())
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("hub", [M.HUB, 3])
def test_connected_joins_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(M, "HUB", hub)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500, int(b)) for b in range(600, 900)] + [(501, int(b)) for b in range(880, 1200)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(tuple(r) for r in M.connected(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect())
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_links_of_thousands_of_documents(spark):
    rng = np.random.default_rng(12)
    data = []
    for k in range(900):
        words = [f"w{x}" for x in rng.integers(0, 4000, rng.integers(25, 120))]
        for j in range(int(rng.integers(1, 5))):
            copy = list(words)
            for _ in range(int(rng.integers(0, max(1, len(words) // 28)))):
                copy[rng.integers(len(copy))] = f"n{rng.integers(10_000)}"
            data.append((len(data), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in M.components(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in ((d, t.split()) for d, t in data)}
    by, links = {}, 0
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for a, b in {(a, b) for ds in by.values() for i, b in enumerate(ds) for a in ds[:i]}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            links += 1
            assert got[a] == got[b]
    assert len(data) > 2000 and links > 500


def test_empty_table(spark):
    assert M.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
