"""The prefix trie against a plain one, with the odd cases that its docstring defines."""

import collections
import hashlib
import random
import zlib

import pytest

from hearthledger.llm import conversation_trie as T

TURNS = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    """One row per node by the contract, from rows (conv_id, turn, role, text)."""
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {k: [x[2:] for x in sorted(v)] for k, v in said.items()}
    built = {}
    for k, own in seqs.items():
        h = zlib.crc32(str(k).encode()) % 9
        built[k] = seqs.get(k - k % 5, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for k, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(k)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(own) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted(
        (min(own), len(n), min(members[n[:-1]]) if n else -1, len(own), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(k for k in own if len(built[k]) == len(n)))).encode()).hexdigest())
        for n, own in members.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in T.digest(df).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k in range(120):
        if k % 10 == 5:
            continue  # the first of a family may be absent
        for t in range(rng.randrange(1, 12)):
            out.append((k, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é" * 3, ""]) if t else "hi"))
    out += [(200, 0, None, None), (200, None, "user", "first"), (None, 0, "user", "lost"), (201, 3, "b", "t"), (201, 3, "a", "t"), (201, 3, "a", "t"), (2**40, 0, "user", "hi"), (7, 50, "user", "x" * 20_000)]
    return out


def test_against_a_plain_trie(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_small_blocks_and_ranges(spark, rows, monkeypatch):
    """Long conversations fold in blocks, lists of ends in ranges of ids."""
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "IDS", 7)
    assert found(spark, rows) == plain(rows)


def test_all_alike_and_empty(spark):
    rows = [(k, t, "user", "same") for k in range(300) for t in range(2)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", "hi", ""), (2, 1, "assistant", "no", "")]
    df = spark.createDataFrame(rows, TURNS)
    nodes, ends = T.trie(*T.as_spoken(T.numbered(df)))
    got = sorted((r.depth, r.conv_id, r.role, r.text, r.n_convs) for r in T.labelled(nodes, df.drop("depth")).collect() if r.depth)
    assert got == [(1, 1, "user", "hi", 2), (2, 1, "assistant", "yes", 1), (2, 2, "assistant", "no", 1)]
    assert sorted(r.ids for r in ends.collect()) == [[1], [2]]
