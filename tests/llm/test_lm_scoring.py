import collections
import math
import re
import zlib

import numpy as np

from hearthledger.llm import lm_scoring as L

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(n=300):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        words = []
        while len(words) < rng.integers(5, 120):
            words += ["red", "green", "blue"] if rng.random() < 0.5 else ["one", "two", f"rare{rng.integers(400)}"]
        out.append((i, " ".join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, "unheard Of"), (None, "red"), (3, "red green")]


def test_counts_base_and_gain(spark):
    data = corpus()
    got = L.scored(spark.createDataFrame([(a, b, 1.0) for a, b in data], "doc_id long, text string, score double")).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [WORDS.findall((t or "").translate(LOW)) + ["\n"] for _, t in data]
    c = collections.Counter(w for (d, _), ws in zip(data, tokens, strict=True) if not held(d) for w in ws)
    total = sum(c.values()) + len(c) + 1
    want = sorted((d if d is not None else -1, held(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / total) for w in ws), 6)) for (d, _), ws in zip(data, tokens, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {sum(c.values())}
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty_table(spark):
    assert L.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []


SIZE = L.HEAD + 900  # so that some words lie beyond the head


def vocabulary():
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(2, 900, SIZE))[::-1]
    return L.vocabulary(rng.integers(1, 1 << 62, SIZE).astype(np.uint64), counts, 50, int(counts.sum()) + 50 + 300, SIZE + 201, 200)


def test_probabilities_add_up_to_one():
    v = vocabulary()
    net = L.Network(v)
    net.flat += np.random.default_rng(2).normal(0, 0.1, len(net.flat)).astype(np.float32)
    ids = np.r_[np.arange(len(v.counts)), -1].astype(np.int32)
    h = np.repeat(np.random.default_rng(3).normal(0, 1, (1, L.WIDTH)).astype(np.float32), len(ids), 0)
    assert abs(np.exp(net.outputs(h, ids).astype(float)).sum() - 1) < 1e-3


def test_gradient_by_differences():
    v = vocabulary()
    net = L.Network(v)
    rng = np.random.default_rng(4)
    ids = rng.integers(-1, SIZE, (6, 5)).astype(np.int32)
    ids[2, 1] = 0
    x, y, h = ids[:-1], ids[1:], rng.normal(0, 0.5, (5, L.WIDTH)).astype(np.float32)

    def loss():
        states, _ = net.run(net.input_of[x], x == 0, h.copy())
        return -net.outputs(states[1:].reshape(-1, L.WIDTH), y.reshape(-1)).astype(float).mean()

    g, _ = net.gradient(net.input_of[x], y, x == 0, h.copy())
    for k in np.argsort(-np.abs(g))[:40:3]:
        keep = net.flat[k]
        net.flat[k] = keep + 1e-2
        up = loss()
        net.flat[k] = keep - 1e-2
        down = loss()
        net.flat[k] = keep
        assert abs((up - down) / 2e-2 - g[k]) < 2e-3 + 0.03 * abs(g[k])


def test_training_learns_more_than_frequencies():
    """Held-out text scores above the best that word frequencies alone can give it."""
    rng = np.random.default_rng(6)
    chain = [rng.permutation(40)[:3] for _ in range(40)]  # three words may follow each word

    def stream(n):
        out, w = [], 0
        while len(out) < n:
            w = int(rng.choice(chain[w]))
            out += [w + 1] if rng.random() > 0.02 else [0]
        return np.array(out, np.int32)

    learn, held = stream(60_000), np.r_[stream(5_000), 0].astype(np.int32)
    counts = np.bincount(learn, minlength=41)
    order = np.argsort(-counts[1:], kind="stable")
    number = np.r_[0, np.argsort(order) + 1]  # ids go by frequency
    v = L.vocabulary(np.arange(1, 41).astype(np.uint64), counts[1:][order], int(counts[0]), len(learn), 41, 0)
    net = L.Network(v)
    moments = L.Moments(net)
    for _ in range(8):
        L.train(net, number[learn].astype(np.int32), moments)
    got = L.score(net, number[held].astype(np.int32), np.array([0, len(held)]))[0] / len(held)
    best = np.log(np.bincount(held, minlength=41)[held] / len(held)).mean()
    assert got > best + 0.2


def test_long_text_and_clashing_columns(spark):
    rows = [(i, "one two three " * 5 if i else "word " * 60_000 + "end", -1, "x", True) for i in range(12)]
    got = {r.doc_id: r for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string, word int, rid string, held_out boolean")).collect()}
    assert got[0].n_tokens == 60_002 and got[1].n_tokens == 16 and all(np.isfinite(r.score) for r in got.values())


def test_whole_documents_do_not_depend_on_their_lanes():
    net = L.Network(vocabulary())
    rng = np.random.default_rng(5)
    docs = [np.r_[rng.integers(1, SIZE, n), 0].astype(np.int32) for n in (0, 3, 200, 33, 1)]
    firsts = np.r_[0, np.cumsum([len(d) for d in docs])]
    together = L.score(net, np.concatenate(docs), firsts)
    for d, got in zip(docs, together, strict=True):
        assert abs(L.score(net, d, np.array([0, len(d)]))[0] - got) < 1e-3 * len(d)
