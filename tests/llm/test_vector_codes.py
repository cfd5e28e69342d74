"""Vector codes against Lloyd's rounds in plain whole numbers, with the odd cases that the docstring defines."""

import hashlib
import math

import numpy as np
import pytest

from hearthledger.llm import vector_codes as V

ROWS = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = []
    for vec, v, label in rows:
        if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec, label, [math.floor(4096 * float(np.float32(x))) for x in v]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda x: [x[2 * p : 2 * p + 2] for p in range(parts)]
    books = [[cut(x)[p] for _, _, x in kept[:entries]] for p in range(parts)]

    def near(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, x in kept:
                groups.setdefault(near(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for vec, label, x in kept:
        each = [near(y, book) for y, book in zip(cut(x), books, strict=True)]
        out.append((vec, label, "".join(f"{i:02x}" for _, i in each), sum(d for d, _ in each)))
    sums = {}
    for _, label, _, e in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((-1 if v is None else v), code, e, sums[label], sha) for v, label, code, e in out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.digest(df).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (5, 16))
    out = [(int(i), [float(x) for x in centres[i % 5] + rng.normal(0, 0.1, 16)], int(i % 5) if i % 7 else None) for i in rng.permutation(150)]
    out += [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] + [0.0] * 15, 1), (1003, [float("inf")] + [0.0] * 15, 1), (1004, [1.0] * 8, 1), (1005, [], 1)]
    out += [(3, [0.0] * 16, 2), (3, [0.0] * 16, 2), (None, [0.5] * 16, None), (2000, [-1e-9] * 16, 3)]
    return out


def test_against_plain_rounds(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_few_rows_and_none(spark, rows):
    assert found(spark, rows[:3]) == plain(rows[:3])
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        V.digest(spark.createDataFrame([(1, [0.5] * 12, 1, "")], ROWS))
    with pytest.raises(Exception, match="no code"):
        found(spark, [(1, [16_384.0] * 16, 1)])


def test_sums_by_joins(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "LABELS", 0)
    assert found(spark, rows) == plain(rows)


def test_decoded_vectors_are_near(spark, rows):
    coded, books = V.compressed(spark.createDataFrame([(*r, "") for r in rows if r[1] and len(r[1]) == 16 and r[0] is not None and r[0] < 200], ROWS))
    held = {r["id"]: bytes(r["now"]) for r in coded.collect()}
    given = {r[0]: r[1] for r in rows if r[0] in held}
    ids = [i for i in held if i != 3]
    off = np.linalg.norm(V.decoded([held[i] for i in ids], books) - np.array([given[i] for i in ids]), axis=1)
    assert np.mean(off) < 0.35  # noise alone has 0.4


def test_only_changes_are_added():
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (40, 8, 2)).astype(np.int32)
    before, now = rng.integers(0, 4, (40, 8)).astype(np.uint8), rng.integers(0, 4, (40, 8)).astype(np.uint8)
    now[::2] = before[::2]
    whole = V.moved(x, None, now, 4) - V.moved(x, None, before, 4)
    assert (V.moved(x, before, now, 4) == whole).all()
    assert not V.moved(x, before, before, 4).any()
