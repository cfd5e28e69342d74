"""The toxicity classifier: features by brute force, ratios by hand, held-out accuracy, odd cases."""

import zlib

import numpy as np
import pytest

from hearthledger.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_presences_are_those_of_all_words():
    seen = np.zeros(X.BUCKETS, bool)
    text = "Ab c  déjà\nvu!! " + " ".join(f"w{i}" for i in range(500))
    each = set()
    for w in set(text.lower().split()):
        each |= set(X.presences(w, seen).tolist())
    assert set(X.presences(text, seen).tolist()) == each
    assert X.presences(text + " " + text.upper(), seen).tolist() == sorted(each)
    assert not seen.any()
    for empty in (None, "", " \n\t"):
        assert len(X.presences(empty, seen)) == 0
    assert len(X.presences("a", seen)) == 1  # blank, a, blank
    assert len(X.presences("abcd", seen)) == 4 + 3 + 2  # of " abcd ": 3, 4 and 5 characters


def test_long_texts_in_pieces(monkeypatch):
    seen = np.zeros(X.BUCKETS, bool)
    text = "".join(chr(97 + i * 7 % 26) + (" " if i % 11 == 0 else "") for i in range(5_000)) + "\ud800"
    whole = X.presences(text, seen)
    monkeypatch.setattr(X, "PIECE", 64)
    words = set(text.lower().split())
    assert set(X.presences(" ".join(sorted(words)), seen)) == set(whole)


def test_ratios():
    counts = np.zeros((2, X.BUCKETS))
    counts[0, :2], counts[1, :2] = [3, 1], [1, 7]
    r = X.ratios(counts)
    size = X.BUCKETS * X.SMOOTH
    assert np.isclose(r[0], np.log(2 / (8 + size)) - np.log(4 / (4 + size)))
    assert r[1] > 0 > r[0] and not r[2:].any()


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    syllables = ["ra", "to", "mi", "ne", "lo", "su", "ki", "de"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    bad = ["zorkle", "vexxnar", "bluphid"]
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.integers(3, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2 + len(words) // 60):
                words[rng.integers(len(words))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(words), "en", "x"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
        elif i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs += [(700, None, "en", "x"), (701, "", "en", "x"), (702, "x" * 300_000, "en", "x"), (None, "vexxnar zorkle", "en", "x"), (1, docs[1][1], "de", "y")]
    labels += [(2, 0, None), (4, 0, 7), (5, 1, 0), (9999, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def judged(spark, corpus):
    docs, labels = corpus
    return X.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()


def test_held_out_accuracy(judged, corpus):
    docs = corpus[0]
    assert len(judged) == len(docs)
    out = [(r.doc_id % 6 == 0, r.predicted) for r in judged if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert sum(t for t, _ in out) > 10
    assert np.mean([t == bool(p) for t, p in out]) > 0.97


def test_rows_and_odd_texts(judged):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in judged)
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in judged if r.doc_id is not None)
    by = {r.doc_id: r for r in judged if r.doc_id != 1}
    assert by[700].score == by[701].score < 0.5
    assert not by[None].held_out and by[None].predicted == 1
    assert len({round(r.score, 12) for r in judged if r.doc_id == 1}) == 1  # neither language nor source counts


def test_labels_of_the_held_out_are_never_read(spark, corpus, judged):
    docs, labels = corpus
    turned = [(i, q, 1 - t if i is not None and fold(i) == 0 and t in (0, 1) else t) for i, q, t in labels]
    again = X.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(turned, LABELS)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert [r.predicted for r in sorted(again, key=key)] == [r.predicted for r in sorted(judged, key=key)]


def test_no_labels_and_no_documents(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:5], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {round(r.score, 9) for r in X.judged(docs, none).collect()} == {round(1 / 3, 9)}
    assert X.judged(docs.limit(0), none).collect() == []


def test_labels_by_join(spark, corpus, judged, monkeypatch):
    monkeypatch.setattr(X, "LABELS", 0)
    docs, labels = corpus
    again = X.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert np.mean([r.predicted for r in again]) == pytest.approx(np.mean([r.predicted for r in judged]), abs=0.01)
