import collections
import re

import numpy as np

import corpus_pipeline as P
from hearthledger.llm import packing
from tests.llm.test_corpus import base
from tests.llm.test_minhash_dedup import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(9)
    word = "the of and to in a is that it for on with as by".split()
    rare = "red green blue river stone house cloud bread".split() + [f"term{i}" for i in range(300)]
    out = []
    for i in range(120):
        out.append(" ".join(rng.choice(word if rng.random() < 0.2 else rare) for _ in range(rng.integers(40, 120))))
    out += [out[3], out[3] + " tail", out[8], "# * $ % &" * 30, "too short", None, "", "same " * 50, out[0] + " write to jo.doe@example.org or +49 30 1234567 now"]
    return [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(out)]


def test_empty_and_null_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).collect() == []
    rows = [(None, None, None, None, None), (7, None, None, "a", 0), (7, "", "en", None, 0)]
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(rows, SCHEMA)
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} <= {None, 7}


def test_each_stage_and_the_whole(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    stage = dict(P.STAGES)
    good = stage["quality rules"](spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and set(range(120)) <= set(kept) and not {124, 125, 126, 127} & set(kept) and 123 not in kept
    one = stage["near-duplicates"](spark, good, str(tmp_path))
    left = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == docs.columns and sorted(left) == [d for d, _, _, own in brute(list(kept.items()), width=5) if own]
    hidden = stage["personal data"](spark, one, str(tmp_path))
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert hidden.columns == docs.columns and set(texts) == set(left) and not any(base(t) for t in texts.values())
    assert all(texts[d] == left[d] for d in texts if d < 100)
    mix = stage["mixing"](spark, hidden, str(tmp_path))
    assert mix.columns == docs.columns
    words = {d: len(WORDS.findall(t)) for d, t in texts.items()}
    mixed = collections.Counter()
    for r in mix.collect():
        assert texts[r.doc_id].split()[: len(r.text.split())] == r.text.split()
        mixed[r.doc_id] += len(r.text.split())
    assert all(mixed[d] <= 2 * words[d] for d in words) and abs(sum(mixed.values()) - 1.5 * sum(words.values())) <= 3
    pieces = P.run(spark, str(tmp_path)).collect()
    tokens = collections.Counter()
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(mixed)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Nulls in any column, repeated rows, a long text, extra columns with names of the stages' own, and no rows at all."""
    text = " ".join(f"word{i} of the and to that" for i in range(40)) + "."
    long_ = " ".join(f"and the {i} is of that to term{i}" for i in range(20_000))
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, None, "b", 2), (None, text + " more", None, None), (3, "", "b", 3), (4, long_, "a", 4), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, n_chars long, component_id string, take long")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in P.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        pieces = P.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        drawn = [r.doc_id for r in now.collect()]
        assert set(drawn) == {r.doc_id for r in pieces}
        assert (not drawn) if given is not docs else {1, 4, None} >= set(drawn) >= {4}
