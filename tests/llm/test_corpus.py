"""The corpus operators against brute force on small fixtures, with the odd cases that each docstring defines."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from hearthledger.llm import ann, minhash_dedup, mixing, packing, pii, quality_rules, substring_dedup, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(60)] + ["é", "über", "x" * 30]
    shared = " ".join(rng.choice(word, 60))
    out = []
    for i in range(60):
        t = " ".join(rng.choice(word, rng.integers(1, 80)))
        if i % 4 == 0:
            t = f"{t[: len(t) // 2]} {shared} {t[len(t) // 2 :]}"
        out.append(t)
    out += [out[5], out[5], "a" * 350, "ab" * 200, "", None, "\t\n", "one", shared, " ".join(["go"] * 40)]
    return [(int(d), t) for d, t in zip(rng.permutation(len(out)) * 2, out, strict=True)]


@pytest.mark.parametrize("most", [suffix_dedup.INDEX_BYTES, 250])
def test_suffix_dedup(spark, texts, most):
    got = {r.doc_id: r for r in suffix_dedup.digest(frame(spark, [(d, t, "s") for d, t in texts]), most=most).collect()}
    seen = set()
    for d, t in sorted(texts, key=lambda r: r[0]):
        raw = (t or "").encode()
        cover = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                cover[i : i + 100] = True
            seen.add(raw[i : i + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_order_and_first_places():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (300, 1, 0, 250)]
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    first = suffix_dedup.first_places(text, ends)
    seen = {}
    for at in range(len(text)):
        end = ends[np.searchsorted(ends, at)]
        if end - at >= suffix_dedup.LENGTH:
            assert first[at] == seen.setdefault(bytes(text[at : at + suffix_dedup.LENGTH]), at)


def test_substring_dedup(spark, texts):
    got = {r.doc_id: r for r in substring_dedup.digest(frame(spark, [(d, t, "s") for d, t in texts])).collect()}
    seen = {}
    words = {d: WORDS.findall(t or "") for d, t in texts}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            seen.setdefault(tuple(words[d][i : i + 13]), d)
    for d, ws in words.items():
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - 12):
            if seen[tuple(ws[i : i + 13])] < d:
                gone[i : i + 13] = True
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(ws), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_quality_rules(spark, texts):
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, [(d, t, "s") for d, t in texts])).collect()}
    for d, t in texts:
        ws, lines = WORDS.findall(t or ""), [x for x in (t or "").split("\n") if WORDS.search(x)]
        windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        count, cover = collections.Counter(windows), np.zeros(len(ws), bool)
        for i, w in enumerate(windows):
            if count[w] > 1:
                cover[i : i + 8] = True
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), int(cover.sum()))
        assert r.base_failed == (len(ws) < 20 or 100 * int(cover.sum()) > 30 * len(ws)) and not (r.base_failed and r.kept)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    rows = [*texts, (1001, "word " * 5000), (1003, "a <|endoftext|> b")]
    got = packing.packed(frame(spark, [(d, t, "s") for d, t in rows])).collect()
    tok = Tokenizer.from_file(packing.vocabulary()[1])
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for d, t in rows}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert {d: sum(r.length for r in x) for d, x in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    for x in by_seq.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert len(by_seq) <= -(-sum(map(len, ids.values())) // packing.SEQUENCE) + 2


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(np.minimum(rng.geometric(0.02, 20_000), 512), minlength=513)[1:]
    plan = packing.patterns(demand)
    made = np.zeros(512, dtype=np.int64)
    for pattern, often in plan:
        assert sum(k * n for k, n in pattern) <= 512
        for k, n in pattern:
            made[k - 1] += n * often
    assert (made == demand).all()
    assert sum(n for _, n in plan) <= 1.02 * (demand @ np.arange(1, 513)) / 512 + 2


def filled(sums):
    """Targets by pouring water: the level rises by weight until 150 % of all words is poured; full sources take no more."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sums))]
    low, high = 0.0, 2.0 * max(sums) + 1
    for _ in range(200):
        level = (low + high) / 2
        poured = sum(min(2 * n, level * w) for n, w in zip(sums, weights, strict=True))
        low, high = (level, high) if poured < 1.5 * sum(sums) else (low, level)
    return [min(2 * n, high * w) for n, w in zip(sums, weights, strict=True)]


def test_tree_deals_the_words_to_shards(spark, texts, monkeypatch):
    monkeypatch.setattr(mixing, "WORDS_A_SHARD", 300)
    monkeypatch.setattr(mixing, "DOCS_A_BLOCK", 4)
    rows = [(d, t, "ab"[d // 2 % 2]) for d, t in texts]
    source = {d: s for d, _, s in rows}

    def run(tree, n=None):
        df = frame(spark, rows)
        return {r.doc_id: (r.taken, r.shards) for r in mixing.taken(df.repartition(n) if n else df, tree=tree).collect()}

    one, same, other = run(1), run(1, 5), run(2)
    assert one == same and one != other and {d: x[0] for d, x in one.items()} == {d: x[0] for d, x in other.items()}
    for got in (one, other):
        by = collections.Counter()
        for d, (n, shards) in got.items():
            parts = [tuple(map(int, x.split(":"))) for x in shards.split(",") if x]
            assert sum(w for _, w in parts) == n
            for k, w in parts:
                by[k, source[d]] += w
        assert len({k for k, _ in by}) > 5


def test_mixing(spark, texts):
    rows = [(d, t, [None, "a", "b", "zz"][d % 4 if d % 3 else 1]) for d, t in texts]
    runs = [sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.taken(df).collect()) for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(3), frame(spark, rows).repartition(7))]
    assert runs[0] == runs[1] == runs[2]
    size = {d: len(WORDS.findall(t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    sums = [sum(size[d] for d in size if source[d] == s) for s in names]
    goal = dict(zip(names, filled(sums), strict=True))
    got = collections.Counter()
    for d, n, whole, target, taken in runs[0]:
        assert n == size[d] and whole == sums[names.index(source[d])] and target == pytest.approx(goal[source[d]]) and 0 <= taken <= 2 * n
        got[source[d]] += taken
    for s in names:
        assert abs(got[s] - goal[s]) <= 1
    assert all(g <= 2 * n + 1e-9 for g, n in zip(goal.values(), sums, strict=True))


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 7, 0, 333])
    out = mixing.split(quotas, 13, 5)
    assert (out.sum(0) == quotas).all() and np.ptp(out.sum(1)) <= 1


@pytest.mark.parametrize("sent", [mixing.SENT, -1])
def test_mixed_gives_the_words_taken(spark, texts, sent):
    rows = [(d, t, "ab"[d // 2 % 2]) for d, t in texts]
    df = frame(spark, rows)
    want = {r.doc_id: r.taken for r in mixing.taken(df).collect() if r.taken}
    got = collections.Counter()
    for r in mixing.mixed(df, sent=sent).collect():
        got[r.doc_id] += len(WORDS.findall(r.text or ""))
    assert got == want


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    rows = [(i, [float(v) for v in x[i]], 0.0) for i in range(1500)]
    rows += [(2000 + i, rows[7][1], 0.0) for i in range(60)]  # ties
    rows += [(5000, None, 0.0), (5050, [0.0] * 16, 0.0), (5100, [float("nan")] + [1.0] * 15, 0.0), (5150, [None] + [1.0] * 15, 0.0), (5200, [1.0], 0.0), (None, rows[1][1], 0.0)]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and i < 5000}
    names = np.array(sorted(good))
    unit = np.array([good[i] for i in names])
    hits = total = 0
    assert sorted(got) == [i for i in names.tolist() if i % 50 == 0]
    for q, found in got.items():
        s = unit @ good[q]
        order = [i for i in np.lexsort((names, -np.round(s, 12))) if names[i] != q][:5]
        hits += len({v for _, v, _ in found} & set(names[order].tolist()))
        total += 5
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
    assert hits / total >= 0.95


def test_ann_finds_neighbours_among_thousands_of_near_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + 1e-3 * rng.normal(size=(4000, 16)), rng.normal(size=(1000, 16))])
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = unit @ unit[q]
        s[q] = -1
        hits += len(got[q] & set(np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()))
    assert hits / 400 >= 0.95


def test_ann_gives_five_neighbours_beside_small_cells(spark, monkeypatch):
    monkeypatch.setattr(ann.Model, "_calibrated", lambda self, x: 1)
    x = np.random.default_rng(9).normal(size=(120, 16))
    rows = [(50 * i, [float(e) for e in v]) for i, v in enumerate(x)]
    rows += [(1, [float(e) for e in x[0] + k]) for k in range(8)]  # one id, many vectors
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert sorted(got) == [50 * i for i in range(120)]
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == [1, 2, 3, 4, 5] and len({v for _, v in found} - {q}) == 5
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert collections.Counter(r.query_id for r in few) == {0: 3, 50: 3, 100: 3, 150: 3}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


PERSONAL = [
    "mail a.b@c.de or x@y@z.com, @@ a@b a@b.c.d- end",
    "ip 1.2.3.4 and 1.2.3.4.5 999.1.1.1 0001.2.3.255 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123",
    "call +49 (30) 1234-5678. or +1 or +1234567890123456 +12345678901 4111 1111 1111 1111",
    'token = "abcd1234efgh5678" Dr. Anna Smith me [at] home [dot] org account 12345678901',
    "ünï +49 30 123456789 é@b.cd 8.8.8.8",
    "",
    None,
]


def test_personal_data(spark):
    rows = [(i, t, "s") for i, t in enumerate(PERSONAL * 3)]
    for r in pii.find(frame(spark, rows)).collect():
        want = base(rows[r.doc_id][1] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in ("email", "ip", "card", "phone")]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_reliabilities_are_learned_from_votes():
    """Votes drawn with known rates: the posterior parts the truths, and follows the better labelers."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    rates = [0.95, 0.9, 0.55]  # how often each labeler is right
    v = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 - 1 for r in rates], axis=1)
    v[rng.random(v.shape) < 0.2] = 0
    post = pii.reliabilities(list(collections.Counter(map(tuple, v.tolist())).items()))
    told = np.array([post[tuple(x)] for x in v.tolist()])
    sure = (v[:, :2] != 0).all(1)
    assert ((told > 0.5) == truth)[sure].mean() > 0.9
    assert post[1, 1, -1] > 0.9 and post[-1, -1, 1] < 0.1 and post[1, 0, 0] > 0.5 > post[0, 0, 1]


def test_classifier_learns_soft_labels():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0])))
    w = pii.fitted([(r.tolist(), float(p)) for r, p in zip(x, y, strict=True)])
    assert np.allclose(w, [2, -1, 0], atol=0.1)


def test_two_kinds_may_start_at_one_place(spark):
    text = "+4111 1111 1111 1111 and 1.2.3.4 " * 3
    r = pii.find(frame(spark, [(1, text, "s"), (1, "x@y.zz", "s")])).collect()
    assert sorted(x.n_email for x in r) == [0, 1]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base(text))
    assert hashlib.sha256(joined.encode()).hexdigest() in {x.base_sha256 for x in r}


def test_masked_keeps_rows_and_columns(spark):
    df = frame(spark, [(i, t, "s") for i, t in enumerate(PERSONAL)])
    got = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert len(got) == len(PERSONAL) and got[7] is None and got[6] == ""
    assert not any(base(t) for t in got.values() if t)


def test_clashing_names_survive(spark):
    names = ["take", "shard", "pass", "place", "rank", "block", "h", "words", "src", "more", "span", "n_words", "root", "a"]
    columns = ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(1, "the red house and the blue river by the green tree " * 3, None, *range(14)), (None, None, "s", *[None] * 14)], f"doc_id long, text string, source string, {columns}")
    for run in (mixing.mixed, pii.masked, quality_rules.passing, minhash_dedup.deduplicated):
        got = run(df)
        assert got.columns == df.columns
        assert all(r["place"] in (3, None) for r in got.collect())
    for run in (mixing.taken, pii.find, quality_rules.judge, minhash_dedup.components, packing.packed, suffix_dedup.digest, substring_dedup.digest):
        assert {r.doc_id for r in run(df).collect()} == {1, None}


@pytest.mark.parametrize("run", [suffix_dedup.digest, substring_dedup.digest, quality_rules.judge, minhash_dedup.components, packing.packed, mixing.taken, pii.find])
def test_repeated_ids_and_long_texts(spark, run):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one two three four five six", "a"), (1, "seven eight nine", "b"), (2, long, "a"), (2, None, None), (None, long, "b")]
    got = collections.Counter(r.doc_id for r in run(frame(spark, rows)).select("doc_id").collect())
    if run is not packing.packed:
        assert got == {1: 2, 2: 2, None: 1}
    else:
        assert set(got) == {1, 2, None}


@pytest.mark.parametrize("run", [suffix_dedup.digest, substring_dedup.digest, quality_rules.judge, quality_rules.passing, packing.packed, mixing.taken, mixing.mixed, pii.find, pii.masked])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_empty_vectors(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_packing_plans_all_classes_in_a_driver_process(spark):
    """With every class of lengths in use: planning ends in a Spark driver with numpy's own number of threads."""
    import time

    assert spark.range(1).count() == 1
    room = packing.SEQUENCE // packing.GRAIN
    demand = np.random.default_rng(2).integers(1, 60, room)
    began = time.monotonic()
    made = packing.patterns(demand)
    assert time.monotonic() - began < 60
    held = np.zeros(room, dtype=np.int64)
    for pattern, often in made:
        assert sum(k * n for k, n in pattern) <= room
        for k, n in pattern:
            held[k - 1] += n * often
    assert (held == demand).all()
    # The fractional plan is a lower bound; rounding it adds 1 % at most here.
    assert sum(often for _, often in made) <= 1.01 * sum(use for _, use in packing.columns(demand))


def test_inverse_without_linear_algebra():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5, (60, 60)).astype(float) + np.eye(60) * (rng.permutation(60) % 2)
    assert np.allclose(packing.inverted(a) @ a, np.eye(60), atol=1e-8)
