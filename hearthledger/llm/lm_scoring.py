"""Language-model scores: a gated recurrent network with a class-factored softmax, trained by truncated backpropagation.

1. Spark counts the words of all training documents.  Words met twice or more, up to ``TABLE`` of the most frequent,
   are a table of bounded size that tasks hold; the ``HEAD`` most frequent ones have vectors of their own.
2. Classes cut the words by frequency.  P(word) = P(class | state) * P(word | class, state); within classes of head
   words the second factor is a softmax over the state, within classes of other words it is their share of the
   class's counts.  The last class holds words outside the table and the unknown word, whose share is that of words
   met once.  The probabilities of all known words and the unknown one add up to 1.
3. Every task trains on its share of all training documents, in windows of ``STEPS`` tokens whose end state starts
   the next window.  Spark averages the tasks' weights, block by block; a first round over a sixteenth of the documents
   gives the start of the round over all.
4. Scoring runs whole documents in lanes; the state is carried from window to window and cleared at a document's
   start.  Counts of words outside the table are joined by Spark.

Defined cases: null and empty texts have one token, the end; rows that repeat an id are scored one by one; a null id
is a training document; with no training documents all words are unknown; an empty table gives an empty table; extra
columns are ignored.  Words are told apart by 64-bit hashes.  Very long texts are scored whole, their states carried
from window to window.  Words never met in training score as the one unknown word, and n_known leaves them out.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, release, slices, word_hashes, word_spans, written

HELD_OUT = (7, 2)  # crc32(doc_id as text) modulo, remainder; fixed by the contract
TABLE = 1 << 18
HEAD, HEAD_CLASSES, TAIL_CLASSES = 4096, 48, 15
WIDTH = 16
LANES, STEPS = 1024, 16
TURNS = 100  # optimiser steps that a share of tokens gives, at least
SCORE_STEPS = 32
MOST = np.float32(60)  # logits stay below, so that exponentials are finite
RATE = 0.003
BLOCKS = 64
END = np.uint64(0x51ED270B0A1F39C1)  # stands for the end of a text
TOP_BITS = np.uint64(46)  # hashes are looked up by what is left of them beyond these bits


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # of the table, ascending
    entry: np.ndarray  # where the hashes of each upper part start
    ids: np.ndarray  # of the hashes, by frequency; 0 is the end
    counts: np.ndarray  # by id
    classes: np.ndarray  # by id
    shares: np.ndarray  # by id: log of the share of the class's counts, 0 for head words
    bounds: np.ndarray  # head words of class c: bounds[c] to bounds[c + 1]
    prior: np.ndarray  # log share of each class
    tokens: int
    distinct: int
    rare_tokens: int
    once: int


def _cut(weight: np.ndarray, parts: int) -> np.ndarray:
    """A part for each item: parts of about equal weight, in order."""
    if not len(weight):
        return np.zeros(0, np.int64)
    reach = np.cumsum(weight) - weight / 2
    part = np.minimum((reach / max(reach[-1] + weight[-1] / 2, 1e-9) * parts).astype(np.int64), parts - 1)
    return np.unique(part, return_inverse=True)[1]


def vocabulary(hashes: np.ndarray, counts: np.ndarray, ends: int, tokens: int, distinct: int, once: int) -> Vocabulary:
    """hashes, counts: of the table, most frequent first, without the end."""
    counts = np.r_[ends, counts].astype(np.int64)
    hashes = np.r_[END, hashes.astype(np.uint64)]
    head = min(HEAD, len(counts))
    classes = np.r_[_cut(np.sqrt(counts[:head] + 1.0), HEAD_CLASSES), HEAD_CLASSES + _cut(counts[head:].astype(float), TAIL_CLASSES)]
    n_classes = HEAD_CLASSES + TAIL_CLASSES + 1
    mass = np.bincount(classes, weights=counts, minlength=n_classes)
    rare = max(0, tokens - int(counts.sum()))
    mass[-1] = rare
    shares = np.log(np.maximum(counts, 1)) - np.log(np.maximum(mass[classes], 1))
    shares[:head] = 0
    bounds = np.searchsorted(classes[:head], np.arange(HEAD_CLASSES + 1))
    used = np.bincount(classes, minlength=n_classes) > 0
    used[-1] = True
    prior = np.where(used, np.log((mass + 0.5) / (mass + 0.5)[used].sum()), -30.0)
    by = np.argsort(hashes)
    entry = np.searchsorted(hashes[by] >> TOP_BITS, np.arange((1 << (64 - int(TOP_BITS))) + 1, dtype=np.uint64)).astype(np.int32)
    return Vocabulary(hashes[by], entry, by.astype(np.int32), counts, classes.astype(np.int32), shares.astype(np.float32), bounds, prior.astype(np.float32), tokens, distinct, rare, once)


# ---------------------------------------------------------------- tokens
def _tokens(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, where each row's start, with a last entry for the end)."""
    raw, offsets = arrow_bytes(batch.column(column))
    starts, ends, firsts = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    n = np.diff(firsts)
    out = np.empty(len(words) + len(n), dtype=np.uint64)
    stop = np.cumsum(n + 1)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[stop - 1] = True
    out[is_end] = END
    out[~is_end] = words
    return out, np.r_[0, stop]


def _number(v: Vocabulary, tokens: np.ndarray) -> np.ndarray:
    """Ids of tokens; -1 outside the table.  The first bits of a hash lead to the few entries that share them."""
    top = (tokens >> TOP_BITS).astype(np.int32)
    at, stop = v.entry[top], v.entry[top + 1]
    out = np.full(len(tokens), -1, dtype=np.int32)
    left = np.flatnonzero(at < stop)
    while len(left):
        here = at[left]
        hit = v.hashes[here] == tokens[left]
        out[left[hit]] = v.ids[here[hit]]
        at[left] += 1
        left = left[~hit & (here + 1 < stop[left])]
    return out


def _counted(batches):
    import pyarrow as pa

    for batch in slices(batches, 0, 8 << 20):
        words, n = np.unique(_tokens(batch, 0)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


# ---------------------------------------------------------------- the network
class Network:
    """Weights: input vectors (head words, then one for each class), recurrence, classes, head words' outputs."""

    SHAPES = {
        "inputs": (HEAD + HEAD_CLASSES + TAIL_CLASSES + 1, WIDTH),
        "enter": (WIDTH, 3 * WIDTH),
        "gates": (3 * WIDTH,),
        "state": (WIDTH, 3 * WIDTH),
        "classes": (WIDTH, HEAD_CLASSES + TAIL_CLASSES + 1),
        "class_bias": (HEAD_CLASSES + TAIL_CLASSES + 1,),
        "words": (HEAD, WIDTH),
        "word_bias": (HEAD,),
    }

    def __init__(self, v: Vocabulary, flat: np.ndarray | None = None):
        self.v = v
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.zeros(sum(sizes), dtype=np.float32)
            self._view(flat, sizes)
            self.inputs[:] = rng.normal(0, 0.5, self.inputs.shape)
            self.enter[:] = rng.normal(0, 0.25, self.enter.shape)
            self.state[:] = rng.normal(0, 0.25, self.state.shape)
            self.gates[:WIDTH] = 1  # a state lasts at first
            self.class_bias[:] = v.prior
            head = v.counts[:HEAD]
            self.word_bias[: len(head)] = np.log((head + 0.5) / (head.max() + 0.5))
        else:
            self._view(flat.astype(np.float32), sizes)
        # What a token is as an input.
        self.input_of = np.where(np.arange(len(v.counts)) < HEAD, np.arange(len(v.counts)), HEAD + v.classes).astype(np.int32)
        self.input_of = np.r_[self.input_of, np.int32(HEAD + HEAD_CLASSES + TAIL_CLASSES)].astype(np.int16)  # the last at -1
        self.class_of = np.r_[v.classes, np.int32(HEAD_CLASSES + TAIL_CLASSES)].astype(np.int8)
        self.share_of = np.r_[v.shares, np.float32(0)]
        self.entered: np.ndarray | None = None  # what each input adds to the gates, once weights rest

    def _view(self, flat: np.ndarray, sizes: list[int]) -> None:
        self.flat, at = flat, 0
        for (name, shape), size in zip(self.SHAPES.items(), sizes, strict=True):
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """x: (steps, lanes) inputs; fresh: where a text starts; h: the state before.  States after each step."""
        steps, lanes = x.shape
        w = WIDTH
        states = np.empty((steps + 1, lanes, w), dtype=np.float32)
        states[0] = h
        held = [np.empty((steps, lanes, w), dtype=np.float32) for _ in range(4)] if keep else None
        before = self.entered[x] if self.entered is not None else (self.inputs @ self.enter + self.gates)[x]
        gate = np.empty((lanes, 2 * w), dtype=np.float32)
        for t in range(steps):
            last = states[t]
            last[fresh[t]] = 0
            pre = last @ self.state
            np.add(before[t, :, : 2 * w], pre[:, : 2 * w], out=gate)
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            z, r, q = gate[:, :w], gate[:, w:], pre[:, 2 * w :]
            n = np.tanh(before[t, :, 2 * w :] + r * q)
            np.subtract(last, n, out=states[t + 1])
            states[t + 1] *= z
            states[t + 1] += n
            if keep:
                for into, value in zip(held, (z, r, n, q), strict=True):
                    into[t] = value
        return states, held

    def outputs(self, hs: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """Log-probabilities of tokens y after states hs; with grad, also the gradient on hs."""
        logits = hs @ self.classes
        logits += self.class_bias
        np.minimum(logits, MOST, out=logits)
        of = self.class_of[y]
        each = np.arange(len(y))
        picked = logits[each, of]
        np.exp(logits, out=logits)
        total = logits.sum(1)
        logp = picked - np.log(total) + self.share_of[y]
        if grad is not None:
            logits /= total[:, None]
            logits[each, of] -= 1
            dh = logits @ self.classes.T
            grad["classes"] += hs.T @ logits
            grad["class_bias"] += logits.sum(0)
        # Within classes: rows go class by class, as slices of one sorted copy.
        by = np.argsort(of.astype(np.uint8), kind="stable")
        cut = np.searchsorted(of[by], np.arange(HEAD_CLASSES + 1))
        by = by[: cut[-1]]
        h_by, y_by, more = hs[by], y[by], np.zeros(len(by), dtype=np.float32)
        d_by = np.zeros_like(h_by) if grad is not None else None
        for c in range(HEAD_CLASSES):
            lo, hi = self.v.bounds[c], self.v.bounds[c + 1]
            if cut[c] == cut[c + 1] or hi - lo < 2:
                continue
            part = slice(cut[c], cut[c + 1])
            h, which, few = h_by[part], y_by[part] - lo, each[: cut[c + 1] - cut[c]]
            inner = h @ self.words[lo:hi].T
            inner += self.word_bias[lo:hi]
            np.minimum(inner, MOST, out=inner)
            chosen = inner[few, which]
            np.exp(inner, out=inner)
            total = inner.sum(1)
            np.subtract(chosen, np.log(total), out=more[part])
            if grad is not None:
                inner /= total[:, None]
                inner[few, which] -= 1
                np.matmul(inner, self.words[lo:hi], out=d_by[part])
                grad["words"][lo:hi] += inner.T @ h
                grad["word_bias"][lo:hi] += inner.sum(0)
        logp[by] += more
        if grad is not None:
            dh[by] += d_by
        return (logp, dh) if grad is not None else logp

    def gradient(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """(gradient of the mean loss, state after the window), truncated at the window's start."""
        steps, lanes = x.shape
        w = WIDTH
        states, (zs, rs, ns, qs) = self.run(x, fresh, h, keep=True)
        flat = np.zeros_like(self.flat)
        grad, at = {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            grad[name] = flat[at : at + size].reshape(shape)
            at += size
        _, out = self.outputs(states[1:].reshape(-1, w), y.reshape(-1), grad)
        out = out.reshape(steps, lanes, w)
        d_state = np.empty((steps, lanes, 3 * w), dtype=np.float32)
        d_new = np.empty((steps, lanes, w), dtype=np.float32)
        dh = np.zeros((lanes, w), dtype=np.float32)
        back = np.ascontiguousarray(self.state.T)
        for t in range(steps - 1, -1, -1):
            z, r, n, q, last = zs[t], rs[t], ns[t], qs[t], states[t]
            dh += out[t]
            d = d_state[t]
            dn = dh * (1 - z)
            dn *= 1 - n * n
            d[:, :w] = dh * (last - n) * (z * (1 - z))
            d[:, w : 2 * w] = dn * q * (r * (1 - r))
            d[:, 2 * w :] = dn * r
            d_new[t] = dn
            dh *= z
            dh += d @ back
            dh[fresh[t]] = 0
        d_flat = d_state.reshape(-1, 3 * w)
        grad["state"] += states[:-1].reshape(-1, w).T @ d_flat
        d_flat[:, 2 * w :] = d_new.reshape(-1, w)
        xs = x.reshape(-1)
        grad["gates"] += d_flat.sum(0)
        grad["enter"] += self.inputs[xs].T @ d_flat
        by = np.argsort(xs, kind="stable")
        xs = xs[by]
        first = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
        grad["inputs"][xs[first]] = np.add.reduceat((d_flat @ self.enter.T)[by], first, axis=0)
        flat /= len(xs)
        return flat, states[-1]


class Moments:
    """Adam's running moments of a task's gradients."""

    def __init__(self, net: Network):
        self.first, self.second, self.step = np.zeros_like(net.flat), np.zeros_like(net.flat), 0

    def move(self, net: Network, g: np.ndarray) -> None:
        self.step += 1
        self.first += 0.1 * (g - self.first)
        self.second += 0.01 * (g * g - self.second)
        net.flat -= (RATE / (1 - 0.9**self.step)) * self.first / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-6)


def train(net: Network, ids: np.ndarray, moments: Moments) -> None:
    """One pass over a stream of tokens (-1: outside the table; 0 ends a text), with Adam steps."""
    lanes = int(np.clip(len(ids) // (STEPS * TURNS), 1, LANES))
    length = -(-len(ids) // lanes)
    y = np.r_[ids, np.zeros(lanes * length - len(ids), ids.dtype)].reshape(lanes, length).T
    x = np.r_[np.int32(0), y.T.reshape(-1)[:-1]].reshape(lanes, length).T
    fresh = x == 0
    h = np.zeros((lanes, WIDTH), dtype=np.float32)
    for t in range(0, length, STEPS):
        part = slice(t, t + STEPS)
        g, h = net.gradient(net.input_of[x[part]], y[part], fresh[part], h)
        moments.move(net, g)


def score(net: Network, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole document; documents are dealt to lanes, the longest first."""
    n = np.diff(firsts)
    if not len(n):
        return np.zeros(0)
    lanes = min(LANES, len(n))
    heap, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in np.argsort(-n, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (load + int(n[d]), k))
    dealt.sort(key=lambda docs: -int(n[docs].sum()))
    order = np.concatenate([np.array(x) for x in dealt])
    sizes = np.array([int(n[x].sum()) for x in dealt])
    begin = np.r_[0, np.cumsum(n[order])]
    stream = ids[np.repeat(firsts[order] - begin[:-1], n[order]) + np.arange(begin[-1])]
    before = np.r_[np.int32(0), stream[:-1]]
    offset = np.r_[0, np.cumsum(sizes)[:-1]]
    logp = np.zeros(len(stream), dtype=np.float64)
    h = np.zeros((lanes, WIDTH), dtype=np.float32)
    net.entered = net.inputs @ net.enter + net.gates
    for t in range(0, int(sizes[0]), SCORE_STEPS):
        live = int(np.searchsorted(-sizes, -t, "left"))
        at = offset[:live] + t + np.arange(SCORE_STEPS)[:, None]
        valid = at < offset[:live] + sizes[:live]
        at = np.minimum(at, len(stream) - 1)
        x = before[at]
        states, _ = net.run(net.input_of[x], x == 0, h[:live])
        h[:live] = states[-1]
        logp[at[valid]] = net.outputs(states[1:][valid], stream[at[valid]])
    out = np.empty(len(n))
    out[order] = np.add.reduceat(logp, begin[:-1])
    return out


# ---------------------------------------------------------------- on Spark
def _share(batches, column: int = 0, limit: int = 12 << 20):
    """Tables of up to about `limit` bytes of text, so that many texts run side by side."""
    import pyarrow as pa

    held, size = [], 0
    for batch in slices(batches, column, 4 << 20):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _numbered(v: Vocabulary, table, column: int):
    """(ids, hashes, firsts) of a table's rows."""
    parts = [_tokens(b, column) for b in table.to_batches()]
    tokens = np.concatenate([p[0] for p in parts])
    firsts = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]
    return _number(v, tokens), tokens, firsts


def _one_thread() -> None:
    import os

    os.environ.setdefault("OMP_NUM_THREADS", "1")


def fitted(learn: DataFrame, held, start: np.ndarray | None) -> np.ndarray:
    """One round: every task trains from `start` on its rows of (text); Spark averages, weighted by tokens."""
    import pyarrow as pa

    spark = learn.sparkSession
    given = spark.sparkContext.broadcast(start)

    def trained(batches):
        net, seen = Network(held.value, given.value), 0
        moments = Moments(net)
        for t in _share(batches):
            ids, _, _ = _numbered(held.value, t, 0)
            train(net, ids, moments)
            seen += len(ids)
        if seen:
            parts = np.array_split(net.flat, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(seen)] * BLOCKS), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "seen", "weights"])

    def averaged(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = sums.setdefault(k, [0.0, 0.0])
                got[0] += n
                got[1] = got[1] + n * np.frombuffer(raw, dtype=np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for n, s in sums.values()], pa.binary())], names=["block", "weights"])

    rows = learn.mapInArrow(trained, "block int, seen double, weights binary").repartition("block").mapInArrow(averaged, "block int, weights binary").collect()
    given.destroy()
    if not rows:
        return start if start is not None else Network(held.value).flat
    return np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(rows, key=lambda r: r["block"])])


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row; the columns of the module's contract."""
    import pyarrow as pa

    spark = docs.sparkSession
    check = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(check % HELD_OUT[0] == HELD_OUT[1], F.lit(False)).alias("held_out"), F.col(text).alias("text"), check.alias("check"))
    learn = rows.where("not held_out")
    end = int(END.view(np.int64))
    counts = written(learn.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    release(spark)
    facts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("distinct"),
        F.count(F.when((F.col("n") == 1) & (F.col("word") != end), 1)).alias("once"),
        F.coalesce(F.max(F.when(F.col("word") == end, F.col("n"))), F.lit(0)).alias("ends"),
    ).collect()[0]
    # Bounded by TABLE rows of 16 bytes.
    top = counts.where((F.col("n") > 1) & (F.col("word") != end)).orderBy(F.desc("n"), "word").limit(TABLE).toArrow()
    v = vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy(), facts["ends"], facts["tokens"], facts["distinct"], facts["once"])
    held = spark.sparkContext.broadcast(v)
    weights = fitted(learn.where(F.col("check").isNull() | (F.shiftrightunsigned("check", 8) % 16 == 0)).select("text"), held, None)
    weights = fitted(learn.select("text"), held, weights)
    release(spark)
    given = spark.sparkContext.broadcast(weights)
    total = float(v.tokens + v.distinct + 1)

    def lanes(batches):
        v, net = held.value, Network(held.value, given.value)
        for t in _share(batches, 2):
            ids, tokens, firsts = _numbered(v, t, 2)
            logp = score(net, ids, firsts) / np.log(10)
            seen = np.r_[v.counts, 0][ids]
            known = np.add.reduceat(((ids >= 0) & (seen > 0)).astype(np.int64), firsts[:-1])
            base = np.add.reduceat(np.where(ids >= 0, np.log10((seen + 1) / total), 0.0), firsts[:-1])
            out = np.flatnonzero(ids < 0)
            cut = np.searchsorted(out, firsts)
            rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(tokens[out].view(np.int64)))
            made = pa.table([t.column(0), t.column(1), pa.array(np.diff(firsts)), pa.array(known), pa.array(base), pa.array(logp), rare], names=["doc_id", "held_out", "n_tokens", "known", "base", "logp", "rare"])
            yield from made.combine_chunks().to_batches(max_chunksize=20_000)

    first = rows.select("doc_id", "held_out", "text").mapInArrow(lanes, "doc_id long, held_out boolean, n_tokens long, known long, base double, logp double, rare array<long>")
    first = written(first.select(F.monotonically_increasing_id().alias("rid"), "*"), "lanes")
    release(spark)
    # Words outside the table: their counts are joined; the class's known words share what the unknown one leaves.
    whole = float(v.rare_tokens + v.once + 1)
    loose = first.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    loose = loose.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    within = F.when(F.col("n") > 0, F.log10(F.col("n") / whole)).otherwise(F.log10(F.lit((v.once + 1) / whole)))
    more = loose.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / total)).alias("more_base"),
        F.sum(F.col("times") * within).alias("more_logp"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("rare").join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("logp") + zero("more_logp")).alias("score"),
    )
