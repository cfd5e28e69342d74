"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features of a text: the presence of each n-gram of ``ORDERS`` characters, lower-cased, inside words and over the blank on either side of
one; hashed into ``BUCKETS``.

1. Labels are joined to the documents that may be learnt from, and (toxic, text) is written to the shared folder.
2. Tasks count for every bucket the texts of either label that hold it; Spark adds the counts up.  All labelled rows count.
   r = log of the ratio of a bucket's smoothed shares in both labels.
3. Logistic regression on r-scaled presences of unit length: in each of ``ROUNDS`` rounds every task trains from the shared weights on its
   own rows, and Spark averages the weights, each task's by its rows.  All labelled rows are used; a task holds the features of
   ``AT_ONCE`` texts at a time.  What the driver holds is one weight and one count pair a bucket.
4. Every text is scored in the task that reads it: only its presences, whole, are used.

Defined cases: null text is empty; empty texts have no features and score the bias alone; a document whose label rows disagree has the label that at
least half of them give; labels that are null or neither 0 nor 1 are left out; null ids are never learnt from; repeated documents are rows of their own; without
any labelled row the score is 1/3 everywhere; an empty table gives an empty table; extra columns are ignored.  Weights are
averages over tasks, so scores may differ in far digits where the same rows lie in other partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
ROUNDS, PASSES, RATE, DECAY = 2, 2, 0.5, 1e-4
SMOOTH = 1.0
AT_ONCE = 256
BLOCKS = 32  # a task's counts or weights travel in so many rows
LABELS = 1_000_000  # so many labels are broadcast (16 bytes each); more are joined by id
PIECE = 1 << 20  # characters hashed at once
_STEP, _MIX = np.uint32(0x9E3779B1), 0x2C1B3C6D  # odd


def presences(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Buckets of a whole text, ascending, each once.  `seen`: BUCKETS of False, which it is again afterwards."""
    words = set((text or "").lower().split())  # n-grams lie inside words, so that a word's repetitions add none
    if not words:
        return np.zeros(0, np.int64)
    line, longest = f" {' '.join(words)} ", max(ORDERS)
    for at in range(0, len(line), PIECE):  # pieces share longest - 1 characters
        rolled = chars = np.frombuffer(line[at : at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        black, inner = chars != 32, np.ones(len(chars), bool)
        for n in range(2, min(longest, len(chars)) + 1):
            rolled = rolled[:-1] * _STEP + chars[n - 1 :]
            inner = inner[:-1] & black[n - 2 : len(chars) - 1] if n > 2 else inner[:-1]  # no blank but at either end
            if n in ORDERS:
                h = rolled[inner]
                h = (h ^ (h >> np.uint32(15))) * np.uint32(_MIX + 2 * n)
                seen[h >> np.uint32(14)] = True
    by_eight = seen.view(np.uint64)
    some = np.flatnonzero(by_eight)
    i, j = np.nonzero(seen.reshape(-1, 8)[some])
    by_eight[some] = 0
    return some[i] * 8 + j


def _features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first place of each text and the end) of texts."""
    seen = np.zeros(BUCKETS, bool)
    each = [presences(t.as_py(), seen) for t in texts]
    return (np.concatenate(each) if each else np.zeros(0, np.int64)), np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int64)


def _rows(block: np.ndarray, weight: float):
    """A task's vector as rows (block, values, weight)."""
    import pyarrow as pa

    parts = np.array_split(block, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([float(weight)] * BLOCKS, pa.float64())], names=["block", "held", "weight"])


def _added(tasks: DataFrame, mean: bool) -> tuple[np.ndarray | None, float]:
    """Sum (or mean by weight) of the tasks' vectors, block by block, and the sum of weights."""
    import pandas as pd

    def add(rows):
        total, weight = None, 0.0
        for held, w in zip(rows["held"], rows["weight"], strict=True):
            v = np.frombuffer(held, dtype=np.float64) * (w if mean else 1.0)
            total, weight = v if total is None else total + v, weight + w
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "held": [total.tobytes()], "weight": [weight]})

    schema = "block int, held binary, weight double"
    some = tasks.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16)))
    first = some.groupBy("block", "slot").applyInPandas(add, schema)
    got = first.groupBy("block").applyInPandas(add, schema).orderBy("block").collect()  # BLOCKS rows
    if not got:
        return None, 0.0
    whole = np.concatenate([np.frombuffer(r["held"], dtype=np.float64) for r in got])
    weight = got[0]["weight"]
    return (whole / weight if mean else whole), weight


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """(toxic, text) of labelled documents, one label a document."""
    one = labels.where(F.col(mark).isin(0, 1)).groupBy(F.col(key).cast("long").alias("of")).agg((F.avg(mark) >= 0.5).cast("int").alias("toxic")).where("of is not null")
    one = written(one, "labels")
    one = F.broadcast(one) if one.count() <= LABELS else one
    return docs.select(F.col(key).cast("long").alias("own"), F.col(text).alias("text")).join(one, F.col("own") == F.col("of")).select("toxic", "text")


def counted(learn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(2 x BUCKETS counts of texts of either label that hold a bucket, 2 counts of texts)."""

    def go(batches):
        counts = np.zeros(2 * BUCKETS + 2)
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                buckets, firsts = _features(some.column(1))
                side = np.repeat(marks[at : at + AT_ONCE], np.diff(firsts))
                counts[:-2] += np.bincount(buckets + BUCKETS * side, minlength=2 * BUCKETS)
                counts[-2:] += np.bincount(marks[at : at + AT_ONCE], minlength=2)
        if counts[-2:].any():
            yield _rows(counts, 1.0)

    total, _ = _added(learn.select("toxic", "text").mapInArrow(go, "block int, held binary, weight double"), mean=False)
    total = np.zeros(2 * BUCKETS + 2) if total is None else total
    return total[:-2].reshape(2, BUCKETS), total[-2:]


def ratios(counts: np.ndarray) -> np.ndarray:
    """log((p + s) / |p + s|) - log((q + s) / |q + s|) of each bucket; 0 where no text holds it."""
    shares = counts + SMOOTH
    r = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
    return np.where(counts.any(0), r, 0.0)


def _values(r: np.ndarray, buckets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Scaled presences; each text's have length 1 (none, if all are 0)."""
    v = r[buckets]
    size = np.diff(firsts)
    squares = np.zeros(len(size))
    some = size > 0
    squares[some] = np.add.reduceat(v * v, firsts[:-1][some]) if some.any() else 0
    scale = 1 / np.sqrt(np.where(squares > 0, squares, 1))
    return v * np.repeat(scale, size)


def _sums(v: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    size = np.diff(firsts)
    out = np.zeros(len(size))
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(v, firsts[:-1][some])
    return out


def trained(learn: DataFrame, r: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """BUCKETS weights and the bias, averaged over tasks in each round.  A label weighs as the root of its rarity."""
    spark = learn.sparkSession
    shared_r = spark.sparkContext.broadcast(r)
    balance = np.sqrt(totals.sum() / (2 * np.maximum(totals, 1)))
    w = np.r_[np.zeros(BUCKETS), np.log((totals[1] + 1) / (totals[0] + 2))]

    def task(start):
        def go(batches):
            own, rows, r = start.value.copy(), 0, shared_r.value
            squares = np.full(BUCKETS + 1, 1e-2)  # of gradients: the step of each weight

            for batch in batches:
                marks = batch.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, batch.num_rows, AT_ONCE):
                    buckets, firsts = _features(batch.column(1).slice(at, AT_ONCE))
                    y, v, size = marks[at : at + AT_ONCE], _values(r, buckets, firsts), np.diff(firsts)
                    for _ in range(PASSES):
                        for lo in range(0, len(y), 32):
                            hi = min(lo + 32, len(y))
                            a, b = firsts[lo], firsts[hi]
                            k, x = buckets[a:b], v[a:b]
                            z = _sums(own[k] * x, firsts[lo : hi + 1] - a) + own[-1]
                            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]) * balance[y[lo:hi]]
                            at_k, inverse = np.unique(k, return_inverse=True)
                            g = np.bincount(inverse, np.repeat(off, size[lo:hi]) * x, len(at_k)) + DECAY * own[at_k]
                            squares[at_k] += g * g
                            own[at_k] -= RATE * g / np.sqrt(squares[at_k])
                            squares[-1] += off.sum() ** 2
                            own[-1] -= RATE * off.sum() / np.sqrt(squares[-1])
                    rows += len(y)
            if rows:
                yield _rows(own, rows)

        return go

    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast(w)
        got, _ = _added(learn.select("toxic", "text").mapInArrow(task(start), "block int, held binary, weight double"), mean=True)
        start.unpersist()
        if got is None:
            break
        w = got
    return w


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic") -> np.ndarray:
    """Two rows over the buckets, ratios and weights (the bias behind them), from all labelled documents of `docs`."""
    learn = written(labelled(docs, labels, key, text, mark), "labelled")
    counts, totals = counted(learn)
    r = ratios(counts)
    w = trained(learn, r, totals)
    return np.stack([np.r_[r, 0.0], w])


def scored(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with `score`, the probability of label 1 by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * (BUCKETS + 1) numbers

    def go(batches):
        import pyarrow as pa

        r, w = shared.value[0][:-1], shared.value[1]
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            scores = []
            for t in batch.column(batch.num_columns - 1):
                k = presences(t.as_py(), seen)
                v = r[k]
                size = np.sqrt((v * v).sum())
                z = (w[k] * v).sum() / (size or 1.0) + w[-1]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema) + ", score double"
    return docs.select(*(F.col(f"`{c}`") for c in kept), text).mapInArrow(go, schema)


def judged(docs: DataFrame, labels: DataFrame, folds: int = 5, key: str = "doc_id", text: str = "text", mark: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; nothing is learnt from those whose id's checksum leaves 0."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    d = docs.select(F.col(key), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    model = fitted(d.where(fold != 0), labels, key, "text", mark)
    return scored(d, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
