"""Packing token sequences as a cutting-stock problem, solved by column generation.

1. Each document is tokenised once; pieces of exactly ``SEQUENCE`` tokens stand alone, the rest of a document is
   one shorter piece.  Lengths and checksums are written to the shared folder.
2. Lengths are counted in classes of ``GRAIN`` tokens (a table bounded by ``SEQUENCE / GRAIN`` rows).  A linear
   program over patterns of classes is solved by a revised simplex; an unbounded-knapsack dynamic programme
   prices new patterns.
3. Patterns are rounded down; what is left over (bounded by the number of classes times a pattern's size) is packed
   best-fit decreasing.  Spark ranks the pieces of a class and deals them to the patterns' sequences.

Defined cases: null text is an empty document and gives one piece, the end id; repeated rows are separate
documents; an empty table gives an empty table; extra columns are ignored.  Very long texts give many whole
pieces.  A special token's string inside a text is treated as the tokenizers library does by default.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SEQUENCE = 2048
END_ID = 1
GRAIN = 4
SALTS = 64
_LOADED: dict[str, tuple] = {}


def vocabulary() -> tuple[str, str]:
    """(merges as ranks, tokenizers file) of the public vocabulary; a parameter of ``pieces``."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def _encoder(paths: tuple[str, str]):
    """Both libraries hold the same vocabulary and give the same ids; ranks encode five times as fast."""
    if paths[0] not in _LOADED:
        import base64

        import public_tokenizers as P
        import tiktoken

        with open(paths[0], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[paths[0]] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[paths[0]]


def _with_specials(path: str, text: str) -> list[int]:
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path].encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, crcs): the checksum of every piece of up to SEQUENCE ids, in order."""
    paths = paths or vocabulary()

    def encode(batches):
        import pyarrow as pa

        encoder = _encoder(paths)
        for batch in batches:
            lengths, sums = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = _with_specials(paths[1], text) if "<|endoftext|>" in text else encoder.encode_ordinary(text)
                ids.append(END_ID)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                lengths.append(len(ids))
                sums.append([zlib.crc32(raw[i : i + 4 * SEQUENCE]) for i in range(0, len(raw), 4 * SEQUENCE)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(encode, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, doc_tokens long, crcs array<long>")


# ---------------------------------------------------------------- patterns
def priced(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each class (weight 1..room) goes into `room`."""
    best = np.zeros(room + 1)
    pick = np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        gain = value[:c] + best[c - 1 :: -1][:c]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(room, dtype=np.int64), room
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[room]), pattern


def first_columns(demand: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A feasible basis: fill sequences with the largest classes that fit; each pattern is used until a class runs out.

    Later patterns lack the classes that ran out before, so the columns are triangular up to order.
    """
    room, left, out = len(demand), demand.astype(float), []
    alone = set(kinds.tolist())
    while (left > 1e-9).any():
        pattern, space = np.zeros(room), room
        for k in np.flatnonzero(left > 1e-9)[::-1]:
            n = min(space // (k + 1), int(np.ceil(left[k])))
            pattern[k], space = n, space - n * (k + 1)
        some = pattern > 0
        ratio = np.where(some, left / np.where(some, pattern, 1), np.inf)
        over = int(ratio.argmin())
        left = np.maximum(left - ratio[over] * pattern, 0)
        left[over] = 0
        alone.discard(over)
        out.append(pattern[kinds])
    for k in sorted(alone):  # ran out together with another class
        single = np.zeros(room)
        single[k] = room // (k + 1)
        out.append(single[kinds])
    return np.array(out).T


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss-Jordan elimination with row pivots.

    Elementwise numpy only, as in all of this planning: numpy's linear algebra may start threads of its own, and those
    don't return in the process of a Spark driver.
    """
    n = len(a)
    wide = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        at = k + int(np.abs(wide[k:, k]).argmax())
        if at != k:
            wide[[k, at]] = wide[[at, k]]
        wide[k] /= wide[k, k]
        other = np.flatnonzero(wide[:, k])
        other = other[other != k]
        wide[other] -= wide[other, k, None] * wide[k]
    return wide[:, n:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def columns(demand: np.ndarray, gap: float = 3e-4, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) use: the fewest sequences that hold `demand` pieces of each class."""
    room = len(demand)
    kinds = np.flatnonzero(demand)
    if not len(kinds):
        return []
    m = len(kinds)
    basis = first_columns(demand, kinds)
    inverse = inverted(basis)
    use = np.maximum(_times(inverse, demand[kinds].astype(float)), 0)
    gap = max(gap, room / float(demand @ np.arange(1, room + 1)))  # closer than one sequence is lost in rounding
    for step in range(rounds):
        duals = inverse.sum(0)
        value = np.full(room, -1.0)
        value[kinds] = duals
        worth, pattern = priced(value, room)
        if worth <= 1 + gap:  # use.sum() / worth is a lower bound
            break
        column = pattern[kinds].astype(float)
        direction = _times(inverse, column)
        steep = direction > 1e-9
        if not steep.any():
            break
        ratio = np.where(steep, use / np.where(steep, direction, 1), np.inf)
        out = int(ratio.argmin())
        far = max(0.0, ratio[out])
        use = use - far * direction
        use[out] = far
        basis[:, out] = column
        if step % 300 == 299:
            inverse = inverted(basis)
            use = np.maximum(_times(inverse, demand[kinds].astype(float)), 0)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    found = []
    for j in range(m):
        if use[j] > 1e-9:
            pattern = np.zeros(room, dtype=np.int64)
            pattern[kinds] = np.rint(basis[:, j]).astype(np.int64)
            found.append((pattern, float(use[j])))
    return found


def patterns(demand: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((class, pieces)..., sequences) that hold exactly `demand`; classes are 1-based units of GRAIN."""
    left, made = demand.copy(), Counter()
    for pattern, use in columns(demand):
        often = int(use + 1e-6)
        inside = pattern > 0
        if inside.any():
            often = min(often, int((left[inside] // pattern[inside]).min()))
            if often > 0:
                left = left - often * pattern
                made[tuple((int(k) + 1, int(pattern[k])) for k in np.flatnonzero(pattern))] += often
    room = len(demand)
    open_by_room: dict[int, list[Counter]] = {}
    for k in range(room, 0, -1):
        for _ in range(int(left[k - 1])):
            fit = min((r for r, x in open_by_room.items() if r >= k and x), default=None)
            bin_ = open_by_room[fit].pop() if fit is not None else Counter()
            bin_[k] += 1
            open_by_room.setdefault((fit if fit is not None else room) - k, []).append(bin_)
    for bins in open_by_room.values():
        for b in bins:
            made[tuple(sorted(b.items()))] += 1
    return sorted(made.items())


def packed(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    spark: SparkSession = docs.sparkSession
    done = written(pieces(docs, paths, key, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    each = done.select("uid", "doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "uid",
        "doc_id",
        (F.col("k").cast("long") * SEQUENCE).alias("start"),
        F.least(F.lit(SEQUENCE).cast("long"), F.col("doc_tokens") - F.col("k").cast("long") * SEQUENCE).alias("length"),
        "ids_crc32",
        "doc_tokens",
    )
    tail = (F.col("doc_tokens") % SEQUENCE).alias("length")
    room = SEQUENCE // GRAIN
    grade = F.ceil(F.col("length") / F.lit(GRAIN)).cast("int")
    rests = done.where(F.col("doc_tokens") % SEQUENCE > 0).select("uid", tail).withColumn("grade", grade).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    counts = rests.groupBy("grade", "salt").agg(F.count("*").alias("n")).collect()  # at most room * SALTS rows
    demand, offsets, seen = np.zeros(room, dtype=np.int64), [], Counter()
    for r in sorted(counts, key=lambda r: (r["grade"], r["salt"])):
        offsets.append((r["grade"], r["salt"], seen[r["grade"]]))
        seen[r["grade"]] += r["n"]
        demand[r["grade"] - 1] += r["n"]
    plan, ranges, base, at = patterns(demand), [], 0, Counter()
    for pattern, often in plan:
        slot = 0
        for k, n in sorted(pattern, reverse=True):
            ranges.append((k, at[k], at[k] + n * often, base, often, slot))
            at[k] += n * often
            slot += n
        base += often
    starts = spark.createDataFrame(offsets, "grade int, salt int, before long")
    deal = spark.createDataFrame(ranges, "grade int, lo long, hi long, base long, often long, slot long")
    order = Window.partitionBy("grade", "salt").orderBy(F.desc("length"), "uid")
    # Both tables are bounded: room * SALTS rows, and the patterns of at most `room` columns and the left-overs.
    ranked = rests.withColumn("row", F.row_number().over(order)).join(F.broadcast(starts), ["grade", "salt"]).withColumn("rank", F.col("row") - 1 + F.col("before"))
    dealt = ranked.join(F.broadcast(deal), (ranked["grade"] == deal["grade"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "uid",
        (F.col("base") + (F.col("rank") - F.col("lo")) % F.col("often")).alias("sequence_id"),
        (F.col("slot") + F.floor((F.col("rank") - F.col("lo")) / F.col("often"))).alias("slot"),
    )
    short = each.where(F.col("length") < SEQUENCE).join(dealt, "uid")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    whole = each.where(F.col("length") == SEQUENCE).select("*", (F.monotonically_increasing_id() + F.lit(base)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return short.select(*names).unionByName(whole.select(*names))
