"""Repeated word windows across documents, with a count-min prefilter.

First pass: every partition sketches its windows of ``WINDOW`` words (two hashed rows of slots counting 0, 1,
2 or more); sketches are merged block by block.  A merged slot never counts less than a window's true number, so
windows whose slots all count two or more contain every repeated one.  Second pass: only those windows are
grouped exactly by 96-bit keys.  Windows already seen in a smaller document of the same batch are settled there, so
a frequent window sends one row per batch, not one per occurrence.

The sketch is sized from the corpus and bounded by ``MAX_SLOTS`` (its merged bits, at most 64 MB, are broadcast).
A corpus beyond that passes more windows to the exact pass: half of those that occur once at 300 million windows, nearly
all from a billion on.

Defined cases: null and empty texts have no words; texts shorter than a window keep all words; rows that repeat an
id never remove each other's words; a null id counts as larger than all; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, ids_of, keyed, merged, mix64, release, slices, window_hashes, word_hashes, word_spans, words_of, written

WINDOW = 13
MIN_SLOTS, MAX_SLOTS = 1 << 20, 1 << 29
BLOCK = 1 << 20  # slots that are merged together
FAN = 64  # sketches of a block that meet in one task
HELD = 4 << 20  # slots that a task holds before it gives them away as a sketch


def _windows(batch, column: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the whole windows of a batch, their document rows and word positions, and the mask used."""
    raw, offsets = arrow_bytes(batch.column(column))
    starts, ends, firsts = word_spans(raw, offsets)
    hashes, whole = window_hashes(word_hashes(raw, starts, ends, False, which), firsts, WINDOW, which)
    at = np.flatnonzero(whole)
    row = np.searchsorted(firsts, at, "right") - 1
    return hashes[at], row, at - firsts[row], at


def _slots(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    half = np.uint64(slots // 2 - 1)
    return [(hashes & half).astype(np.int64), ((mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) & half).astype(np.int64) + slots // 2]


def _packed(slots: np.ndarray) -> bytes:
    import zstandard

    gaps = np.diff(slots, prepend=0).astype("<u4")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # byte planes: the upper ones are nearly all zero


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _sketch(slots: int):
    def run(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []

        def flush():
            at = np.concatenate(held) if held else np.zeros(0, np.uint32)
            held.clear()
            at.sort()
            like = at[1:] == at[:-1]
            own = at[np.r_[True, ~like]] if len(at) else at
            twice = np.r_[like, False][np.r_[True, ~like]] if len(at) else np.zeros(0, bool)
            edges = np.searchsorted(own, np.arange(0, slots + 1, BLOCK, dtype=np.uint32))
            blocks, once_, twice_ = [], [], []
            for b in range(len(edges) - 1):
                lo, hi = edges[b], edges[b + 1]
                if hi > lo:
                    x, t = own[lo:hi] - np.uint32(b * BLOCK), twice[lo:hi]
                    blocks.append(b)
                    once_.append(_packed(x[~t]))
                    twice_.append(_packed(x[t]))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int64()), pa.array(blocks, pa.int32()), pa.array(once_, pa.binary()), pa.array(twice_, pa.binary())], names=["part", "block", "once", "twice"])

        n = 0
        for batch in slices(batches, 0, 2 << 20):
            for x in _slots(_windows(batch, 0)[0], slots):
                held.append(x.astype(np.uint32))
                n += len(x)
            if n > HELD:
                yield flush()
                n = 0
        yield flush()

    return run


def _merge(pdf):
    import pandas as pd

    counts = np.zeros(BLOCK, dtype=np.uint8)
    for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
        x = _unpacked(once)
        counts[x] = np.minimum(counts[x] + 1, 2)
        counts[_unpacked(twice)] = 2
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "block": [int(pdf["block"].iloc[0])], "once": [_packed(np.flatnonzero(counts == 1))], "twice": [_packed(np.flatnonzero(counts == 2))]})


def sketched(texts: DataFrame, slots: int) -> np.ndarray:
    """Bits of the slots that count two or more, over all windows of the corpus."""
    schema = "part long, block int, once binary, twice binary"
    parts = max(1, texts.rdd.getNumPartitions())
    rows = texts.mapInArrow(_sketch(slots), schema)
    while True:  # a tree of merges; FAN sketches of a block meet at a time
        rows = rows.withColumn("up", F.floor(F.col("part") / FAN)).groupBy("block", "up").applyInPandas(lambda pdf: _merge(pdf), schema)
        parts = -(-parts // FAN)
        if parts == 1:
            break
    bits = np.zeros(slots // 8, dtype=np.uint8)
    for r in rows.select("block", "twice").toLocalIterator():
        one = np.zeros(BLOCK, dtype=bool)
        one[_unpacked(bytes(r["twice"]))] = True
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.packbits(one)
    return bits


def _estimated(bits: np.ndarray, hashes: np.ndarray, slots: int) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for x in _slots(hashes, slots):
        out &= (bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
    return out


def _second(shared, slots: int, names: list[str]):
    def run(batches):
        import pyarrow as pa

        bits = shared.value
        for batch in slices(batches, 2, 3 << 20):
            h1, row, pos, at = _windows(batch, 2)
            some = _estimated(bits, h1, slots)
            if not some.any():
                continue
            raw, offsets = arrow_bytes(batch.column(2))
            starts, ends, firsts = word_spans(raw, offsets)
            h2 = window_hashes(word_hashes(raw, starts, ends, False, 1), firsts, WINDOW, 1)[0][at][some]
            h1, row, pos = h1[some], row[some], pos[some]
            # Equal neighbours in one document are one run.
            fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)]
            first = np.flatnonzero(fresh)
            run_ = np.diff(np.r_[first, len(h1)])
            h1, h2, row, pos = h1[first], h2[first], row[first], pos[first]
            rid, doc = ids_of(batch.column(0)), ids_of(batch.column(1))
            order = np.lexsort((doc[row], h2, h1))
            h1, h2, row, pos, run_ = h1[order], h2[order], row[order], pos[order], run_[order]
            group = np.cumsum(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) - 1
            lead = doc[row][np.searchsorted(group, np.arange(group[-1] + 1))]
            gone = doc[row] > lead[group]
            g_row, g_pos, g_end = merged(row[gone], pos[gone], pos[gone] + run_[gone])
            keep = ~gone
            n_keep, n_gone = int(keep.sum()), len(g_row)
            spread = mix64((g_row.astype(np.uint64) << np.uint64(32)) + g_pos.astype(np.uint64) + rid[g_row].astype(np.uint64))
            rows_ = np.r_[row[keep], g_row]
            span = (np.r_[pos[keep], g_pos] << 32) | (np.r_[run_[keep], g_end - g_pos] << 1) | np.r_[np.zeros(n_keep, np.int64), np.ones(n_gone, np.int64)]
            tail = (h2[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cols = [pa.array(np.r_[h1[keep], spread].view(np.int64)), pa.array(np.r_[tail, np.zeros(n_gone, np.uint32)].view(np.int32)), pa.array(rid[rows_]), pa.array(span)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(doc[rows_])][: len(names)], names=names)

    return run


def repeated(rows: DataFrame, unique: bool) -> DataFrame:
    """(rid, spans): where windows start that also start in a smaller document."""
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    slots = MIN_SLOTS
    while slots < MAX_SLOTS and slots < chars * 8 // 6:
        slots *= 2
    shared = spark.sparkContext.broadcast(sketched(rows.select("text"), slots))
    release(spark)
    # span packs a start (upper half), a run length and whether the run is settled; doc only where it is not rid.
    kinds = {"h1": "long", "h2": "int", "rid": "long", "span": "long", "doc": "long"}
    names = list(kinds)[: 4 if unique else 5]
    found = rows.mapInArrow(_second(shared, slots, names), ", ".join(f"{n} {kinds[n]}" for n in names))
    order = F.col(names[-1] if not unique else "rid")
    first = F.min(order).over(Window.partitionBy("h1", "h2"))
    late = found.withColumn("first", first).where((F.col("span") % 2 == 1) | (order > F.col("first")))
    pos, run = F.shiftright("span", 32), F.shiftright(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    spans = written(late.groupBy("rid").agg(F.collect_list(F.struct(pos.alias("pos"), run.alias("run"))).alias("spans")), "spans")
    shared.unpersist()
    release(spark)
    return spans


def _kept(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = words_of(text.as_py())
            spans = spans.as_py()
            gone = 0
            n = len(words)
            if spans:
                edge = np.zeros(n + 1, dtype=np.int64)
                at = np.array([s["pos"] for s in spans])
                np.add.at(edge, at, 1)
                np.add.at(edge, np.minimum(at + np.array([s["run"] for s in spans]) + WINDOW - 1, n), -1)
                covered = np.cumsum(edge[:n]) > 0
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out.append((n, gone, " ".join(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.large_string())], names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and the kept words joined by one space."""
    rows, unique = keyed(docs, key, text)
    joined = rows.join(repeated(rows, unique), "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _oracle() -> str:
    later = ", ".join(f"lead(word, {k}) over p" for k in range(1, WINDOW))
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select doc_id, i, word, lead(word, {WINDOW - 1}) over p is not null as whole, concat_ws(' ', word, {later}) as win
      from u window p as (partition by doc_id order by i)),
f as (select win, min(doc_id) as first_id from g where whole group by win),
m as (select g.doc_id, i, word, max(case when whole and first_id < g.doc_id then 1 else 0 end)
             over (partition by g.doc_id order by i rows between {WINDOW - 1} preceding and current row) as gone
      from g left join f using (win)),
k as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from m group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id"""


ORACLE_SQL = _oracle()
