"""Repeated byte strings, marked with run-length indexes over buckets of the corpus.

Two equal strings of ``LENGTH`` bytes hold the same smallest hash of a ``GRAM``-byte string.  Consecutive windows
with the same smallest hash form a segment, and segments meet by that hash (their anchor):

1. Segments whose anchor occurs nowhere else hold no repeats and go no further.  Equal segments keep their first occurrence; all
   windows of the others are repeats.
2. What is left - different segments with one anchor - goes into an index per bucket of anchors: a run-compressed
   Burrows-Wheeler transform, of which only the samples at run boundaries are kept (text position, neighbour in
   suffix order, match length).  Streaming over the text, each position's neighbour and match length follow from the
   last sample before it; matches of LENGTH bytes or more are chained, and all but the first of a chain are marked.
3. An anchor with more than ``INDEX_BYTES`` of different segments is not indexed in one task: its windows are
   grouped by Spark on 128-bit keys instead.

On the test tables some 22 % of repeated windows are settled by the index, all others as copies of equal segments: these
are whole copies of documents and passages, which an index would hold as many times.

Defined cases: null and empty texts have no bytes; very long texts are cut into segments like all others; shorter texts keep all; rows that repeat an id are ordered by an
internal row number; null ids come last; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASES, _BYTE, _INVERSES, _powers, arrow_bytes, ids_of, keyed, merged, mix64, release, slices, written

LENGTH, GRAM = 100, 32
INDEX_BYTES = 3 << 20


def _prefix(raw: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[which][raw] * _powers(_BASES[which], len(raw)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hashes of raw[lo:hi], from prefix sums."""
    return mix64((sums[hi] - sums[lo]) * _powers(_INVERSES[which], len(sums))[lo] + (hi - lo).astype(np.uint64))


def _sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    """op over every `span` neighbours."""
    width = 1
    while width * 2 <= span:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def segments(raw: np.ndarray, offsets: np.ndarray):
    """(row, start in the row, windows, anchor, content hash, whether the anchor occurs twice) of all segments of a batch."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    sums = _prefix(raw, 0)
    at = np.arange(len(raw) - GRAM + 1)
    grams = _hash(sums, at, at + GRAM, 0)
    span = LENGTH - GRAM + 1
    least = _sliding(grams, span, np.minimum)
    row_ends = offsets[1:] - LENGTH + 1
    whole = np.zeros(n + 1, dtype=np.int32)
    some = row_ends > offsets[:-1]
    np.add.at(whole, offsets[:-1][some], 1)
    np.add.at(whole, row_ends[some], -1)
    inside = np.cumsum(whole[:n]) > 0
    fresh = inside.copy()
    fresh[1:] &= (least[1:n] != least[: n - 1]) | ~inside[:-1]
    fresh[offsets[:-1][some]] = True
    starts = np.flatnonzero(fresh)
    row = np.searchsorted(offsets, starts, "right") - 1
    stop = np.minimum(np.r_[starts[1:], n], row_ends[row])
    # Where a gram is the smallest of some window; a segment that holds its anchor twice may repeat itself.
    most = _sliding(np.r_[np.repeat(least[:1], span - 1), least, np.repeat(least[-1:], span - 1)], span, np.maximum)
    spot = np.flatnonzero(grams == most)
    values, group = np.unique(grams[spot], return_inverse=True)
    places = np.sort(group * (len(raw) + 1) + spot)
    base = np.searchsorted(values, least[starts]) * (len(raw) + 1)
    twice = np.searchsorted(places, base + stop + span - 1) - np.searchsorted(places, base + starts) > 1
    return row, starts - offsets[row], stop - starts, least[starts], _hash(sums, starts, stop + LENGTH - 1, 0), twice


def _cut(batches):
    import pyarrow as pa

    for batch in slices(batches, 2, 2 << 20):
        raw, offsets = arrow_bytes(batch.column(2))
        row, start, n, anchor, content, twice = segments(raw, offsets)
        if not len(row):
            continue
        rid, doc = ids_of(batch.column(0)), ids_of(batch.column(1))
        order = np.lexsort((start, rid[row], doc[row], content, anchor))
        row, start, n, anchor, content, twice = (x[order] for x in (row, start, n, anchor, content, twice))
        gone = np.r_[False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])]
        g_row, g_start, g_end = merged(row[gone], start[gone], start[gone] + n[gone])
        keep = ~gone
        rows = np.r_[row[keep], g_row]
        spread = mix64((g_row.astype(np.uint64) << np.uint64(32)) + g_start.astype(np.uint64) + rid[g_row].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[anchor[keep], spread].view(np.int64)),
                pa.array(np.r_[content[keep], np.zeros(len(g_row), np.uint64)].view(np.int64)),
                pa.array(doc[rows]),
                pa.array(rid[rows]),
                # start, windows, whether the anchor occurs twice, whether the windows are settled repeats
                pa.array((np.r_[start[keep], g_start] << 32) | (np.r_[n[keep], g_end - g_start] << 2) | np.r_[twice[keep].astype(np.int64) << 1, np.ones(len(g_row), np.int64)]),
            ],
            names=["anchor", "content", "doc", "rid", "span"],
        )


def _told_apart(batches):
    """From rows sorted by anchor, content and order: later equal segments (settled), and segments whose anchor has others."""
    import pyarrow as pa

    held = None  # the last first-of-its-content row so far: (anchor, content, doc, rid, span, already given)

    def rows(anchor, doc, rid, span, settled):
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(rid), pa.array(span >> 32), pa.array((span >> 2) & 0x3FFFFFFF), pa.array(settled)], names=["anchor", "doc", "rid", "start", "n", "settled"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, content, doc, rid, span = (batch.column(i).to_numpy() for i in range(5))
        done = (span & 1) == 1
        if done.any():
            yield rows(anchor[done], doc[done], rid[done], span[done], np.ones(int(done.sum()), bool))
            anchor, content, doc, rid, span = (x[~done] for x in (anchor, content, doc, rid, span))
        if not len(anchor):
            continue
        a0, c0 = (held[0], held[1]) if held else (None, None)
        same = np.r_[held is not None and anchor[0] == a0 and content[0] == c0, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])]
        if same.any():
            yield rows(anchor[same], doc[same], rid[same], span[same], np.ones(int(same.sum()), bool))
        first = [x[~same] for x in (anchor, content, doc, rid, span)]
        if held is not None:
            first = [np.r_[h, x] for h, x in zip(held[:5], first, strict=True)]
        m = len(first[0])
        if m:
            like = np.r_[False, first[0][1:] == first[0][:-1], False]
            many = like[:-1] | like[1:]
            give = many | ((first[4] & 2) == 2)
            given = give.copy()
            if held is not None:
                given[0] |= held[5]
                give[0] &= not held[5]
            if give.any():
                yield rows(first[0][give], first[2][give], first[3][give], first[4][give], np.zeros(int(give.sum()), bool))
            held = (*(x[-1] for x in first), bool(given[-1]))


# ---------------------------------------------------------------- the index
def suffix_order(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and ranks of `text`; position ends[i] holds separator i, smaller than all bytes and unlike any other."""
    n = len(text)
    cell = text.astype(np.uint64) + np.uint64(1)
    cell[ends] = 0
    step = 7
    key, alive = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    ended = np.zeros(n, dtype=np.int64)  # 1 + the separator met within the first bytes
    which = np.searchsorted(ends, np.arange(n))
    for k in range(step):
        here = np.zeros(n, dtype=np.uint64)
        here[: n - k] = cell[k:]
        here[~alive] = 0
        key = key * np.uint64(257) + here
        stop = alive & (here == 0)
        ended[stop] = which[stop] + 1
        alive &= here != 0
    order = np.lexsort((ended, key))
    fresh = np.r_[True, (key[order][1:] != key[order][:-1]) | (ended[order][1:] != ended[order][:-1])]
    del key, cell
    place = np.flatnonzero(fresh)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(place, np.diff(np.r_[place, n]))
    size = np.diff(np.r_[place, n])
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in suffix order that are not settled
    while len(open_):
        sub = order[open_]
        after = sub + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[sub]
        by = np.lexsort((second, group))
        sub, second, group = sub[by], second[by], group[by]
        order[open_] = sub
        head = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        place = open_[np.flatnonzero(head)]
        size = np.diff(np.r_[np.flatnonzero(head), len(sub)])
        rank[sub] = np.repeat(place, size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order, rank


class RunIndex:
    """Samples at the run boundaries of the Burrows-Wheeler transform: position, neighbour, match length."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        order, _ = suffix_order(text, ends)
        before = order - 1
        letter = np.where(before >= 0, text[before].astype(np.int64), -1)
        barrier = np.zeros(len(text) + 1, dtype=bool)
        barrier[ends + 1] = True
        barrier[0] = True
        head = np.r_[True, (letter[1:] != letter[:-1]) | barrier[order[1:]] | barrier[order[:-1]]]
        at = np.flatnonzero(head)
        self.runs = len(at)
        position = order[at]
        neighbour = np.where(at > 0, order[at - 1], -1)
        by = np.argsort(position)
        self.position, self.neighbour = position[by], neighbour[by]
        self.match = self._matches(text, ends)

    def _matches(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        limit = ends[np.searchsorted(ends, self.position)] - self.position
        other = np.where(self.neighbour >= 0, self.neighbour, 0)
        limit = np.minimum(limit, ends[np.searchsorted(ends, other)] - other)
        limit[self.neighbour < 0] = 0
        got = np.zeros(len(limit), dtype=np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            differ = words[self.position[live] + got[live]] != words[other[live] + got[live]]
            same = np.where(differ.any(1), differ.argmax(1), 8)
            got[live] = np.minimum(got[live] + same, limit[live])
            live = live[(same == 8) & (got[live] < limit[live])]
        return got

    def stream(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every text position, in order: its neighbour in suffix order and the length they share."""
        at = np.arange(n)
        last = np.searchsorted(self.position, at, "right") - 1
        past = at - self.position[last]
        return self.neighbour[last] + past, self.match[last] - past


def first_places(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position, the first position with the same LENGTH bytes (itself, if there are none or too few bytes)."""
    n = len(text)
    neighbour, match = RunIndex(text, ends).stream(n)
    chain = np.where(match >= LENGTH, neighbour, np.arange(n))
    while True:
        further = chain[chain]
        if np.array_equal(further, chain):
            break
        chain = further
    first = np.full(n, n, dtype=np.int64)
    np.minimum.at(first, chain, np.arange(n))
    return first[chain]


def _indexed(batches, most: int = INDEX_BYTES):
    """Rows (anchor, doc, rid, start, bytes) sorted by anchor; gives settled windows, or open windows of anchors of more than `most` bytes."""
    import pyarrow as pa

    names = ["h1", "h2", "doc", "rid", "start", "n", "settled"]

    def give(h1, h2, doc, rid, start, n, settled):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, doc, rid, start, n, settled)], names=names)

    def index(rows):
        if not rows:
            return None
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        lengths = np.array([len(r[4]) for r in rows])
        ends = np.cumsum(lengths + 1) - 1
        text = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", dtype=np.uint8)
        late = first_places(text, ends) < np.arange(len(text))
        late[ends] = False
        at = np.flatnonzero(late)
        if not len(at):
            return None
        which = np.searchsorted(ends, at)
        start = at - (ends[which] - lengths[which]) + np.array([r[3] for r in rows])[which]
        rid = np.array([r[2] for r in rows])[which]
        rid, s, e = merged(rid, start, start + 1)
        return give(mix64(rid.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64)).view(np.int64), np.zeros(len(s), np.int64), rid, rid, s, e - s, np.ones(len(s), bool))

    def spell(rows):
        """Windows as keys, for an anchor that is too large for one index."""
        for _, doc, rid, start, raw in rows:
            raw = np.frombuffer(raw, dtype=np.uint8)
            lo = np.arange(len(raw) - LENGTH + 1)
            keys = [_hash(_prefix(raw, w), lo, lo + LENGTH, w).view(np.int64) for w in (0, 1)]
            yield give(*keys, np.full(len(lo), doc), np.full(len(lo), rid), lo + start, np.ones(len(lo), np.int64), np.zeros(len(lo), bool))

    ready: list[tuple] = []  # whole anchors
    own: list[tuple] = []  # the current anchor
    ready_bytes = own_bytes = 0
    spelling, current = False, None
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if r[0] != current:
                ready += own
                ready_bytes += own_bytes
                own, own_bytes, spelling, current = [], 0, False, r[0]
                if ready_bytes > most:
                    if (out := index(ready)) is not None:
                        yield out
                    ready, ready_bytes = [], 0
            own.append(r)
            own_bytes += len(r[4])
            if spelling or own_bytes > most:
                spelling = True
                yield from spell(own)
                own, own_bytes = [], 0
    if (out := index(ready + own)) is not None:
        yield out


def _spelled(batches):
    """Bytes of the listed segments of each text."""
    import pyarrow as pa

    for batch in batches:
        out: list[tuple] = []
        for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            out += [(w["anchor"], w["doc"], w["rid"], w["start"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in want]
            if len(out) > 20_000:
                yield _batch(pa, out)
                out = []
        yield _batch(pa, out)


def _batch(pa, rows: list[tuple]):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["anchor", "doc", "rid", "start", "raw"])


def repeated(rows: DataFrame, most: int = INDEX_BYTES) -> DataFrame:
    """(rid, spans): where windows of LENGTH bytes start that also start earlier."""
    spark = rows.sparkSession
    cut = rows.mapInArrow(_cut, "anchor long, content long, doc long, rid long, span long")
    sorted_ = cut.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "rid", F.shiftright("span", 32))
    told = written(sorted_.mapInArrow(_told_apart, "anchor long, doc long, rid long, start long, n long, settled boolean"), "segments")
    release(spark)
    want = told.where("not settled").groupBy("rid").agg(F.collect_list(F.struct("anchor", "doc", "rid", "start", "n")).alias("want"))
    open_ = rows.join(want, "rid").select("text", "want").mapInArrow(_spelled, "anchor long, doc long, rid long, start long, raw binary")
    open_ = open_.repartition("anchor").sortWithinPartitions("anchor")
    found = written(open_.mapInArrow(lambda batches: _indexed(batches, most), "h1 long, h2 long, doc long, rid long, start long, n long, settled boolean"), "matches")
    release(spark)
    # Only anchors too large for an index leave open windows; these are grouped exactly.
    least = found.where("not settled").groupBy("h1", "h2").agg(F.min(F.struct("doc", "rid", "start")).alias("first"))
    loose = found.where("not settled").join(least, ["h1", "h2"]).where(F.struct("doc", "rid", "start") > F.col("first")).select("rid", "start", "n")
    late = told.where("settled").select("rid", "start", "n").unionByName(found.where("settled").select("rid", "start", "n")).unionByName(loose)
    return late.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _kept(batches):
    import pyarrow as pa

    for batch in batches:
        n_, gone_, spans_, kept_ = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            total, gone, runs = len(raw), 0, 0
            if spans:
                start = np.array([s["start"] for s in spans])
                end = np.minimum(start + np.array([s["n"] for s in spans]) + LENGTH - 1, total)
                _, s, e = merged(np.zeros(len(start), np.int64), start, end)
                gone, runs = int((e - s).sum()), len(s)
                raw = b"".join(raw[a:b] for a, b in zip(np.r_[0, e], np.r_[s, total], strict=True))
            n_.append(total), gone_.append(gone), spans_.append(runs), kept_.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_, pa.int64()), pa.array(gone_, pa.int64()), pa.array(spans_, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept_], pa.string()), pa.array(kept_, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    rows, _ = keyed(docs, key, text)
    joined = rows.join(repeated(rows, most), "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame, most: int = INDEX_BYTES) -> DataFrame:
    return deduplicated(docs, most=most).drop("kept")
