"""Near-duplicates: circulant MinHash signatures, banding, exact Jaccard verification.

Two permutations give every coordinate: shingles are placed by the first (a seeded bijective hash, reduced to
``UNIVERSE`` places), and coordinate k is the least value of the second, shifted circularly by k places.  Reading a
contiguous slice of the shifted table yields all coordinates of a shingle at once.

Documents with equal shingle sets form a class, represented once.  Representatives that share a band form
families (linked through each band's smallest member, so no pairs within a band are listed).  Inside a family the
links are found with union-find: only pairs not yet connected are compared, first by signature, then exactly on
full sets.  A family above ``FAMILY_SHINGLES`` is cut into blocks, and every two blocks meet in a task of their
own, so that no task holds an unbounded group.

A pair at the threshold is missed with a probability of about 3e-6 (32 bands of 5), and the signature test passes
all but some 1e-7 of true links.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; rows that repeat an
id are one document for linking and are each returned; null ids are never linked and are kept; an empty table
gives an empty table; extra columns are ignored by ``components`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, mix64, slices, window_hashes, word_hashes, word_spans, written

BANDS, ROWS = 32, 5
UNIVERSE = 1 << 21
FAMILY_SHINGLES = 1 << 21
HUB, HUBS = 5_000, 50_000
NEAR = 0.6  # signatures that agree on less are not compared exactly
_TABLE: list[np.ndarray] = []


def _shifted() -> np.ndarray:
    """The second permutation, extended so that a slice never wraps."""
    if not _TABLE:
        table = np.random.Generator(np.random.PCG64(0xC1C)).permutation(UNIVERSE).astype(np.int32)
        _TABLE.append(np.concatenate([table, table[: BANDS * ROWS]]))
    return _TABLE[0]


def shingles(batch, column: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and where each row's begin."""
    raw, offsets = arrow_bytes(batch.column(column))
    starts, ends, firsts = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, True)
    hashes, whole = window_hashes(words, firsts, width)
    at = np.flatnonzero(whole)
    row = np.searchsorted(firsts, at, "right") - 1
    n = np.diff(firsts)
    few = np.flatnonzero((n > 0) & (n < width))
    short = np.array([mix64(np.array([int(np.bitwise_xor.reduce(mix64(words[firsts[i] : firsts[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64)))) + int(n[i])], dtype=np.uint64))[0] for i in few], dtype=np.uint64)
    rows, values = np.r_[row, few], np.r_[hashes[at], short].astype(np.uint64)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        fresh = np.r_[True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]
        rows, values = rows[fresh], values[fresh]
    return values, np.searchsorted(rows, np.arange(batch.num_rows + 1))


def signatures(values: np.ndarray, begins: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """(rows, BANDS * ROWS) least values; rows without shingles are all at the largest."""
    table = _shifted()
    k = BANDS * ROWS
    out = np.full((len(begins) - 1, k), UNIVERSE, dtype=np.int32)
    place = (mix64(values ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(table, k)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for lo in range(0, len(place), step):
        here = row[lo : lo + step]
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        least = np.minimum.reduceat(view[place[lo : lo + step]], first, axis=0)
        out[here[first]] = np.minimum(out[here[first]], least)
    return out


def _sign(width: int):
    def run(batches):
        import pyarrow as pa

        salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches, 1, 4 << 20):
            values, begins = shingles(batch, 1, width)
            sig = signatures(values, begins)
            n = np.diff(begins)
            # Equal sets have equal sums of two finalised hashes.
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(values + np.uint64(c)), dtype=np.uint64)]) for c in (1, 0x1234567)]
            own = [(s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums]
            key = np.zeros((len(n), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                key = mix64(key * np.uint64(31) + sig[:, r::ROWS].astype(np.uint64) + salt)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array(key.ravel().view(np.int64)))
            low = (sig & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(own[0]), pa.array(own[1]), bands, pa.array([x.tobytes() for x in low], pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", "low"],
            )

    return run


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges (a, b) as edges from each node to the smallest of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        p, q = label[x], label[y]
        if np.array_equal(p, q):
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(further := label[label], label):
            label = further
    low = np.flatnonzero(label != np.arange(len(ids)))
    return ids[low], ids[label[low]]


def _contracted(batches):
    """Edges of a task as stars, a million edges at a time."""
    import pyarrow as pa

    held, size = [], 0

    def give():
        t = pa.Table.from_batches(held)
        a, b = stars(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 20:
            yield give()
            held, size = [], 0
    if size:
        yield give()


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether the edges are stars (each node has one edge down at most, and none has edges on both sides), and their number."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    r = each.agg(F.max((F.col("down") + F.col("up") > 1).cast("int")).alias("open"), F.sum("down").alias("n")).collect()[0]
    return not r["open"], r["n"] or 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b); every node of an edge is listed.

    Tasks first turn their own edges into stars.  Each round then moves all edges to the smaller neighbour of their
    ends (a large and a small star), so long chains shrink geometrically.  Nodes with more than ``HUB`` neighbours, and
    with more than one ``HUBS``-th of all ends, are joined as a table that is sent to all tasks (it has at most
    ``2 * HUBS`` rows), so that no task gets all edges of such a node.
    """
    now = written(edges.select("a", "b").where("a <> b").mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    while True:
        stars_, n = _state(now)
        if stars_:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        hub = F.col("n") > max(HUB, n // HUBS)
        hubs = least.where(hub).select("a", "m")
        up = both.where("b > a")
        moved = up.join(F.broadcast(hubs), "a").unionByName(up.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(~hub).select("a", "m"), "a"))
        large = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        now = written(small.mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(sets: list[np.ndarray], low: np.ndarray, percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of true links; with `groups`, pairs within one group are left to another task."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    root = np.arange(n)
    out = []
    # Those that resemble most others come first: they connect a family soonest.
    probe = low[np.linspace(0, n - 1, min(n, 24)).astype(int)]
    centre = sum(((low == p).mean(1) for p in probe), np.zeros(n))
    for i in np.argsort(-centre, kind="stable"):
        other = np.flatnonzero((root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        if groups is not None:
            other = other[groups[other] != groups[i]]
        if not len(other):
            continue
        near = (low[other] == low[i]).mean(1)
        for j in other[np.argsort(-near, kind="stable")][: int((near >= NEAR).sum())]:
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def components(docs: DataFrame, width: int = 4, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(d.mapInArrow(_sign(width), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, low binary"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = written(signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "n_shingles", "rep"), "members")
    reps = signed.where("n_shingles > 0").join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id")
    # Bands: each entry is linked with the smallest member of its band.
    entries = written(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band")), "bands")
    heads = entries.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("band", "head")
    star = entries.join(heads, "band").groupBy("rep").agg(F.array_distinct(F.collect_list("head")).alias("heads"))  # BANDS of a document at most
    star = star.select(F.explode(F.array_append("heads", F.col("rep"))).alias("a"), F.array_min("heads").alias("b")).distinct()
    family = written(connected(star), "families")
    sizes = reps.select(F.col("doc_id").alias("node"), "n_shingles").join(family, "node").groupBy("root").agg(F.sum("n_shingles").alias("all"))
    cut = sizes.select("root", F.ceil(F.col("all") * 2 / F.lit(FAMILY_SHINGLES)).alias("cut"))
    family = family.join(cut, "root")
    block = F.when(F.col("cut") <= 2, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("node"), F.col("cut")))
    family = written(family.select("node", "root", "cut", block.alias("block")), "blocks")
    # A block meets each other block of its family (and itself) in one task: (lo, hi) names the pair.
    pairs = F.when(F.col("cut") <= 2, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1))
    told = family.select("node", "root", "block", F.explode(pairs).alias("with")).select("node", "root", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    texts = d.join(family.select(F.col("node").alias("doc_id"), "root").distinct(), "doc_id")

    def shingled(batches):
        import pyarrow as pa

        for batch in slices(batches, 1, 4 << 20):
            values, begins = shingles(batch, 1, width)
            low = (signatures(values, begins) & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], names=["node", "set", "low"])

    def meet(key_, pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["node", "set"])
        nodes = pdf["node"].to_numpy()
        apart = pdf["block"].to_numpy() if key_[1] != key_[2] else None
        low = np.frombuffer(b"".join(pdf["low"]), dtype=np.uint8).reshape(len(pdf), -1)
        got = linked([np.frombuffer(x, dtype=np.uint64) for x in pdf["set"]], low, percent, apart)
        a, b = stars(nodes[[i for i, _ in got]].astype(np.int64), nodes[[j for _, j in got]].astype(np.int64))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    sets = texts.select("doc_id", "text").mapInArrow(shingled, "node long, set binary, low binary")
    links = told.join(sets, "node").groupBy("root", "lo", "hi").applyInPandas(meet, "a long, b long")
    found = connected(links).withColumnRenamed("node", "rep")
    out = members.join(found, "rep", "left").withColumn("component_id", F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component, all columns unchanged."""
    gone = components(docs, width, percent, key, text).where("not kept").select(F.col("doc_id").alias("__hl_gone")).distinct()
    return docs.join(gone, docs[key] == gone["__hl_gone"], "left_anti")


# All pairs that share a shingle, and their closure: for small tables.
ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
two as (select a as x, b as y from e union all select b, a from e),
r as (select doc_id, doc_id as reach from documents union select r.doc_id, two.y from r join two on r.reach = two.x),
c as (select doc_id, min(reach) as component_id from r group by doc_id)
select c.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id"""
