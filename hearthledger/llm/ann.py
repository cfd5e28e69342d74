"""Approximate nearest neighbours by cosine: inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on at most ``FIT_ROWS`` vectors (those with the smallest hash of their
id); every vector is indexed.  Equal vectors share one index entry that keeps its ``TOP + 1`` smallest ids, which
loses nothing in a top-``TOP`` with ties to smaller ids.  Queries probe the cells that a calibration on the fitted
sample found to hold ``RECALL`` of true neighbours; a cell's entries and queries meet in blocks of bounded size.
There asymmetric distance tables rank entries.  The exact scores of the best ``RERANK`` of a cell only set a floor: all
entries whose coded score, raised by the length of what their code leaves out, reaches the floor are scored exactly, so
that codes lose no neighbour, however many entries are nearly equal.  A block returns its best ``TOP + 1`` of a query,
times the most vectors that one id has.  Queries that find fewer than ``TOP`` ids in their cells are asked again of
``WIDER`` times as many cells, at last of all.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; null ids neither; rows that repeat an id count once for each distinct vector; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOP, RERANK, RECALL = 5, 128, 0.985
FIT_ROWS, MAX_CELLS, SUBSPACES, CODES = 20_000, 1024, 16, 256
SHELF, ENTRIES, QUERIES_A_BLOCK = 16, 8192, 16_384
QUERIES_AT_ONCE = 512
WIDER = 4
DIGITS = 12  # scores that agree to so many digits are ties


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        some = n > 0
        centres[some] = sums[some] / n[some, None]
        centres[~some] = x[rng.integers(0, len(x), int((~some).sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


class Model:
    """Centroids, codebooks and the number of cells to probe."""

    def __init__(self, sample: np.ndarray, total: int):
        x = _unit(sample)
        self.dim = x.shape[1]
        self.cells = kmeans(x, int(max(1, min(MAX_CELLS, np.sqrt(total), len(x)))))
        rest = x - self.cells[nearest(x, self.cells)]
        self.cuts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [kmeans(rest[:, c], min(CODES, len(rest)), seed=11 + i) for i, c in enumerate(self.cuts)]
        self.probes = self._calibrated(x)

    def _calibrated(self, x: np.ndarray) -> int:
        asked = x[:: max(1, len(x) // 400)]
        near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : TOP + 1]
        order = np.argsort(-(asked @ self.cells.T), axis=1)
        place = np.argsort(order, axis=1)
        ranks = np.take_along_axis(place, nearest(x, self.cells)[near], axis=1).ravel() if near.size else np.zeros(1)
        return int(np.quantile(ranks, RECALL)) + 1

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes of x leave out."""
        rest = x - self.cells[cell]
        return np.sqrt(sum(((rest[:, c] - b[codes[:, j]]) ** 2).sum(1) for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))))

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(x @ self.cells.T), axis=1, kind="stable")[:, :probes]

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of queries (rows) with coded entries of a cell (columns)."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), axis=1)
        for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (queries[:, c] @ b.T)[:, codes[:, j]]
        return out


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each row: high scores first, then small ids."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r, "left") < n]


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """The n highest scores of each row, in any order."""
    return -np.partition(-scores, n - 1, axis=1)[:, :n] if scores.shape[1] > n else scores


def best_of_block(model: Model, q: np.ndarray, probed: list, cells: np.ndarray, codes: np.ndarray, errors: np.ndarray, v: np.ndarray, ids: np.ndarray, n: int):
    """(query, entry, exact score): the n best entries of each query in the cells that it probes; q and v have length 1."""
    asks = np.repeat(np.arange(len(q)), [len(p) for p in probed])
    cell_of_ask = np.concatenate([np.asarray(p) for p in probed])
    high = np.full((len(q), n), -np.inf)
    found = []
    for cell in np.unique(cells):
        at, mine = np.flatnonzero(cells == cell), asks[cell_of_ask == cell]
        for i in range(0, len(mine), QUERIES_AT_ONCE):
            part = mine[i : i + QUERIES_AT_ONCE]
            coded = model.scores(q[part], int(cell), codes[at])
            floor = high[part].min(1)
            if len(at) > (some := max(RERANK, n)):
                likely = np.argpartition(-coded, some, axis=1)[:, :some]
                floor = np.maximum(floor, _top(np.stack([v[at[few]] @ x for few, x in zip(likely, q[part], strict=True)]), n).min(1))
            # A code's score is off by no more than the length of what the code leaves out.
            here = at[(coded + errors[at] >= floor[:, None] - 1e-9).any(0)]
            if not len(here):
                continue
            exact = np.round(q[part] @ v[here].T, DIGITS)
            high[part] = _top(np.concatenate([high[part], exact], axis=1), n)
            r, e = np.nonzero(exact >= high[part].min(1)[:, None])
            keep = _best(r, exact[r, e], ids[here[e]], n)
            found.append((part[r[keep]], here[e[keep]], exact[r[keep], e[keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, entries, scores = map(np.concatenate, zip(*found, strict=True))
    keep = _best(rows, scores, ids[entries], n)
    return rows[keep], entries[keep], scores[keep]


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    d = d.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return d.where(F.size("v") == (usual[0]["n"] if usual else 0))


def _scores(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def search(vectors: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The TOP nearest of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = valid(vectors, key, vector)
    keep = TOP + 1
    some = F.pmod(F.xxhash64("id"), F.lit(64))
    ids = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    # Ids of equal vectors: a salted first level, so that no task gathers more than a share of a large group.
    entries = rows.groupBy("v", some.alias("salt")).agg(ids(F.collect_set("id")).alias("ids")).groupBy("v").agg(ids(F.flatten(F.collect_list("ids"))).alias("ids"))
    entries = written(entries.withColumn("entry", F.xxhash64("v", F.element_at("ids", 1))), "entries")
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # So many entries hold TOP + 1 different ids at least.
    most = keep * entries.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).collect()[0][0]
    sample = entries.select("v", "entry").orderBy(F.xxhash64("entry"), "entry").limit(FIT_ROWS).select("v").toPandas()["v"]
    model = Model(np.array(sample.tolist()), total)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_CELLS centroids and SUBSPACES * CODES codewords

    def encode(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x = _unit(np.array(pdf["v"].tolist()))
                cell, codes = shared.value.encoded(x)
                yield pd.DataFrame({"entry": pdf["entry"], "first": pdf["first"], "cell": cell, "code": [c.tobytes() for c in codes], "error": shared.value.errors(x, cell, codes), "v": pdf["v"]})

    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"  # vectors travel as they came
    small = F.col("v").cast(f"array<{kind}>").alias("v")
    index = written(entries.select("entry", F.element_at("ids", 1).alias("first"), small).mapInPandas(encode, f"entry long, first long, cell int, code binary, error double, v array<{kind}>"), "index")
    asked = written(rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"]).withColumn("asked", F.xxhash64("id", "v")), "asked")
    index = index.withColumn("shelf", F.floor(F.col("cell") / F.lit(SHELF)).cast("int"))
    sizes = {r["shelf"]: -(-r["n"] // ENTRIES) for r in index.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    count_up = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def meet(entries_, queries_):
        import pandas as pd

        if not len(entries_) or not len(queries_):
            return pd.DataFrame({"asked": [], "entry": [], "first": [], "near": []})
        codes = np.frombuffer(b"".join(entries_["code"]), dtype=np.uint8).reshape(len(entries_), -1)
        q, v = (_unit(np.array(x.tolist(), dtype=np.float64)) for x in (queries_["q"], entries_["v"]))
        first = entries_["first"].to_numpy()
        rows_, at, near = best_of_block(shared.value, q, queries_["cells"].tolist(), entries_["cell"].to_numpy(), codes, entries_["error"].to_numpy(), v, first, most)
        return pd.DataFrame({"asked": queries_["asked"].to_numpy()[rows_], "entry": entries_["entry"].to_numpy()[at], "first": first[at], "near": near})

    def asked_of(queries: DataFrame, probes: int) -> DataFrame:
        """The TOP nearest of queries among the entries of so many cells each."""

        def probe(batches):
            import pandas as pd

            for pdf in batches:
                if len(pdf):
                    # One row for each shelf that a query probes, with its cells there.
                    cells = np.sort(shared.value.probed(_unit(np.array(pdf["v"].tolist())), probes), axis=1)
                    rows_, parts = [], []
                    for i, own in enumerate(cells):
                        cut = np.split(own, np.flatnonzero(np.diff(own // SHELF)) + 1)
                        rows_ += [i] * len(cut)
                        parts += cut
                    yield pd.DataFrame({"asked": pdf["asked"].to_numpy()[rows_], "q": pdf["v"].to_numpy()[rows_], "shelf": [int(c[0]) // SHELF for c in parts], "cells": parts})

        asks = queries.select("asked", small).mapInPandas(probe, f"asked long, q array<{kind}>, shelf int, cells array<int>")
        # A shelf is a few cells.  Its entries lie in blocks by hash, and so do the queries that probe it; blocks meet once.
        # Entries are copied once for each block of queries of their own shelf, and not at all where none asks.
        wide = {r["shelf"]: r["n"] // QUERIES_A_BLOCK + 1 for r in asks.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
        shelves = spark.createDataFrame([(int(s), int(n), int(wide[s])) for s, n in sizes.items() if s in wide], "shelf int, blocks long, wide long")
        left = index.join(F.broadcast(shelves), "shelf").select("shelf", F.pmod(F.xxhash64("entry"), "blocks").alias("eb"), count_up(F.col("wide")).alias("qb"), "cell", "entry", "first", "code", "error", "v")
        right = asks.join(F.broadcast(shelves), "shelf").select("shelf", count_up(F.col("blocks")).alias("eb"), F.pmod(F.xxhash64("asked"), F.col("wide")).alias("qb"), "cells", "asked", "q")
        found = left.groupBy("shelf", "eb", "qb").cogroup(right.groupBy("shelf", "eb", "qb")).applyInPandas(meet, "asked long, entry long, first long, near double")
        turn = Window.partitionBy("asked").orderBy(F.desc("near"), "first")
        found = found.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("asked", "entry")
        found = found.join(queries.select("asked", F.col("id").alias("query_id"), F.col("v").alias("q")), "asked")
        exact = found.join(entries, "entry").select("query_id", _scores("q", "v").alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        exact = exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "vec_id")
        return exact.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= TOP).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    probes, cells, out = model.probes, len(model.cells), None
    while True:
        near = written(asked_of(asked, probes), "near")
        whole = near.where(F.col("rank") == TOP).select("query_id")
        short = asked.join(whole, asked["id"] == whole["query_id"], "left_anti")
        again = probes < cells and not short.isEmpty()
        done = near.join(whole, "query_id", "left_semi").select(near.columns) if again else near
        out = done if out is None else out.unionByName(done)
        if not again:
            return out
        asked, probes = written(short, "short"), min(WIDER * probes, cells)
