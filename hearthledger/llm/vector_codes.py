"""Compression of vectors to short codes: one integer codebook for each of ``PARTS`` equal parts, fitted by Lloyd's rounds
that are kept up to date by differences.

Components become integers, floor(``SCALE`` * x), so that every sum is exact and no order of adding changes it.  A part's codebook
starts as that part of the ``ENTRIES`` rows with the smallest ids.  A round

1. assigns every part to its nearest entry in the tasks that hold the vectors and writes vectors, the assignment before and
   the one now to the shared folder (the state of the round before is deleted then);
2. adds, for parts whose assignment changed only, the part to its new entry and takes it from its old one.  Only these
   sums are shuffled, a row for each task, part, entry and component at most; vectors never are.  The driver holds the running sums
   and counts: PARTS * ENTRIES * (components of a part + 1) integers, whatever the number of rows.

New entries are floor(sum / count); unused ones stay.  After the last round parts are assigned once more: those entries are a
row's code.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and so are those whose
number of components is not the most frequent one (of equally frequent ones the smallest) or that have none.  A number of components that PARTS does not
divide raises ValueError.  Components of 16,384 or more in size raise ValueError, so that squared distances fit a long.  A null id sorts last
and keeps its row; rows that repeat an id are rows of their own, in order of their integers where they may start a codebook.
With fewer rows than ENTRIES there are fewer entries.  Null labels are one label.  An empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26  # of an integer component
LABELS = 100_000  # so many sums of labels are broadcast; more are joined


def integers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, x): whole-number components of the rows that take part."""
    d = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    d = d.where((F.size("v") > 0) & F.forall("v", fine))
    usual = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    size = usual[0]["n"] if usual else PARTS
    if size % PARTS:
        raise ValueError(f"{size} components can't be cut into {PARTS} equal parts")
    whole = lambda y: F.when(F.abs(y * float(SCALE)) < LARGEST, F.floor(y * float(SCALE))).otherwise(F.raise_error(F.lit("components of 16,384 or more have no code")).cast("long")).cast("int")
    return d.where(F.size("v") == size).select("id", "label", F.transform("v", whole).alias("x"))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of every part, squared distance), both rows x PARTS.  x: rows x PARTS x length; books: PARTS x entries x length; ties go to the lower entry."""
    entry = np.empty(x.shape[:2], dtype=np.uint8)
    far = np.empty(x.shape[:2], dtype=np.int64)
    for p, book in enumerate(books):
        own = x[:, p].astype(np.int64)
        # |c|^2 - 2 x c orders entries as the squared distance does
        order = (book * book).sum(1) - 2 * np.einsum("ij,kj->ik", own, book)
        best = order.argmin(1)
        entry[:, p] = best
        far[:, p] = order[np.arange(len(own)), best] + (own * own).sum(1)
    return entry, far


def moved(x: np.ndarray, before: np.ndarray | None, now: np.ndarray, entries: int) -> np.ndarray:
    """PARTS x entries x (length + 1): what the changed parts add to sums and counts, and take from them."""
    rows, parts, length = x.shape
    out = np.zeros((parts, entries, length + 1), dtype=np.int64)
    for p in range(parts):
        changed = np.flatnonzero(now[:, p] != before[:, p]) if before is not None else np.arange(rows)
        given = np.concatenate([x[changed, p].astype(np.int64), np.ones((len(changed), 1), np.int64)], axis=1)
        np.add.at(out[p], now[changed, p], given)
        if before is not None:
            np.subtract.at(out[p], before[changed, p], given)
    return out


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PARTS, width // PARTS)


def _codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), PARTS)


def assigned(state: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The state with assignments under `books`: `before` is the one that it had (null at first), `now` the new one."""
    first = "now" not in state.columns
    kind = dict(state.dtypes)

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), width)
            now, far = nearest(x, books)
            was = pa.nulls(batch.num_rows, pa.binary()) if first else batch.column(3)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), was, pa.array([r.tobytes() for r in now], pa.binary()), pa.array(far.sum(1), pa.int64())], names=["id", "label", "x", "before", "now", "error"])

    kept = state.select("id", "label", "x", *([] if first else ["now"]))
    return kept.mapInArrow(go, f"id {kind['id']}, label {kind['label']}, x array<int>, before binary, now binary, error long")


def changes(state: DataFrame, entries: int, width: int) -> DataFrame:
    """(part, entry, place, added): sums over the parts whose assignment changed; place `width / PARTS` is the count."""

    def go(batches):
        import pyarrow as pa

        total = np.zeros((PARTS, entries, width // PARTS + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x, now = _matrix(batch.column(0), width), _codes(batch.column(2))
                total += moved(x, None if batch.column(1).null_count else _codes(batch.column(1)), now, entries)
        part, entry, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total[part, entry, place], pa.int64())], names=["part", "entry", "place", "added"])

    other = state.where("before is null or before <> now").select("x", "before", "now")
    return other.mapInArrow(go, "part int, entry int, place int, added long").groupBy("part", "entry", "place").agg(F.sum("added").alias("added"))


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(books, state): codebooks (PARTS x entries x length) after `rounds` rounds and rows (id, label, x, now, error) coded by them."""
    state = written(rows, "integers")
    first = state.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64), assigned(state, np.zeros((PARTS, 1, 1), np.int64), PARTS)
    width, entries = len(first[0]["x"]), len(first)
    books = np.array([r["x"] for r in first], dtype=np.int64).reshape(entries, PARTS, width // PARTS).transpose(1, 0, 2).copy()
    sums = np.zeros((PARTS, entries, width // PARTS + 1), dtype=np.int64)
    for k in range(rounds):
        earlier, state = state, written(assigned(state, books, width), f"round-{k}")
        dropped(earlier)
        for r in changes(state, entries, width).collect():  # PARTS * ENTRIES * (length + 1) rows at most
            sums[r["part"], r["entry"], r["place"]] += r["added"]
        used = sums[:, :, -1] > 0
        books[used] = sums[used][:, :-1] // sums[used][:, -1:]
    earlier, state = state, written(assigned(state, books, width), "coded")
    dropped(earlier)
    return books, state


def decoded(codes: list[bytes], books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in the scale of the originals (the middle of the integer's range)."""
    at = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    return (np.concatenate([books[p][at[:, p]] for p in range(at.shape[1])], axis=1) + 0.5) / SCALE


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, now, error) of each row that takes part (`now`: its code, a byte for each part), and the codebooks."""
    books, state = fitted(integers(vectors, key, vector, label))
    return state.select("id", "label", "now", "error"), books


def digest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per coded vector: its code in hexadecimal digits, its error, that of its label, and the hash of all codebooks."""
    coded, books = compressed(vectors, key, vector, label)
    held = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    sums = F.broadcast(sums) if sums.count() <= LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), F.lower(F.hex("now")).alias("code"), "error", "label_error", F.lit(held).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The same in SQL: each round is a pair of CTEs, nearest entries and new books."""
    parts, entries = PARTS, ENTRIES
    steps = [
        f"""kept as (select vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::double)::bigint) as x from embeddings where embedding is not null and len(embedding) > 0
 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0)""",
        f"""part as materialized (select row, vec_id, label, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] as y
 from (select *, row_number() over (order by vec_id nulls last, x) - 1 as row from kept), range({parts}) r(p))""",
        f"book0 as materialized (select p, row as e, y as c from part where row < {entries})",
    ]
    near = """select row, vec_id, label, p, y, arg_min(e, (d, e)) as e, min(d) as d from
 (select part.*, e, list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from part join book{k} b using (p)) group by all"""
    near = near.replace("group by all", "group by row, vec_id, label, p, y")
    for k in range(ROUNDS):
        steps += [
            f"near{k} as materialized ({near.format(k=k)})",
            f"""sum{k} as (select p, e, i, sum(y[i])::bigint as s, count(*) as n from near{k}, range(1, (select max(len(y)) + 1 from part)) r(i) group by all)""",
            f"""book{k + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from book{k} b left join (select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from sum{k} group by all) m using (p, e))""",
        ]
    last = ROUNDS
    return f"""with {', '.join(steps)}, coded as (select row, vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from ({near.format(k=last)}) group by all),
by_label as (select label, sum(error)::bigint as label_error from coded group by all),
held as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{last})
select vec_id, code, error, label_error, codebooks_sha256 from coded join by_label on coded.label is not distinct from by_label.label, held"""


ORACLE_SQL = _oracle()
