"""Shared helpers of the corpus operators: table access, durable cuts of lineage, word splitting.

Words are maximal runs of bytes other than space and \\t..\\r.  In UTF-8 those six bytes never occur
inside a multi-byte character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthledger import ship

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
GAP_RE = r"[\x20\x09-\x0D]+"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- durable cuts of lineage
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Where none is set: one in the warehouse, or, if all of Spark runs in this process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="hearthledger-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/hearthledger-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
        _forget_later(spark, found)
    return found


def _forget_later(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session's JVM may have gone already
            pass

    atexit.register(remove)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_later(spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again.cut = path
    return again


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave and that no later plan reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.cut)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now: it does so once their handles on the driver are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- words
def lower_ascii(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # fixed: the 26 letters of ASCII
    return F.translate(col, upper, upper.lower())


def words_of(text: str | None, lower: bool = False) -> list[str]:
    if not text:
        return []
    return WORD_RE.findall(text.translate(_LOWER) if lower else text)


def n_words(col: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, hence invertible modulo 2**64
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_BLOCK = 1 << 18  # bytes hashed at once; tables of powers are that long
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _BLOCK + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(c)) for c in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document...) of all words; no word crosses a document."""
    inside = ~_SEP[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial, then finalised), in blocks of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    base, inverse, table_ = _BASES[which], _INVERSES[which], _BYTE[which]
    while i < n:
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = ends[j - 1]
        block = raw[lo:hi]
        terms = table_[_LOW[block] if lower else block] * _powers(base, len(block))
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(terms, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        back = _powers(inverse, len(block))[s]
        out[i:j] = mix64((sums[e] - sums[s]) * back + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, firsts: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words; the mask tells which runs stay within one document."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, np.uint64(salt + width), dtype=np.uint64)
    for k in range(width):
        h *= np.uint64(0xF1357AEA2E62A9C5)
        h += words[k : k + n]
    whole = np.ones(n, dtype=bool)
    for edge in np.unique(firsts[1:-1]):
        whole[max(0, edge - width + 1) : edge] = False
    return mix64(h), whole


def slices(batches, column: int, limit: int = 8 << 20):
    """Cut Arrow batches so that `column` holds about `limit` bytes at most; a longer single row stays whole."""
    for batch in batches:
        _, offsets = arrow_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """(rid, doc_id, text), and whether rid is doc_id.  rid names a row: the id where ids are unique and not null, else a written number."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = d.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max(F.col("doc_id").isNull()).alias("null")).collect()[0]
    if (seen["most"] or 1) == 1 and not seen["null"]:
        return d.select(F.col("doc_id").alias("rid"), "doc_id", "text"), True
    return written(d.withColumn("rid", F.monotonically_increasing_id()), "keyed").select("rid", "doc_id", "text"), False


LAST_ID = (1 << 63) - 1


def ids_of(column) -> np.ndarray:
    """doc_id as int64; null sorts after all others."""
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def merged(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of each row, as maximal intervals."""
    order = np.lexsort((starts, rows))
    r, s, e = rows[order], starts[order], ends[order]
    if not len(r):
        return r, s, e
    # A shift by row keeps rows apart, so one running maximum serves all.
    base = np.zeros(len(r), dtype=np.int64)
    new_row = np.r_[True, r[1:] != r[:-1]]
    base = np.cumsum(new_row) * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + base)
    fresh = np.r_[True, (s[1:] + base[1:]) > reach[:-1]]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:] - 1, len(r) - 1]
    return r[first], s[first], reach[last] - base[last]
