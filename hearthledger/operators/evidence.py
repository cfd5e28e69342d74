"""Excerpts in sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = r"[^\p{L}\p{N}]+"
WIDEST = 3  # words of a key
AT_ONCE = 256  # excerpts without a whole word inside, asked together


def _runs(n: int):
    """The hash of the `n` words from a place (from 0) on."""
    return lambda at: F.xxhash64(*(F.get("ws", at + k) for k in range(n)))


def places(excerpts: DataFrame, sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, start, places): where an excerpt's characters lie in a source: the first place, from 0, and how many there are.

    `excerpts` is a stated set of (key, excerpt), `sources` is (source, text).  Whatever holds an excerpt holds, as whole words in a row, all
    but its first and last one: the first WIDEST of these are its key, and sources meet excerpts by equal keys; texts are fetched for such pairs only, and
    `contains` decides.  Excerpts of one or two words (or of none) may begin and end inside words, so they have no key: sources are
    asked for them in blocks of AT_ONCE.  Null and empty excerpts are nowhere; null texts hold none.
    """
    c = F.col
    words = lambda x: F.filter(F.split(x, PARTS), lambda w: w != "")
    b = excerpts.where("excerpt <> ''").select(key, "excerpt", words(c("excerpt")).alias("ws"))
    inner = b.where(F.size("ws") > 2).withColumn("width", F.least(F.lit(WIDEST), F.size("ws") - 2))
    widths = [r["width"] for r in inner.select("width").distinct().collect()]  # WIDEST at most
    d = sources.select(source, words(c("text")).alias("ws"))
    pairs = None
    for n in widths:
        runs = F.transform(F.sequence(F.lit(0), F.size("ws") - n), _runs(n))
        own = inner.where(F.col("width") == n).select(key, _runs(n)(F.lit(1)).alias("key"))
        met = d.where(F.size("ws") >= n).select(source, F.explode(F.array_distinct(runs)).alias("key")).join(own, "key").select(key, source)
        pairs = met if pairs is None else pairs.unionByName(met)
    texts = sources.select(source, "text")
    held = None
    if pairs is not None:
        held = pairs.distinct().join(inner.select(key, "excerpt"), key).join(texts, source).where(F.contains("text", "excerpt")).select(key, source, "excerpt", "text")
    short = b.where(F.size("ws") <= 2).select(key, "excerpt").collect()
    for at in range(0, len(short), AT_ONCE):
        asked = F.array(*(F.struct(F.lit(r[key]).alias(key), F.lit(r["excerpt"]).alias("excerpt")) for r in short[at : at + AT_ONCE]))
        found = texts.select(source, "text", F.explode(F.filter(asked, lambda x: F.contains(c("text"), x["excerpt"]))).alias("x")).select(f"x.{key}", source, "x.excerpt", "text")
        held = found if held is None else held.unionByName(found)
    if held is None:
        held = b.join(texts, F.lit(False)).select(key, source, "excerpt", "text")
    many = F.expr("(length(text) - length(replace(text, excerpt, ''))) div length(excerpt)")
    return held.select(key, source, F.expr("cast(locate(excerpt, text) - 1 as long)").alias("start"), many.cast("long").alias("places"))
