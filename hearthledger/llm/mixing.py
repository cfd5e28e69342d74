"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are cut into permuted blocks.  How many blocks each source gives is exact; a binary tree over
the output shards splits these quotas by multivariate-hypergeometric draws, so that every shard gets its exact
share of blocks and each block belongs to one shard.  Shards read disjoint slices of the permuted blocks and are
shuffled locally.  ``taken`` tells how many words each shard takes of a document.  All draws are seeded, and documents
are placed by a hash of their id, source and text, so that reruns agree however the rows are partitioned.

Only one row per source and per (source, block) is aggregated; sources are at most ``MAX_SOURCES`` (more raise an
error), blocks of a source at most ``MAX_BLOCKS``, shards at most ``MAX_SHARDS``; larger corpora have larger blocks
and shards.

Defined cases: null text has size 0; the null source is a source, ranked last; repeated rows are separate
documents (equal ones may change places), and so are rows that repeat an id; very long texts count whole; an empty table gives an empty table; a source without words gives none; extra columns are kept by
``mixed`` and ignored by ``taken``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
SEED, WORDS_A_SHARD = 20_240_229, 250_000
MAX_BLOCKS, DOCS_A_BLOCK, MAX_SOURCES = 1 << 16, 64, 1_000_000
MAX_SHARDS, MAX_CELLS = 1 << 16, 1 << 21  # shards, and shards times sources, of the tree's table (16 MB)
SENT = 200_000  # drawn blocks, of some 40 bytes, that tasks may get whole


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares by weight of `share` times all sizes; none above `cap` times its own, the excess shared again."""
    rest, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes)]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in full)
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): exact integer quotas of each shard, drawn down a binary tree."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    totals = np.full(shards, int(quotas.sum()) // shards)
    totals[: int(quotas.sum()) % shards] += 1

    def node(lo: int, hi: int, here: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = here
            return
        mid = (lo + hi) // 2
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = draw.multivariate_hypergeometric(here, int(totals[lo:mid].sum()), method="marginals") if here.sum() else here
        node(lo, mid, left)
        node(mid, hi, here - left)

    node(0, shards, quotas.astype(np.int64))
    return out


class Plan(NamedTuple):
    sized: DataFrame  # the input with row number, size and hash
    lean: DataFrame  # row number, size, source's rank, block
    dealt: DataFrame  # each drawn block: rank, block, words, pass, words to take (room), shard
    sources: DataFrame


def planned(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int | None = None, seed: int = SEED, tree: int = SEED) -> Plan:
    """`seed` places documents and blocks, `tree` deals blocks to shards."""
    spark = docs.sparkSession
    place = F.xxhash64(F.col(key), F.col(source), F.col(text), F.lit(seed))
    sized = written(docs.withColumns({"__hl_rid": F.monotonically_increasing_id(), "__hl_size": n_words(F.col(text)), "__hl_h": place}), "sized")
    src = F.col(source)
    per = sized.groupBy(src.alias("src")).agg(F.sum("__hl_size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    goal = targets([r["words"] for r in per], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))])
    shards = shards or max(1, min(int(sum(goal)) // WORDS_A_SHARD, MAX_SHARDS, MAX_CELLS // max(1, len(per))))
    rows = []
    for i, r in enumerate(per):
        take = round(goal[i])
        whole = take // r["words"] if r["words"] else 0
        blocks = int(min(MAX_BLOCKS, max(1, r["docs"] // DOCS_A_BLOCK)))
        rows.append((r["src"], i, int(r["words"]), float(goal[i]), int(whole), int(take - whole * r["words"]), blocks))
    kind = sized.schema[source].dataType.simpleString()
    sources = spark.createDataFrame(rows, f"src {kind}, rank int, source_size long, target double, passes long, rest long, blocks int")
    lean = sized.select("__hl_rid", "__hl_size", src.alias("src"), F.col("__hl_h").alias("h"))
    lean = lean.join(sources, lean["src"].eqNullSafe(sources["src"])).drop("src").withColumn("block", F.pmod("h", F.col("blocks").cast("long")))
    # One row per block; the extra pass takes blocks in permuted order until the rest is reached.
    turn = Window.partitionBy("rank").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")  # at most MAX_BLOCKS rows a source
    blocks = lean.groupBy("rank", "block").agg(F.sum("__hl_size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = blocks.withColumns({"end": F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(turn) - 1})
    blocks = blocks.withColumns({"n_blocks": F.count("*").over(Window.partitionBy("rank")), "room": F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - (F.col("end") - F.col("words"))))})
    passes = F.flatten(
        F.array(
            F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<long>")), lambda p: F.struct(p.alias("pass"), F.col("words").alias("room"))),
            F.when(F.col("room") > 0, F.array(F.struct(F.col("passes").alias("pass"), F.col("room").alias("room")))).otherwise(F.array().cast("array<struct<pass:bigint,room:bigint>>")),
        )
    )
    drawn = blocks.select("rank", "block", "words", "at", "n_blocks", F.explode(passes).alias("p")).select("rank", "block", "words", (F.col("p.pass") * F.col("n_blocks") + F.col("at")).alias("at"), "p.*")
    drawn = written(drawn, "draws")
    quotas = np.zeros(max(1, len(rows)), dtype=np.int64)
    for r in drawn.groupBy("rank").agg(F.count("*").alias("n")).collect():
        quotas[r["rank"]] = r["n"]
    # Each source's draws, in permuted order, go to the shards in slices of the sizes that the tree gives.
    parts = split(quotas, shards, tree)
    ends = np.cumsum(parts, axis=0)
    shard, rank = np.nonzero(parts)
    slices = spark.createDataFrame(pd.DataFrame({"rank": rank.astype(np.int32), "shard": shard.astype(np.int32), "lo": (ends - parts)[shard, rank], "hi": ends[shard, rank]}), "rank int, shard int, lo long, hi long")
    dealt = drawn.join(slices.select("rank", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")), ["rank", "at"])
    return Plan(sized, lean, dealt, sources)


def _whole(lean: DataFrame, dealt: DataFrame) -> DataFrame:
    """A whole block gives all its documents."""
    return lean.join(dealt, ["rank", "block"]).where("room = words").select("__hl_rid", "pass", F.col("__hl_size").alias("take"), "shard")


def _partial(lean: DataFrame, dealt: DataFrame) -> DataFrame:
    """The one partial block of a source gives its documents in order of their hash."""
    inside = Window.partitionBy("rank", "block").orderBy("h", "__hl_rid").rowsBetween(Window.unboundedPreceding, 0)
    part = lean.join(dealt.where("room < words"), ["rank", "block"]).withColumn("end", F.sum("__hl_size").over(inside))
    take = F.greatest(F.lit(0).cast("long"), F.least(F.col("__hl_size"), F.col("room") - (F.col("end") - F.col("__hl_size"))))
    return part.select("__hl_rid", "pass", take.alias("take"), "shard").where("take > 0")


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, tree: int = SEED) -> DataFrame:
    """One row per input row: its words, its source's words and target, the words that the mix takes of it, and of these
    each shard's, as shard:words in order of shards."""
    plan = planned(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), seed=seed, tree=tree)
    lean = plan.lean.select("__hl_rid", "__hl_size", "rank", "block", "h")
    out = _whole(lean, plan.dealt).unionByName(_partial(lean, plan.dealt)).where("take > 0")
    # A row is drawn once for each pass: CAP times and once more at most.
    sums = out.groupBy("__hl_rid").agg(F.sum("take").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "take"))).alias("by"))
    shards = F.array_join(F.transform("by", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["take"].cast("string"))), ",")
    sized, facts = plan.sized.drop("text"), plan.sources.select(F.col("src").alias("__hl_src"), "source_size", "target")
    sized = sized.join(facts, sized["source"].eqNullSafe(facts["__hl_src"]))
    return sized.join(sums, "__hl_rid", "left").select("doc_id", F.col("__hl_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(shards, F.lit("")).alias("shards"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", sent: int = SENT) -> DataFrame:
    """The mix itself: rows of `docs`, once for each draw, cut to the words drawn, shuffled within shards.

    Texts are shuffled once, to their shards, where the drawn blocks are few enough to be sent to all tasks (at most
    `sent` rows); else they are joined with their draws first.  Only documents of partial blocks are joined by row.
    """
    plan = planned(docs, key, source, text)
    lean = plan.lean.select("__hl_rid", "__hl_size", "rank", "block", "h")
    hidden = {n: f"__hl_{n}" for n in ("pass", "take", "shard", "rank", "block")}
    hide = lambda d: d.select(*(F.col(n).alias(hidden.get(n, n)) for n in d.columns))
    part = hide(_partial(lean, plan.dealt))
    if plan.dealt.limit(sent + 1).count() <= sent:
        names = plan.sources.select(F.col("src").alias("__hl_src"), F.col("rank").alias("__hl_rank"), F.col("blocks").cast("long").alias("__hl_blocks"))
        rows = plan.sized.join(F.broadcast(names), plan.sized[source].eqNullSafe(names["__hl_src"])).withColumn("__hl_block", F.pmod(F.col("__hl_h"), F.col("__hl_blocks"))).drop("__hl_src", "__hl_blocks")
        whole = hide(plan.dealt.where("room = words").select("rank", "block", "pass", "shard"))
        full = rows.join(F.broadcast(whole), ["__hl_rank", "__hl_block"]).withColumn("__hl_take", F.col("__hl_size"))
        cut_ = hide(plan.dealt.where("room < words").select("rank", "block").distinct())
        rest = rows.join(F.broadcast(cut_), ["__hl_rank", "__hl_block"], "left_semi").join(part, "__hl_rid")
        drawn = full.unionByName(rest)
    else:
        drawn = plan.sized.join(hide(_whole(lean, plan.dealt)).unionByName(part), "__hl_rid")
    take = F.col("__hl_take")
    cut = F.array_join(F.slice(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, take.cast("int")), " ")
    drawn = drawn.where(take > 0).withColumn(text, F.when(take < F.col("__hl_size"), cut).otherwise(F.col(text)))
    drawn = drawn.withColumn("__hl_place", F.xxhash64("__hl_shard", "__hl_h", "__hl_pass", F.lit(SEED)))
    return drawn.repartition("__hl_shard").sortWithinPartitions("__hl_shard", "__hl_place").select(*(F.col(f"`{n}`") for n in docs.columns))
