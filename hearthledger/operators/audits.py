"""Sources, scenes, coverage and integrity: joins and folds over what was captured and recalled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHUT_TYPES = "tool reasoning system".split()  # fixed values: messages that are never sources
c = F.col


def open_sources(blocks: DataFrame, hidden_too: bool = False) -> DataFrame:
    """Blocks that may be read: none of control, tools, reasoning or system; hidden ones only if asked for and spoken; none without text."""
    hidden = c("hidden") | (c("visibility") == "hidden")
    spoken = (c("kind") == "message") & c("role").isin("user", "assistant")
    shown = ~hidden | (F.lit(hidden_too) & spoken)
    content = F.trim(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\n{3,}", "\n\n"))
    return blocks.where((c("visibility") != "control") & shown & ~c("message_type").isin(SHUT_TYPES) & ~c("role").isin("tool", "system")).withColumn("content", content).where("content <> ''")


def all_sources(*lists: DataFrame) -> DataFrame:
    """Union of source lists; the first list that has an id gives the row."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("__place", F.lit(i)) for i, d in enumerate(lists)])
    held = [n for n in rows.columns if n not in ("id", "__place")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*held), "__place").alias("r")).select("id", "r.*")


def capped_batches(blocks: DataFrame, floors: int, cap: int) -> DataFrame:
    """(chat_key, batch, piece, floor, start, chars): floors in batches, texts beyond `cap` characters cut into pieces."""
    shown = blocks.where(c("role").isin("user", "assistant")).groupBy("chat_key", "floor").agg(F.sum(F.length("content")).cast("long").alias("size"))
    n = F.row_number().over(Window.partitionBy("chat_key").orderBy("floor")) - 1
    b = shown.withColumn("batch", F.floor(n / floors).cast("long")).where("size > 0")
    cut = b.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("size") - 1) / cap))).alias("piece"))
    return cut.select("chat_key", "batch", "floor", "piece", (c("piece") * cap).alias("start"), F.least(F.lit(cap).cast("long"), c("size") - c("piece") * cap).alias("chars"))


def character_batches(blocks: DataFrame, cap: int, most: int) -> DataFrame:
    """(chat_key, floor, batch, used): visible floors in batches of `cap` characters and `most` floors at most, in order; `used` is a batch's characters so far.

    A floor opens a batch of its own where the one before is full or would go over; a longer floor than `cap` stands alone and is cut by
    ``capped_batches``' rule later.  Where a batch ends depends on all floors before, so a chat's floors stream, sorted, through one task that holds three numbers.
    """
    shown = blocks.where(c("role").isin("user", "assistant")).groupBy("chat_key", "floor").agg(F.sum(F.length("content")).cast("long").alias("size"))
    kind = dict(shown.dtypes)

    def run(batches):
        import pyarrow as pa

        chat, batch, used, held = None, 0, 0, 0
        for b in batches:
            out = []
            for key, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != chat:
                    chat, batch, used, held = key, 0, 0, 0
                elif used >= cap or used + size > cap or held >= most:
                    batch, used, held = batch + 1, 0, 0
                used, held = used + size, held + 1
                out.append((batch, used))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["chat_key", "floor", "batch", "used"])

    rows = shown.repartition("chat_key").sortWithinPartitions("chat_key", "floor")
    return rows.mapInArrow(run, f"chat_key {kind['chat_key']}, floor {kind['floor']}, batch long, used long")


def utf8_chunks(texts: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk, text): texts in chunks of `most` UTF-8 bytes at most, cut between characters; an empty text is one chunk."""
    import pandas as pd

    def cut(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                raw, at, n = (t or "").encode(), 0, 0
                while True:
                    end = min(len(raw), at + most)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    out.append((k, n, raw[at:end].decode()))
                    at, n = end, n + 1
                    if at >= len(raw):
                        break
            yield pd.DataFrame(out, columns=[key, "chunk", "text"])

    return texts.select(key, text).mapInPandas(cut, f"{key} {dict(texts.dtypes)[key]}, chunk long, text string")


def scene_state(moves: DataFrame) -> DataFrame:
    """Per chat, after all moves (chat_key, owner_id, place, floor, id, entered): epochs, the last place and who is present.

    An owner is present if it last entered; an epoch begins wherever the place changes.
    """
    w = Window.partitionBy("chat_key").orderBy("floor", "id")
    places = moves.where("place is not null").withColumn("before", F.lag("place").over(w))
    place = places.groupBy("chat_key").agg(F.sum(F.coalesce((c("place") != c("before")).cast("long"), F.lit(0))).alias("epoch"), F.max_by("place", F.struct("floor", "id")).alias("place"))
    last = moves.groupBy("chat_key", "owner_id").agg(F.max_by("entered", F.struct("floor", "id")).alias("entered"))
    who = last.groupBy("chat_key").agg(F.count(F.when(c("entered"), 1)).alias("present"), F.count(F.when(~c("entered"), 1)).alias("exited"))
    return who.join(place, "chat_key", "left")


def matched_in_turn(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """(left_id, right_id, tier): each left row with its first right row by the first key that finds one.

    The right side comes down to one row a key before it is joined, so that a join gives one row for each left row.
    """
    rows = left.select(left_id, *keys)
    for tier, key in enumerate(keys, 1):
        rows = rows.join(right.groupBy(key).agg(F.min(right_id).alias(f"_{tier}")), key, "left")
    hits = [F.when(c(f"_{t}").isNotNull(), F.struct(c(f"_{t}").alias(right_id), F.lit(t).cast("long").alias("tier"))) for t in range(1, len(keys) + 1)]
    return rows.select(left_id, F.coalesce(*hits).alias("hit")).where("hit is not null").groupBy(left_id).agg(F.min(F.struct("hit.tier", f"hit.{right_id}")).alias("hit")).select(left_id, f"hit.{right_id}", "hit.tier")


def integrity(facts: DataFrame, heads: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(problem, n): what stored rows lack in the facts that they stand for."""
    f = facts.select(c("id").alias("fact_id"), c("chat_key").alias("fact_chat"), "backed")
    count = lambda d, cond, name: d.where(cond).agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    h, e, v = heads.join(f, "fact_id", "left"), edges.join(f, "fact_id", "left"), vectors.join(f, "fact_id", "left")
    return reduce(
        DataFrame.unionByName,
        [
            count(facts, "chat_key is null or trim(chat_key) = ''", "fact_without_chat"), count(h, "fact_chat is null", "head_without_fact"), count(h, "fact_chat <> chat_key", "head_of_other_chat"),
            count(e, "fact_chat is null or not backed", "edge_without_backing"), count(v, "fact_chat is null", "vector_without_fact"),
        ],
    )
