"""What outputs make of recalled memories: who says what, whose memories turn up with others, which were used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
LEAST, LEAST_ELSEWHERE = 6, 8  # characters of a marker in its owner's own words, and anywhere
DIRECT = 256  # distinct markers of a chat up to which its texts are asked for all of them
LABEL = r"^\s*(?:\*{0,3}\s*)?(?:[\[【(（])?([^\]】)）：:\n]{1,120})(?:[\]】)）])?\s*(?::|：)\s*(.+?)\s*$"  # fixed values: how a line names its speaker


def _bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[\s*]+", ""))


def spoken(outputs: DataFrame, owners: DataFrame) -> DataFrame:
    """(output_id, chat_key, owner_id, text): what each owner says in lines that name it, joined by line ends, in order.

    `outputs` is (output_id, chat_key, text), `owners` (chat_key, owner_id, name).  Lines without a speaker are nobody's; a name that two owners of a
    chat share is the smaller owner's.
    """
    lines = outputs.select("output_id", "chat_key", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    said = lines.select("output_id", "chat_key", "at", _bare(F.regexp_extract("line", LABEL, 1)).alias("name"), F.regexp_extract("line", LABEL, 2).alias("words")).where("name <> ''")
    known = owners.groupBy("chat_key", _bare(c("name")).alias("name")).agg(F.min("owner_id").alias("owner_id"))
    each = said.join(known, ["chat_key", "name"]).groupBy("output_id", "chat_key", "owner_id").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("lines"))
    return each.select("output_id", "chat_key", "owner_id", F.array_join(F.transform("lines", lambda x: x["words"]), "\n").alias("text"))


def _pieces(text: Column) -> Column:
    """Hashes of all pieces of LEAST characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - LEAST + 1), lambda i: F.xxhash64(F.substr(text, i, F.lit(LEAST)))))


def _met(texts: DataFrame, packets: DataFrame, least: int) -> DataFrame:
    """`texts` (chat_key, text and more) with each distinct (of_owner, marker) of their chat that they hold, of markers of `least` (LEAST or more) characters.

    Texts meet markers of their own chat only.  Where a chat has up to DIRECT distinct markers, its texts are asked for all of them, as one array; in larger
    chats texts meet markers by the chat and a piece of LEAST characters: markers are listed under their rarest one in the chat, texts under all.
    """
    markers = packets.where(F.length("marker") >= least).select("chat_key", c("owner_id").alias("of_owner"), "marker").distinct()
    sizes = markers.groupBy("chat_key").agg(F.count("*").alias("n"))
    arrays = markers.join(sizes.where(c("n") <= DIRECT), "chat_key").groupBy("chat_key").agg(F.collect_list(F.struct("of_owner", "marker")).alias("markers"))
    near = texts.join(arrays, "chat_key").withColumn("hit", F.explode(F.filter("markers", lambda m: F.contains(c("text"), m["marker"])))).select(*texts.columns, "hit.*")
    many = sizes.where(c("n") > DIRECT).select("chat_key")
    wide = markers.join(many, "chat_key", "left_semi")
    words = wide.select("chat_key", "marker").distinct()
    listed = words.select("chat_key", "marker", F.explode(_pieces(c("marker"))).alias("piece"))
    often = listed.groupBy("chat_key", "piece").agg(F.count("*").alias("often"))
    rare = listed.join(often, ["chat_key", "piece"]).groupBy("chat_key", "marker").agg(F.min(F.struct("often", "piece"))["piece"].alias("piece"))
    asked = rare.select("chat_key", "piece").distinct()
    each = texts.where(F.length("text") >= LEAST).join(many, "chat_key", "left_semi").select("chat_key", "text").distinct()
    pieces = each.select("chat_key", "text", F.explode(_pieces(c("text"))).alias("piece")).join(asked, ["chat_key", "piece"], "left_semi")
    held = pieces.join(rare, ["chat_key", "piece"]).where(F.contains("text", "marker")).select("chat_key", "text", "marker")
    far = texts.join(held, ["chat_key", "text"]).join(wide, ["chat_key", "marker"]).select(*texts.columns, "of_owner", "marker")
    return near.unionByName(far)


def leaks(said: DataFrame, packets: DataFrame) -> DataFrame:
    """(output_id, owner_id, leaked_from, marker): memories of one owner that another of its chat says word for word.

    `said` is ``spoken``, `packets` (packet_id, chat_key, owner_id, marker).  Markers of under LEAST characters prove nothing; equal markers of an owner are one.
    """
    met = _met(said, packets, LEAST).where("owner_id <> of_owner")
    return met.select("output_id", "owner_id", c("of_owner").alias("leaked_from"), "marker").distinct()


def used(outputs: DataFrame, said: DataFrame, packets: DataFrame) -> DataFrame:
    """(packet_id, usage, confidence): ``explicit`` (1) where the owner itself says the marker, ``implicit`` (0.8) where an output of the chat holds it anyhow, else ``not_used`` (0)."""
    own = _met(said, packets, LEAST).where("owner_id = of_owner").select("chat_key", "owner_id", "marker", F.lit(2).alias("own")).distinct()
    any_ = _met(outputs.select("output_id", "chat_key", "text"), packets, LEAST_ELSEWHERE).select("chat_key", "marker", F.lit(1).alias("any")).distinct()
    rows = packets.join(own, ["chat_key", "owner_id", "marker"], "left").join(any_, ["chat_key", "marker"], "left").groupBy("packet_id").agg(F.max(F.coalesce("own", "any")).alias("how"))
    usage = F.when(c("how") == 2, "explicit").when(c("how") == 1, "implicit").otherwise("not_used")
    return rows.select("packet_id", usage.alias("usage"), F.when(c("how") == 2, 1.0).when(c("how") == 1, 0.8).otherwise(0.0).alias("confidence"))
