"""From sources to facts: validation, aliases, mentions, cast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.memory import CONFIDENT, clamp, key_part, tokens

MIN_CHARS, MAX_CHARS = 6, 240  # fixed values
# What each sign adds to a cast candidate's score.
CAST = {"host": 1.0, "addressed": 0.95, "viewpoint": 0.9, "present": 0.8, "recent": 0.65, "event": 0.5, "near": 0.35, "mentioned": 0.1, "exited": -1.0}
QUALITY = {"confidence": 0.45, "evidence": 0.2, "specific": 0.15, "subject": 0.1, "retrievable": 0.05, "numeric": 0.05}  # fixed values


def validation_code(p: dict):
    """The first failing check of a proposed fact, "ok" if none; `p` names columns."""
    length = F.length(F.trim(F.regexp_replace(p["content"], r"(?U)\s+", " ")))
    return (
        F.when(p["source"].isNull(), "missing_source")
        .when(~F.coalesce(F.contains(p["source"], p["excerpt"]), F.lit(False)), "excerpt_mismatch")
        .when((length < MIN_CHARS) | (length > MAX_CHARS), "content_length")
        .when(p["confidence"] < CONFIDENT, "pending")
        .otherwise("ok")
    )


def claim_quality(signs: dict):
    return clamp(sum((F.lit(w) * signs[k] for k, w in QUALITY.items()), F.lit(0.0)), 0.0, 1.0)


def cast_scores(signs: DataFrame, *by: str) -> DataFrame:
    """Additive score of each candidate from its boolean signs."""
    c = F.col
    alone = c("mentioned") & ~c("present") & ~c("addressed")
    on = {k: c(k) for k in CAST} | {"mentioned": alone}
    return signs.select(*by, clamp(sum((F.when(on[k], w).otherwise(0.0) for k, w in CAST.items()), F.lit(0.0)), -1.0, 1.0).alias("score"), "exited")


def resolve(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention -> owner if its name is one owner's only, else ambiguous or unknown."""
    a = aliases.select(key_part(F.col("alias")).alias("name"), "owner_id").groupBy("name").agg(F.countDistinct("owner_id").alias("owners"), F.min("owner_id").alias("owner_id"))
    j = mentions.withColumn("name", key_part(F.col("mention"))).join(a, "name", "left")
    status = F.when(F.col("owners").isNull(), "unknown").when(F.col("owners") > 1, "ambiguous").otherwise("resolved")
    return j.select("id", status.alias("resolution"), F.when(F.col("owners") == 1, F.col("owner_id")).alias("owner_id"))


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that hold a one-word name as a token: an equi-join on tokens, not a test of every pair."""
    t = texts.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("name"))
    return t.join(names, "name").groupBy("name").agg(F.count("*").alias("texts"), F.min(key).alias("first_id"))
