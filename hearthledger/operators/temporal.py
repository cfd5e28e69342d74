"""Slots, snapshots, reconciliation: the newest fact per key, by aggregates that combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.memory import CONFIDENT, MUTABLE_KINDS, key_part

ORDER = ["coalesce(valid_from, updated_at)", "updated_at", "id"]


def slot_winners(facts: DataFrame) -> DataFrame:
    """Newest fact of each slot (chat, kind, subject, predicate) of mutable kinds."""
    slot = ["chat_key", "kind", "subject_key", "predicate_key"]
    newest = F.struct(*(F.expr(e) for e in ORDER))
    return facts.where(F.col("kind").isin(MUTABLE_KINDS)).groupBy(*slot).agg(F.max_by("id", newest).alias("winner"), F.count("*").alias("versions"))


def snapshot_covered(facts: DataFrame) -> DataFrame:
    """State and location facts that a newer snapshot of their subject covers."""
    newest = facts.where("state_ref").groupBy("chat_key", "subject_key").agg(F.max(F.struct("updated_at", "id")).alias("s"))
    older = facts.where(F.col("kind").isin(MUTABLE_KINDS) & ~F.col("state_ref"))
    return older.join(newest, ["chat_key", "subject_key"]).where("updated_at < s.updated_at").select("id", F.col("s.id").alias("snapshot_id"))


def heads(facts: DataFrame) -> DataFrame:
    """Head of each slot: active facts first, then the freshest."""
    by = F.struct((F.col("status") == "active").cast("int"), "updated_at", "id")
    return facts.groupBy("chat_key", "subject_key", "predicate_key").agg(F.max_by(F.struct("id", "status"), by).alias("h")).select("chat_key", "subject_key", "predicate_key", F.col("h.id").alias("head_id"), F.col("h.status").alias("head_status"))


def decision(existing_id, same_content, existing_kind, kind, newer, confidence):
    """insert, duplicate, supersede or pending for a fact that meets the head of its slot."""
    grows = ~existing_kind.isin(MUTABLE_KINDS) | ~kind.isin(MUTABLE_KINDS)
    return (
        F.when(existing_id.isNull(), "insert").when(same_content, "duplicate").when(grows, "insert").when(newer & (confidence >= CONFIDENT), "supersede").otherwise("pending")
    )


def reconcile(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A decision for each incoming fact against the newest active fact of its slot (chat, subject, predicate)."""
    slot = ["chat_key", "subject_key", "predicate_key"]
    held = existing.where("status = 'active'").groupBy(*slot).agg(F.max_by(F.struct("id", "kind", "content", "object_key", "updated_at"), F.struct("updated_at", "id")).alias("e"))
    j = incoming.join(held, slot, "left")
    same = F.coalesce(key_part(F.col("content")) == key_part(F.col("e.content")), F.lit(False)) & F.col("object_key").eqNullSafe(F.col("e.object_key"))
    return j.select("id", F.col("e.id").alias("existing_id"), decision(F.col("e.id"), same, F.col("e.kind"), F.col("kind"), F.col("updated_at") > F.col("e.updated_at"), F.col("confidence")).alias("decision"))


# What a plan does with a decision.
PLAN = {"insert": "create", "duplicate": "duplicate_noop", "supersede": "supersede", "pending": "pending_review"}


def update_plan(decisions: DataFrame) -> DataFrame:
    named = F.create_map(*(F.lit(x) for kv in PLAN.items() for x in kv))
    action = F.when((F.col("decision") == "insert") & F.col("existing_id").isNotNull(), "append_history").otherwise(named[F.col("decision")])
    return decisions.withColumn("action", action)
