"""Who may recall what: permissions, budgets, canonical owners, profiles, dreams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.functions.memory import level
from hearthledger.operators.retrieval import top

# Kinds that a permission opens.
IDENTITY_KINDS = "identity location state".split()
FOCUSED_KINDS = "relationship event state goal commitment preference".split()
BASE = {"asserted": 90, "experienced": 82, "self_reported": 76, "heard": 62, "believed": 48, "suspected": 35}  # fixed values; else 25


def allowed(permission, privacy, kind, anchor, learned_at, now: int):
    """Whether an owner with `permission` may recall a trace."""
    out = F.when(permission.isNull() | (permission == "none") | (learned_at > now), False)
    out = out.when((permission == "public_only") & (privacy != "public"), False)
    out = out.when((permission == "identity_only") & ((privacy != "public") | ~kind.isin(IDENTITY_KINDS)), False)
    out = out.when((permission == "focused") & ~kind.isin(FOCUSED_KINDS) & ~anchor, False)
    return out.otherwise(True)


def recallable(traces: DataFrame, facts: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """Traces that their owner may recall, with kind and budget; `plan` is (owner_id, permission, budget)."""
    f = facts.select(F.col("id").alias("fact_id"), "kind", "stable_anchor")
    j = traces.where(F.col("learned_at") <= now).join(plan, "owner_id").join(f, "fact_id")
    c = F.col
    return j.where(allowed(c("permission"), c("privacy"), c("kind"), c("stable_anchor"), c("learned_at"), now))


def within_budget(rows: DataFrame, plan: DataFrame, score: str = "score") -> DataFrame:
    """Each owner's best rows, as many as its budget.  Spark cuts every partition to the plan's largest budget before it shuffles."""
    most = plan.agg(F.max("budget")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc(score), F.asc("id")))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).where("rank <= budget")


def canonical_owner(rows: DataFrame) -> DataFrame:
    """One owner for each public fact: by priority, then strength times clarity."""
    by = F.struct("priority", F.expr("strength * clarity"), F.expr("-id"))
    return rows.where("privacy = 'public'").groupBy("fact_id").agg(F.max_by("owner_id", by).alias("owner_id"), F.countDistinct("owner_id").alias("owners"))


def final_packets(rows: DataFrame, limit: int) -> DataFrame:
    """Packets after removing repeats of a fact; each owner's best is safe, the rest fill up to `limit`."""
    order = [F.desc("priority"), F.desc("score"), F.asc("id")]
    once = top(rows, ["fact_id"], order, 1, "one").drop("one")
    first = F.row_number().over(Window.partitionBy("owner_id").orderBy(*order)) == 1
    return once.withColumn("safe", first).orderBy(F.desc("safe"), *order).limit(limit)


def trace_metrics(traces: DataFrame, strength) -> DataFrame:
    t = traces.withColumn("s", strength)
    return t.groupBy("owner_id").agg(
        F.count("*").alias("traces"), F.round(F.avg("s"), 6).alias("mean_strength"), F.sum(F.col("privacy").isin("private", "secret").cast("long")).alias("private_traces")
    )


def level_histogram(traces: DataFrame, strength) -> DataFrame:
    return traces.groupBy(level(strength).alias("level")).agg(F.count("*").alias("traces"))


def base_strength(mode, belief):
    out = F.lit(25.0)
    for name, value in BASE.items():
        out = F.when(mode == name, F.lit(float(value))).otherwise(out)
    return out * (0.7 + 0.3 * belief)


def projected(traces: DataFrame, modes: list[str], privacies: list[str]) -> DataFrame:
    """What each owner knows of each fact: the highest mode and privacy, first learnt when, and base strength."""
    position = lambda c, values: F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c)) - 1
    g = traces.withColumn("m", position("knowledge_mode", modes)).withColumn("p", position("privacy", privacies))
    g = g.groupBy("owner_id", "fact_id").agg(F.max("m").alias("m"), F.max("p").alias("p"), F.min("learned_at").alias("learned_at"), F.max("belief").alias("belief"), F.count("*").alias("observations"))
    name = lambda c, values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(c) + 1).cast("int"))
    g = g.select("owner_id", "fact_id", name("m", modes).alias("knowledge_mode"), name("p", privacies).alias("privacy"), "learned_at", "belief", "observations")
    return g.withColumn("strength", F.round(base_strength(F.col("knowledge_mode"), F.col("belief")), 6))


def profile_claims(traces: DataFrame, facts: DataFrame, lookback: int = 30, kinds: list[str] | None = None) -> DataFrame:
    """Claims of an owner: seen thrice in the last floors, or once with great salience."""
    f = facts.select(F.col("id").alias("fact_id"), "kind", "subject_key", "predicate_key")
    if kinds:
        f = f.where(F.col("kind").isin(kinds))
    last = traces.groupBy("owner_id").agg((F.max("floor") - lookback + 1).alias("since"))
    j = traces.join(last, "owner_id").where("floor >= since").join(f, "fact_id")
    g = j.groupBy("owner_id", "kind", "subject_key", "predicate_key").agg(F.countDistinct("id").alias("observations"), F.max("belief").alias("confidence"), F.max("salience").alias("salience"))
    return g.where("observations >= 3 or salience >= 0.85")


def dream_links(traces: DataFrame, least: float = 25.0) -> DataFrame:
    """Retained traces, the last of each fact, linked to the one before in the owner's order of learning."""
    kept = traces.where(F.col("strength") >= least)
    last = kept.groupBy("owner_id", "fact_id").agg(F.max(F.struct("learned_at", "id")).alias("t")).select("owner_id", "fact_id", "t.*")
    before = F.lag("fact_id").over(Window.partitionBy("owner_id").orderBy("learned_at", "id"))
    return last.withColumn("from_fact", before).where("from_fact is not null").select("owner_id", "from_fact", F.col("fact_id").alias("to_fact"))


def dream_due(traces: DataFrame) -> DataFrame:
    g = traces.groupBy("owner_id").agg(F.count("*").alias("traces"), (F.max("floor") - F.min("floor") + 1).alias("floors"), F.max("salience").alias("salience"))
    return g.withColumn("due", F.expr("traces >= 20 or floors >= 50 or salience >= 0.85"))
