"""The memory model over the driver's tables.

Each view is a list of (column, expression); the expressions are plain SQL that Spark and DuckDB read alike, so a
query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 2_592_000_000  # the moment of queries, in ms; every clock reading is this parameter
# The kinds of facts, in their declared order.
KINDS = "identity relationship location world_rule state goal commitment preference capability event other".split()
# How an owner knows a fact, by rank, and who may see it, by rank.
MODES = "unknown suspected believed inferred heard experienced self_reported asserted".split()
PRIVACY = "public limited private secret".split()


def pick(of: str, values: list[str]) -> str:
    """SQL: the value whose number is `of` modulo their count."""
    return f"case {of} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def rank_of(column: str, values: list[str]) -> str:
    return f"case {column} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(values)) + " end"


# Scopes of a fact, as arrays; {a} is an engine's word for one.
SCOPES = {
    "hosts": "case when id % 2 = 0 then {a}(concat('h', id % 3)) else {a}() end",
    "people": "case when id % 3 = 0 then {a}(concat('c', id % 5), concat('c', id % 7)) else {a}() end",
    "worlds": "case when id % 5 < 2 then {a}(concat('w', id % 4)) else {a}() end",
    "scenes": "case when id % 7 = 1 then {a}(concat('s', id % 2)) else {a}() end",
}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "facts": (
        "documents",
        {
            "id": "doc_id",
            "chat_key": "source",
            "kind": pick("doc_id", KINDS),
            "subject_key": "concat('s', cast(floor(doc_id / 20) as bigint) % 8)",
            "predicate_key": "concat('p', doc_id % 13)",
            "object_key": "case when doc_id % 3 = 0 then concat('o', doc_id % 89) end",
            "content": "text",
            "confidence": "cast(60 + doc_id * 37 % 41 as double) / 100",
            "status": "case when doc_id % 10 = 7 then 'superseded' when doc_id % 10 = 8 then 'pending' when doc_id % 10 = 9 then 'invalid' else 'active' end",
            "updated_at": "doc_id * 3600000",
            "valid_from": "case when doc_id % 4 = 0 then doc_id * 3600000 - 86400000 end",
            "valid_until": "case when doc_id % 6 = 0 then doc_id * 3600000 + 604800000 end",
            "state_ref": "(doc_id % 11 = 4 and doc_id % 2 = 0)",
            "stable_anchor": "(doc_id % 17 = 0)",
            "floor": "doc_id % 50",
            "lang": "lang",
        },
    ),
    "traces": (
        "events",
        {
            "id": "event_id",
            "owner_id": "concat('u', user_id % 40)",
            "fact_id": "cast(floor(event_id / 10) as bigint)",
            "privacy": "case event_type when 'click' then 'limited' when 'purchase' then 'private' when 'signup' then 'secret' else 'public' end",
            "knowledge_mode": pick("event_id", MODES),
            "strength": "cast(event_id * 7 % 101 as double)",
            "clarity": "cast(event_id * 13 % 101 as double)",
            "belief": "cast(event_id % 100 as double) / 100",
            "salience": "cast(event_id * 3 % 100 as double) / 100",
            "rehearsals": "event_id % 6",
            "learned_at": "event_id * 600000",
            "floor": "event_id % 400",
            "scene_id": "event_id % 25",
        },
    ),
    "inventory": (
        "lineitem",
        {
            "chat_key": "l_suppkey",
            "item_id": "l_partkey",
            "event_id": "l_orderkey * 10 + l_linenumber",
            "moment": "l_shipdate",
            "operation": "case when l_returnflag = 'R' then 'set' when l_returnflag = 'A' then 'increase' else 'decrease' end",
            "amount": "l_quantity",
        },
    ),
    "blocks": ("conversations", {"chat_key": "conv_id", "floor": "turn", "role": "role", "content": "coalesce(text, '')"}),
    "usage": (
        "orders",
        {
            "id": "o_orderkey",
            "chat_key": "o_custkey % 50",
            "model": "concat('m', o_custkey % 5)",
            "prompt": "case when o_orderkey % 7 <> 0 then o_orderkey % 4000 end",
            "completion": "case when o_orderkey % 11 <> 0 then o_orderkey % 900 end",
            "moment": "o_orderdate",
        },
    ),
    "repairs": (
        "events",
        {
            "id": "event_id",
            "job_id": "user_id",
            "request_id": "event_id % 13",
            "batch": "event_id % 7",
            "collection": pick("event_id", "actor location item episode claim inventory batch".split()),
            "collection_rank": "event_id % 7",
            "item": "event_id % 29",
            "attempts": "event_id % 5",
            "status": "case event_type when 'error' then 'quarantined' when 'signup' then 'resolved' else 'pending' end",
            "source_ref": "concat('message:floor-', event_id % 31)",
        },
    ),
    "scenes": ("events", {"id": "event_id", "chat_key": "user_id", "start_floor": "event_id % 300", "end_floor": "case when event_id % 9 <> 0 then event_id % 300 + event_id % 12 end"}),
    "vectors": ("embeddings", {"fact_id": "vec_id", "embedding": "embedding", "label": "label"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model view as a projection of its table; only the columns a query uses reach the scan."""
    source, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def view_sql(*names: str) -> str:
    """WITH clause of the views, for DuckDB."""
    return "with " + ", ".join(f"{n} as (select {', '.join(f'{e} as {c}' for c, e in VIEWS[n][1].items())} from {VIEWS[n][0]})" for n in names)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with `evidence`: whether a label backs them."""
    backed = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id as id", "true as backed").distinct()
    return view(spark, sf_dir, "facts").join(backed, "id", "left").selectExpr("*", "coalesce(backed, false) as evidence").drop("backed")


FACTS = view_sql("facts").replace("facts as", "facts0 as") + ", facts as (select f.*, l.doc_id is not null as evidence from facts0 f left join (select distinct doc_id from labels) l on l.doc_id = f.id)"
