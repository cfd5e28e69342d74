"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthledger import ship
from hearthledger.functions import memory as M
from hearthledger.operators import capture, graph, ledger, owners, retrieval, rollups, temporal
from hearthledger.sources.adapters import FACTS, KINDS, MODES, NOW, PRIVACY, SCOPES, facts, pick, rank_of, view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r6(x):
    return F.round(x, 6)


def long(x):
    return x.cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- lexical retrieval
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_:-]{2,}')"
BM25 = f"""
d as (select doc_id, {TOKENS} as ts from documents),
q as (select distinct item_id as query_id, unnest({TOKENS}) as token from benchmark),
t as (select doc_id, len(ts) as length, unnest(ts) as token from d),
i as (select doc_id, length, token, count(*) as tf from t where token in (select token from q) group by all),
df as (select token, count(*) as df from i group by token),
s as (select query_id, doc_id as id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score
      from i join df using (token) join q using (token), (select count(*) as n, avg(len(ts)) as mean from d) group by all)"""


def lexical(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    return retrieval.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text", best=best)


@query(f"with {BM25}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from s) select query_id, id, round(score, 6) as score, rank from r where rank <= 12")
def recall_bm25(spark, sf_dir):
    s = lexical(spark, sf_dir, 12).withColumn("score", r6(c("score")))
    return retrieval.top(s, ["query_id"], [F.desc("score"), F.asc("id")], 12)


@query(f"with t as (select doc_id, unnest({TOKENS}) as token from documents), g as (select doc_id, token, count(*) as tf from t group by all) select token, count(*) as df, sum(tf)::bigint as cf from g group by token")
def token_df(spark, sf_dir):
    return retrieval.document_frequency(read(spark, sf_dir, "documents"), "doc_id", "text")


AFFINITY_SQL = "case when kind in ('event', 'state') then 1.0 when kind in ('commitment', 'goal') then 0.45 when kind = 'location' then 0.8 when kind = 'capability' then 0.25 else 0.0 end"


@query(f"{FACTS} select id, kind, cast({AFFINITY_SQL} as double) as affinity from facts")
def kind_affinity(spark, sf_dir):
    return view(spark, sf_dir, "facts").select("id", "kind", M.kind_affinity(c("kind"), ["event", "state"]).alias("affinity"))


REASON = f"case when status <> 'active' then 'status' when confidence < 0.75 then 'confidence' when not evidence then 'evidence' when valid_from > {NOW} then 'future' when valid_until < {NOW} then 'expired' end"


@query(f"{FACTS} select id, chat_key, {REASON} is null as eligible, {REASON} as reason from facts")
def fact_eligibility(spark, sf_dir):
    reason = retrieval.ineligible_reason(None, NOW)
    return facts(spark, sf_dir).select("id", "chat_key", reason.isNull().alias("eligible"), reason.alias("reason"))


@query(f"{FACTS} select coalesce({REASON}, 'none') as reason, count(*) as n from facts group by 1")
def fact_omission_reasons(spark, sf_dir):
    return facts(spark, sf_dir).groupBy(F.coalesce(retrieval.ineligible_reason(None, NOW), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


# What a question is about: entities by key, and a scope in each dimension.
ABOUT = ["concat('s', query_id % 8)", "concat('p', query_id % 13)", "concat('o', query_id % 89)"]
WITHIN = {"hosts": "concat('h', query_id % 3)", "people": "concat('c', query_id % 5)", "worlds": "concat('w', query_id % 4)", "scenes": "concat('s', query_id % 2)"}
_HELD = {n: e.format(a="list_value").replace("list_value()", "[]::varchar[]") for n, e in SCOPES.items()}
_KEYS = "list_distinct([subject_key, predicate_key, coalesce(object_key, subject_key)])"
ENTITY_SQL = f"(len(list_intersect({_KEYS}, [{', '.join(ABOUT)}])) / least(len({_KEYS}), {len(ABOUT)}))"
CONTEXT_SQL = f"coalesce(({' + '.join(f'list_contains({_HELD[n]}, {q})::int' for n, q in WITHIN.items())}) / nullif({' + '.join(f'(len({h}) > 0)::int' for h in _HELD.values())}, 0), 0)"
BLEND = f"""round(0.58 * score / (score + 3) + 0.18 * {ENTITY_SQL} + 0.14 * {CONTEXT_SQL} + 0.05 * case when valid_from is not null or valid_until is not null then 1.0 else 0.5 end
 + 0.05 * pow(0.5, greatest({NOW} - updated_at, 0) / 2592000000.0) + 0.16 * {AFFINITY_SQL} + case when stable_anchor then 0.04 else 0 end + case when state_ref then 0.12 else 0 end, 6)"""
LEXICAL_SQL = f"""{FACTS}, {BM25}, e as (select query_id, f.*, s.score from facts f join s on f.id = s.id where {REASON} is null),
b as (select query_id, id, {BLEND} as blend from e)"""


def weighed(spark: SparkSession, sf_dir: str, which: str = "true", *more) -> DataFrame:
    """All facts that hold a word of a question, with `ineligible`, `entity`, `context`, `strong` and their blended score `blend`.

    `which`, on a fact's own columns and `ineligible`, leaves out facts before they meet questions; `more` are further columns of facts.
    """
    held = [F.expr(e.format(a="array").replace("array()", "cast(array() as array<string>)")).alias(n) for n, e in SCOPES.items()]
    keys = F.array_distinct(F.array("subject_key", "predicate_key", F.coalesce("object_key", "subject_key")))
    f = facts(spark, sf_dir).withColumn("ineligible", retrieval.ineligible_reason(None, NOW)).where(which)
    f = f.select("id", "chat_key", "subject_key", "predicate_key", "valid_from", "valid_until", "updated_at", "kind", "stable_anchor", "state_ref", "ineligible", keys.alias("keys"), *held, *more)
    j = retrieval.met(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text", f)
    entity = retrieval.overlap_ratio(c("keys"), F.array(*map(F.expr, ABOUT)))
    scope = retrieval.scope_share([c(n) for n in WITHIN], [F.array(F.expr(q)) for q in WITHIN.values()])
    bounded = c("valid_from").isNotNull() | c("valid_until").isNotNull()
    j = j.withColumns({"entity": entity, "context": scope})
    value = retrieval.blended(c("score"), c("entity"), c("context"), bounded, F.lit(NOW) - c("updated_at"), M.kind_affinity(c("kind"), ["event", "state"]), c("stable_anchor"), c("state_ref"))
    return j.withColumn("blend", r6(value)).drop("keys", *SCOPES)


def blended(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """(query_id, id, blend, anchor, updated_at, *more): words, entities, scope, time and kind of all eligible facts that hold a word of a question; `more` names further columns of facts."""
    rows = weighed(spark, sf_dir, "ineligible is null", *(v.alias(n) for n, v in more.items()))
    return rows.select("query_id", "id", "blend", c("stable_anchor").alias("anchor"), "updated_at", *more)


def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recall_bm25``, sent to where texts are read if there are few questions."""
    return retrieval.sent(recall_bm25(spark, sf_dir), read(spark, sf_dir, "benchmark"))


@query(f"""{LEXICAL_SQL}, m as (select b.*, stable_anchor as anchor, max(blend) filter (not stable_anchor) over (partition by query_id) as most from b join facts using (id)),
k as (select *, row_number() over (partition by query_id, anchor order by blend desc, id desc) as k from m where anchor or blend > greatest(0.08, 0.82 * most)),
r as (select *, row_number() over (partition by query_id order by anchor desc, k) as rank from k where k <= case when anchor then 3 else 12 end)
select query_id, id, blend, anchor, rank from r where rank <= 12""")
def recall_lexical_topk(spark, sf_dir):
    """Up to three stable anchors, then the rows that come near the best of the others."""
    b = blended(spark, sf_dir)
    # The best of each kind first: the cut depends on the best regular row only, and keeps a prefix.
    b = retrieval.top(b, ["query_id", "anchor"], [F.desc("blend"), F.desc("id")], 12, "k").where(~c("anchor") | (c("k") <= 3))
    most = F.max(F.when(~c("anchor"), c("blend"))).over(Window.partitionBy("query_id"))
    b = b.withColumn("most", most).where(c("anchor") | (c("blend") > F.greatest(F.lit(0.08), 0.82 * c("most"))))
    return retrieval.top(b, ["query_id"], [F.desc("anchor"), F.asc("k")], 12).select("query_id", "id", "blend", "anchor", "rank")


# ---------------------------------------------------------------- vectors and fusion
VECTORS = """vq as (select vec_id // 50 as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
p as (select query_id, vec_id as fact_id, round(list_dot_product(embedding::double[], v) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(v, v)), 6) as score from embeddings, vq),
k as (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from p where score > 0),
x as (select *, greatest(0.20, max(score) over (partition by query_id) - 0.18) as cutoff from k where rank <= 60),
n as (select query_id, fact_id, score, rank from x where score >= cutoff)"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    v = view(spark, sf_dir, "vectors").select("fact_id", "embedding")
    q = v.where("fact_id % 50 = 0").selectExpr("cast(fact_id / 50 as bigint) as query_id", "embedding as vector")
    ship(spark)
    return retrieval.vector_search(v, q).select("query_id", "fact_id", "score", "rank")


@query(f"with {VECTORS} select * from n")
def vector_topk_cutoff(spark, sf_dir):
    return nearest(spark, sf_dir)


@query(f"""{FACTS} select case when v.vec_id is null then 'missing' when f.id is null then 'orphaned' when f.id % 23 = 0 then 'stale' else 'ready' end as coverage, count(*) as n
from facts f full join embeddings v on v.vec_id = f.id group by 1""")
def vector_coverage(spark, sf_dir):
    j = view(spark, sf_dir, "facts").select("id").join(view(spark, sf_dir, "vectors").selectExpr("fact_id as id", "true as has"), "id", "full")
    j = j.join(view(spark, sf_dir, "facts").selectExpr("id", "true as fact"), "id", "left")
    state = F.when(c("has").isNull(), "missing").when(c("fact").isNull(), "orphaned").when(c("id") % 23 == 0, "stale").otherwise("ready")
    return j.groupBy(state.alias("coverage")).agg(F.count("*").alias("n"))


@query(f"{FACTS} select f.id, v.vec_id is null as missing from facts f left join embeddings v on v.vec_id = f.id where v.vec_id is null or f.id % 23 = 0 order by updated_at desc, f.id limit 32")
def vector_rebuild_queue(spark, sf_dir):
    j = view(spark, sf_dir, "facts").select("id", "updated_at").join(view(spark, sf_dir, "vectors").selectExpr("fact_id as id", "true as has"), "id", "left")
    return j.where("has is null or id % 23 = 0").orderBy(F.desc("updated_at"), "id").limit(32).select("id", c("has").isNull().alias("missing"))


RRF = f"""with {BM25}, l as (select query_id, id, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from s),
{VECTORS},
u as (select query_id, id, rank as lexical_rank, null as vector_rank, 0.4 / (60 + rank) as part from l where rank <= 12 union all select query_id, fact_id, null, rank, 0.4 / (60 + rank) from n),
f as (select query_id, id, round(sum(part), 6)::double as fusion, max(lexical_rank) as lexical_rank, max(vector_rank) as vector_rank from u group by query_id, id)"""


def both_lists(spark, sf_dir):
    s = lexical(spark, sf_dir, 12).withColumn("score", r6(c("score")))
    lex = retrieval.top(s, ["query_id"], [F.desc("score"), F.asc("id")], 12).select("query_id", "id", "rank")
    return lex, nearest(spark, sf_dir).selectExpr("query_id", "fact_id as id", "rank")


@query(f"{RRF} select * from f")
def rrf_hybrid(spark, sf_dir):
    lex, vec = both_lists(spark, sf_dir)
    out = retrieval.fused({"lexical": (lex, 0.4), "vector": (vec, 0.4)})
    return out.select("query_id", "id", r6(c("fusion")).alias("fusion"), "lexical_rank", "vector_rank")


@query(f"""{RRF}, o as (select *, row_number() over (partition by query_id order by fusion desc, id) as place from f),
g as (select query_id, count(*) as candidates, max(case when lexical_rank = 1 then id end) as a, max(case when vector_rank = 1 then id end) as b,
 bool_or(place = 1 and lexical_rank is null) as vector_only, max(case when place = 1 then fusion end) as one, max(case when place = 2 then fusion end) as two from o group by query_id)
select query_id, candidates >= 4 and (coalesce(a <> b, false) or vector_only or (one - two) / one <= 0.08) as required, candidates from g""")
def adaptive_rerank_flag(spark, sf_dir):
    """Whether the lists disagree: other leaders, a leader that only vectors found, or a second within 8 % of the first."""
    o = rrf_hybrid(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion"), "id")))
    at = lambda n, k, x: F.max(F.when(c(n) == k, c(x)))
    g = o.groupBy("query_id").agg(
        F.count("*").alias("candidates"), at("lexical_rank", 1, "id").alias("a"), at("vector_rank", 1, "id").alias("b"), F.bool_or((c("place") == 1) & c("lexical_rank").isNull()).alias("vector_only"), at("place", 1, "fusion").alias("one"), at("place", 2, "fusion").alias("two")
    )
    split = F.coalesce(c("a") != c("b"), F.lit(False)) | c("vector_only") | ((c("one") - c("two")) / c("one") <= 0.08)
    return g.select("query_id", ((c("candidates") >= 4) & split).alias("required"), "candidates")


KIND_WORTH = f"{RRF}, worth as (select doc_id as id, {AFFINITY_SQL.replace('kind', pick('doc_id', KINDS))} as affinity from documents)"


@query(f"{KIND_WORTH} select query_id, id, round(fusion + 0.004 * affinity, 6)::double as fusion from f join worth using (id)")
def rrf_with_kinds(spark, sf_dir):
    """Fused ranks with what the fact's kind adds."""
    worth = view(spark, sf_dir, "facts").select("id", M.kind_affinity(c("kind"), ["event", "state"]).alias("affinity"))
    return rrf_hybrid(spark, sf_dir).join(worth, "id").select("query_id", "id", r6(c("fusion") + 0.004 * c("affinity")).alias("fusion"))


@query(f"{KIND_WORTH} select query_id, fact_id, round(score + 0.08 * affinity, 6)::double as score from n join worth on worth.id = n.fact_id")
def vector_mode_score(spark, sf_dir):
    worth = view(spark, sf_dir, "facts").select(c("id").alias("fact_id"), M.kind_affinity(c("kind"), ["event", "state"]).alias("affinity"))
    return nearest(spark, sf_dir).join(worth, "fact_id").select("query_id", "fact_id", r6(c("score") + 0.08 * c("affinity")).alias("score"))


# ---------------------------------------------------------------- time
@query(f"""{FACTS}, r as (select *, row_number() over (partition by chat_key, kind, subject_key, predicate_key order by coalesce(valid_from, updated_at) desc, updated_at desc, id desc) as k,
count(*) over (partition by chat_key, kind, subject_key, predicate_key) as versions from facts where kind in ('state', 'location'))
select chat_key, kind, subject_key, predicate_key, id as winner, versions from r where k = 1""")
def temporal_slot_winner(spark, sf_dir):
    return temporal.slot_winners(view(spark, sf_dir, "facts"))


@query(f"""{FACTS}, s as (select chat_key, subject_key, max(updated_at) as newest, arg_max(id, updated_at) as snapshot_id from facts where state_ref group by all)
select f.id, snapshot_id from facts f join s using (chat_key, subject_key) where kind in ('state', 'location') and not state_ref and updated_at < newest""")
def snapshot_cover(spark, sf_dir):
    return temporal.snapshot_covered(view(spark, sf_dir, "facts"))


@query(f"""{FACTS}, r as (select *, row_number() over (partition by chat_key, subject_key, predicate_key order by (status = 'active')::int desc, updated_at desc, id desc) as k from facts)
select chat_key, subject_key, predicate_key, id as head_id, status as head_status from r where k = 1""")
def fact_head(spark, sf_dir):
    return temporal.heads(view(spark, sf_dir, "facts"))


NORMAL = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
RECONCILE = f"""{FACTS}, h as (select chat_key, subject_key, predicate_key, arg_max(id, updated_at) as e_id, arg_max(kind, updated_at) as e_kind, arg_max(content, updated_at) as e_content,
 arg_max(coalesce(object_key, ''), updated_at) as e_object, max(updated_at) as e_at from facts where status = 'active' and id % 2 = 0 group by all),
j as (select f.id, e_id as existing_id, case when e_id is null then 'insert' when {NORMAL.format('content')} = {NORMAL.format('e_content')} and coalesce(object_key, '') = e_object then 'duplicate'
 when e_kind not in ('state', 'location') or kind not in ('state', 'location') then 'insert' when updated_at > e_at and confidence >= 0.75 then 'supersede' else 'pending' end as decision
 from facts f left join h using (chat_key, subject_key, predicate_key) where f.id % 2 = 1)"""


def decisions(spark, sf_dir):
    f = view(spark, sf_dir, "facts")
    return temporal.reconcile(f.where("id % 2 = 0"), f.where("id % 2 = 1"))


@query(f"{RECONCILE} select * from j")
def fact_reconcile_decision(spark, sf_dir):
    return decisions(spark, sf_dir)


@query(f"{RECONCILE} select *, case when decision = 'insert' and existing_id is not null then 'append_history' when decision = 'insert' then 'create' when decision = 'duplicate' then 'duplicate_noop' when decision = 'pending' then 'pending_review' else decision end as action from j")
def fact_update_plan(spark, sf_dir):
    return temporal.update_plan(decisions(spark, sf_dir))


# ---------------------------------------------------------------- graph
EDGES = f"""{FACTS}, e as (select id as fact_id, chat_key, subject_key as from_key, object_key as to_key, predicate_key, kind, confidence, updated_at from facts
where kind in ('relationship', 'location', 'world_rule', 'goal', 'commitment', 'event') and status = 'active' and confidence >= 0.75 and evidence and object_key is not null),
n as (select *, unnest([from_key, to_key]) as entity_key from e)"""


@query(f"{EDGES} select fact_id, chat_key, from_key, to_key, predicate_key, kind, round(confidence, 6) as confidence, updated_at from e")
def graph_projection(spark, sf_dir):
    return graph.edges(facts(spark, sf_dir)).withColumn("confidence", r6(c("confidence")))


@query(f"{EDGES} select chat_key, entity_key, count(*) as degree, round(sum(confidence), 6) as frequency, min(updated_at) as created_at, max(updated_at) as updated_at from n group by all")
def graph_degree(spark, sf_dir):
    return graph.nodes(graph.edges(facts(spark, sf_dir))).withColumn("frequency", r6(c("frequency")))


@query(f"""{EDGES}, a as (select distinct fact_id, confidence, updated_at, from_key, to_key, chat_key from n where entity_key in ('s1', 's2', 's3', 's5', 's8') order by confidence desc, updated_at desc, fact_id limit 24),
f as (select distinct chat_key, unnest([from_key, to_key]) as entity_key from a),
b as (select distinct fact_id, confidence, updated_at from n semi join f using (chat_key, entity_key) where fact_id not in (select fact_id from a)),
u as (select fact_id, confidence, updated_at, 1 as hop from a union all select *, 2 from b)
select fact_id, hop::bigint as hop, round(greatest(0.01, least(1.0, confidence)) / hop, 6) as score from u order by hop, confidence desc, updated_at desc, fact_id limit 24""")
def graph_bfs_2hop(spark, sf_dir):
    e = graph.edges(facts(spark, sf_dir))
    seeds = graph.ends(e).where(c("entity_key").isin("s1", "s2", "s3", "s5", "s8")).select("chat_key", "entity_key").distinct()
    return graph.search(e, seeds).withColumn("score", r6(c("score")))


@query(f"{EDGES} select fact_id, from_key, to_key, kind from e where from_key like '%7%' or to_key like '%7%' or predicate_key like '%7%' or kind like '%7%' order by confidence desc, fact_id limit 12")
def graph_preview(spark, sf_dir):
    e = graph.edges(facts(spark, sf_dir))
    return e.where(rollups.contains("7", c("from_key"), c("to_key"), c("predicate_key"), c("kind"))).orderBy(F.desc("confidence"), "fact_id").limit(12).select("fact_id", "from_key", "to_key", "kind")


@query(f"""{EDGES}, s as (select fact_id, case when fact_id % 5 = 0 then 'old' else predicate_key end as p from e where fact_id % 7 <> 0 union all select -1, 'gone')
select coalesce(s.fact_id, e.fact_id) as fact_id, case when e.fact_id is null then 'delete' when s.p = predicate_key then 'keep' else 'upsert' end as action from s full join e on e.fact_id = s.fact_id""")
def graph_diff(spark, sf_dir):
    e = graph.edges(facts(spark, sf_dir)).selectExpr("fact_id", "predicate_key as p")
    stored = e.where("fact_id % 7 <> 0").selectExpr("fact_id", "case when fact_id % 5 = 0 then 'old' else p end as p").unionByName(spark.sql("select -1L as fact_id, 'gone' as p"))
    return graph.difference(stored, e, "fact_id", ["p"])


# ---------------------------------------------------------------- owners
PLAN = "(select concat('u', i) as owner_id, case i % 5 when 0 then 'full' when 1 then 'focused' when 2 then 'identity_only' when 3 then 'public_only' else 'none' end as permission, cast(i % 6 + 1 as bigint) as budget, cast(i % 7 * 10 as bigint) as priority from range(40) t(i))"
TRACES = f"{FACTS}, {view_sql('traces')[5:]}, plan as {PLAN}"
OK_SQL = f"""ok as (select t.*, permission, budget, priority, kind, stable_anchor from traces t join plan using (owner_id) join facts f on f.id = t.fact_id where learned_at <= {NOW} and permission <> 'none'
 and not (permission = 'public_only' and privacy <> 'public') and not (permission = 'identity_only' and (privacy <> 'public' or kind not in ('identity', 'location', 'state')))
 and not (permission = 'focused' and kind not in ('relationship', 'event', 'state', 'goal', 'commitment', 'preference') and not stable_anchor))"""


def recall_plan(spark):
    return spark.range(40).selectExpr(
        "concat('u', id) as owner_id",
        "case id % 5 when 0 then 'full' when 1 then 'focused' when 2 then 'identity_only' when 3 then 'public_only' else 'none' end as permission",
        "id % 6 + 1 as budget",
        "id % 7 * 10 as priority",
    )


def recallable(spark, sf_dir):
    return owners.recallable(view(spark, sf_dir, "traces"), view(spark, sf_dir, "facts"), recall_plan(spark), NOW)


@query(f"{TRACES}, {OK_SQL} select owner_id, permission, count(*) as traces, count(distinct fact_id) as facts from ok group by all")
def owner_recall_partition(spark, sf_dir):
    return recallable(spark, sf_dir).groupBy("owner_id", "permission").agg(F.count("*").alias("traces"), F.countDistinct("fact_id").alias("facts"))


@query(f"{TRACES}, {OK_SQL}, r as (select owner_id, id, fact_id, strength as score, row_number() over (partition by owner_id order by strength desc, id) as rank, budget from ok) select owner_id, id, fact_id, score, rank from r where rank <= budget")
def owner_budget_topk(spark, sf_dir):
    return owners.within_budget(recallable(spark, sf_dir).withColumn("score", c("strength")), recall_plan(spark)).select("owner_id", "id", "fact_id", "score", "rank")


@query(f"""{TRACES}, {OK_SQL}, r as (select fact_id, owner_id, row_number() over (partition by fact_id order by priority desc, strength * clarity desc, id) as k from ok where privacy = 'public'),
o as (select fact_id, count(distinct owner_id) as owners from ok where privacy = 'public' group by all) select fact_id, owner_id, owners from r join o using (fact_id) where k = 1""")
def public_canonical_owner(spark, sf_dir):
    return owners.canonical_owner(recallable(spark, sf_dir))


@query(f"""{TRACES}, {OK_SQL}, a as (select *, row_number() over (partition by fact_id order by priority desc, strength desc, id) as k from ok),
b as (select *, row_number() over (partition by owner_id order by priority desc, strength desc, id) as first from a where k = 1)
select owner_id, id, fact_id, first = 1 as safe from b order by first = 1 desc, priority desc, strength desc, id limit 60""")
def final_packets(spark, sf_dir):
    return owners.final_packets(recallable(spark, sf_dir).withColumn("score", c("strength")), 60).select("owner_id", "id", "fact_id", "safe")


EFFECTIVE = f"greatest(0.0, least(100.0, strength * exp(-greatest(0, {NOW} - learned_at) / 2592000000.0) * (1 + rehearsals * 0.04) * (1 + salience * 0.15) * (clarity / 100)))"


def strength():
    return M.effective_strength(c("strength"), c("clarity"), c("salience"), c("rehearsals"), c("learned_at"), NOW)


@query(f"{view_sql('traces')} select id, owner_id, round({EFFECTIVE}, 6) as effective from traces")
def effective_strength(spark, sf_dir):
    return view(spark, sf_dir, "traces").select("id", "owner_id", r6(strength()).alias("effective"))


@query(f"{view_sql('traces')}, s as (select round({EFFECTIVE}, 6) as s from traces) select case when s >= 85 then 'exact' when s >= 65 then 'clear' when s >= 45 then 'gist' when s >= 25 then 'fragment' else 'forgotten' end as level, count(*) as traces from s group by 1")
def memory_level_histogram(spark, sf_dir):
    return owners.level_histogram(view(spark, sf_dir, "traces"), r6(strength()))


@query(f"{view_sql('traces')} select owner_id, count(*) as traces, round(avg({EFFECTIVE}), 6) as mean_strength, count(*) filter (privacy in ('private', 'secret')) as private_traces from traces group by owner_id")
def actor_metrics(spark, sf_dir):
    return owners.trace_metrics(view(spark, sf_dir, "traces"), strength())


BASE_SQL = "case knowledge_mode when 'asserted' then 90.0 when 'experienced' then 82 when 'self_reported' then 76 when 'heard' then 62 when 'believed' then 48 when 'suspected' then 35 else 25 end"


@query(f"""{view_sql('traces')}, g as (select owner_id, fact_id, arg_max(knowledge_mode, {rank_of('knowledge_mode', MODES)}) as knowledge_mode, arg_max(privacy, {rank_of('privacy', PRIVACY)}) as privacy,
min(learned_at) as learned_at, max(belief) as belief, count(*) as observations from traces group by all) select *, round(({BASE_SQL})::double * (0.7 + 0.3 * belief), 6)::double as strength from g""")
def knowledge_projection(spark, sf_dir):
    return owners.projected(view(spark, sf_dir, "traces"), MODES, PRIVACY)


CLAIMS = f"""{TRACES}, w as (select owner_id, max(floor) - 29 as since from traces group by owner_id),
g as (select t.owner_id, f.kind, f.subject_key, f.predicate_key, count(distinct t.id) as observations, max(belief) as confidence, max(salience) as salience from traces t join w using (owner_id) join facts f on f.id = t.fact_id where t.floor >= since group by all)
select * from g where (observations >= 3 or salience >= 0.85)"""


@query(CLAIMS)
def profile_claims(spark, sf_dir):
    return owners.profile_claims(view(spark, sf_dir, "traces"), view(spark, sf_dir, "facts"))


@query(CLAIMS + " and kind = 'relationship'")
def relationship_claims(spark, sf_dir):
    return owners.profile_claims(view(spark, sf_dir, "traces"), view(spark, sf_dir, "facts"), kinds=["relationship"])


@query(f"""{view_sql('traces')}, k as (select *, row_number() over (partition by owner_id, fact_id order by learned_at desc, id desc) as k from traces where strength >= 25),
l as (select owner_id, fact_id as to_fact, lag(fact_id) over (partition by owner_id order by learned_at, id) as from_fact from k where k = 1) select owner_id, from_fact, to_fact from l where from_fact is not null""")
def dream_links(spark, sf_dir):
    return owners.dream_links(view(spark, sf_dir, "traces"))


@query(f"{view_sql('traces')}, g as (select owner_id, count(*) as traces, max(floor) - min(floor) + 1 as floors, max(salience) as salience from traces group by owner_id) select *, traces >= 20 or floors >= 50 or salience >= 0.85 as due from g")
def dream_trigger(spark, sf_dir):
    return owners.dream_due(view(spark, sf_dir, "traces"))


# ---------------------------------------------------------------- ledgers
OVER = "over (partition by chat_key, item_id order by moment, event_id rows unbounded preceding)"
IN_RUN = OVER.replace("item_id order", "item_id, run order")
RUNNING = f"""{view_sql('inventory')}, a as (select *, sum((operation = 'set')::int) {OVER} as run, case when operation = 'decrease' then -amount else amount end as change from inventory),
b as (select *, sum(change) {IN_RUN} as total from a),
d as (select *, total - least(0, min(total) {IN_RUN}) as after from b),
s as (select chat_key, item_id, event_id, moment, coalesce(lag(after) over (partition by chat_key, item_id order by moment, event_id), 0) as before, after from d)"""


def balances(spark, sf_dir):
    return ledger.running(view(spark, sf_dir, "inventory"))


@query(f"{RUNNING} select chat_key, item_id, event_id, before, after from s")
def inventory_running_balance(spark, sf_dir):
    return balances(spark, sf_dir).select("chat_key", "item_id", "event_id", "before", "after")


@query(f"{RUNNING}, r as (select *, row_number() over (partition by chat_key, item_id order by moment desc, event_id desc) as k, count(*) over (partition by chat_key, item_id) as events from s) select chat_key, item_id, after as amount, events from r where k = 1")
def inventory_latest_state(spark, sf_dir):
    return ledger.latest(balances(spark, sf_dir))


@query(f"{RUNNING} select chat_key, item_id, event_id from s where before is distinct from after")
def inventory_noop_filter(spark, sf_dir):
    return ledger.changed(balances(spark, sf_dir)).select("chat_key", "item_id", "event_id")


@query(f"{view_sql('inventory')} select operation, count(*) as events, sum(amount) as amount, count(distinct item_id) as items from inventory group by operation")
def inventory_counts(spark, sf_dir):
    return view(spark, sf_dir, "inventory").groupBy("operation").agg(F.count("*").alias("events"), F.sum("amount").alias("amount"), F.countDistinct("item_id").alias("items"))


# ---------------------------------------------------------------- roll-ups
@query(f"{FACTS} select k.kind, count(f.id) as n from (values {', '.join(f'($${k}$$)' for k in KINDS)}) k(kind) left join facts f on f.kind = k.kind group by k.kind")
def library_stats(spark, sf_dir):
    return rollups.counted_with_zeros(view(spark, sf_dir, "facts"), "kind", KINDS)


@query(f"{view_sql('usage')} select model, sum(prompt)::bigint as prompt, count(prompt) as prompt_known, sum(completion)::bigint as completion, count(completion) as completion_known, count(*) as calls from usage group by model")
def usage_summary(spark, sf_dir):
    return rollups.known_sums(view(spark, sf_dir, "usage"), ["model"], ["prompt", "completion"])


@query(f"{FACTS} select chat_key, count(*) as blocks, sum(length(content))::bigint as chars from facts group by chat_key")
def source_groups(spark, sf_dir):
    return view(spark, sf_dir, "facts").groupBy("chat_key").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


@query("select event_type, quantile_disc(value, 0.95) as p95, count(*) as n from events where value is not null group by event_type")
def offline_eval_p95(spark, sf_dir):
    return rollups.p95(read(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value")


@query(f"{view_sql('repairs')} select status, count(*) as n, count(distinct batch) as batches, count(distinct job_id) as jobs from repairs group by status")
def candidate_stats(spark, sf_dir):
    return view(spark, sf_dir, "repairs").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("batch").alias("batches"), F.countDistinct("job_id").alias("jobs"))


@query(ORACLE["recall_bm25"].replace("select query_id, id, round(score, 6) as score, rank from r", "select count(distinct query_id) filter (rank = 1) as answered, count(*) as selected, round(avg(case when contains(lower(d2.text), lower(b.text)) then 1.0 else 0.0 end), 6) as precision_12 from r join documents d2 on d2.doc_id = r.id join benchmark b on b.item_id = r.query_id"))
def golden_metrics(spark, sf_dir):
    r = read(spark, sf_dir, "documents").selectExpr("doc_id as id", "lower(text) as held").join(recalled(spark, sf_dir), "id")
    r = r.join(read(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "lower(text) as want"), "query_id")
    hit = F.when(F.contains("held", "want"), 1.0).otherwise(0.0)
    return r.agg(F.countDistinct(F.when(c("rank") == 1, c("query_id"))).alias("answered"), F.count("*").alias("selected"), r6(F.avg(hit)).alias("precision_12"))


@query(f"{FACTS} select id, chat_key, kind, updated_at from facts where (chat_key, id) > ('news', 10) or chat_key > 'news' order by chat_key, id limit 100")
def facts_page(spark, sf_dir):
    return rollups.page(view(spark, sf_dir, "facts"), ["chat_key", "id"], {"chat_key": "news", "id": 10}, 100).select("id", "chat_key", "kind", "updated_at")


@query(f"{FACTS} select id, kind from facts where contains(lower(coalesce(content, '')), 'the') or contains(subject_key, 'the') order by updated_at desc, id limit 50")
def facts_text_search(spark, sf_dir):
    f = view(spark, sf_dir, "facts")
    return f.where(rollups.contains("The", c("content"), c("subject_key"))).orderBy(F.desc("updated_at"), "id").limit(50).select("id", "kind")


@query(f"""{view_sql('blocks')}, a as (select chat_key, floor, sum(length(content)) as chars from blocks where role in ('user', 'assistant') group by all),
b as (select *, (row_number() over (partition by chat_key order by floor) - 1) // 10 as batch from a)
select chat_key, batch, min(floor) as first_floor, max(floor) as last_floor, count(*) as floors, sum(chars)::bigint as chars, ceil(sum(chars) * 0.9)::bigint + 1200 as tokens, sum(chars) > 16000 as oversize from b group by chat_key, batch""")
def floor_batches(spark, sf_dir):
    return rollups.floor_batches(view(spark, sf_dir, "blocks"))


@query(f"""with x as ({ORACLE['floor_batches']}) select count(*) as batches, sum(tokens)::bigint as tokens, (ceil(sum(tokens) * 0.75 / 100) * 100)::bigint as low, (ceil(sum(tokens) * 1.25 / 100) * 100)::bigint as high from x""")
def token_estimate(spark, sf_dir):
    b = rollups.floor_batches(view(spark, sf_dir, "blocks"))
    near = lambda f, n: long(F.ceil(F.sum("tokens") * f / 100) * 100).alias(n)
    return b.agg(F.count("*").alias("batches"), F.sum("tokens").alias("tokens"), near(0.75, "low"), near(1.25, "high"))


@query(f"""{view_sql('blocks')}, s as (select distinct chat_key, floor from blocks where role in ('user', 'assistant')),
n as (select *, row_number() over (partition by chat_key order by floor) as k, count(*) over (partition by chat_key) as w from s where floor > 1),
o as (select *, row_number() over (partition by chat_key order by floor desc) as k from s where floor <= 1)
select chat_key, floor, true as writable from n where w > 3 and k <= 3 union all select chat_key, floor, false from o where k <= 3 and chat_key in (select chat_key from n where w > 3)""")
def summary_window(spark, sf_dir):
    return rollups.summary_window(view(spark, sf_dir, "blocks"), cursor=1, interval=3, overlap=2)


@query(f"{view_sql('blocks')} select chat_key, case when floor > 3 then floor - 2 else floor end as floor, role from blocks where floor not in (2, 3)")
def message_index_shift(spark, sf_dir):
    b = view(spark, sf_dir, "blocks").where(~c("floor").isin(2, 3))
    return b.select("chat_key", F.when(c("floor") > 3, c("floor") - 2).otherwise(c("floor")).alias("floor"), "role")


# ---------------------------------------------------------------- capture and repair
@query(f"""{view_sql('repairs')} select job_id, request_id, batch, collection, item, count(*) as rejections, max(attempts) as attempts, array_to_string(list_sort(list(distinct source_ref)), ',') as sources, min(collection_rank) as collection_rank
from repairs group by job_id, request_id, batch, collection, item""")
def repair_groups(spark, sf_dir):
    return rollups.repair_groups(view(spark, sf_dir, "repairs"))


BLOCKED = f"{view_sql('repairs')}, o as (select * from repairs where status <> 'resolved'), b as (select id, attempts, status, min(collection_rank) over (partition by job_id, source_ref) < collection_rank as blocked from o)"


@query(f"{BLOCKED} select id, blocked from b")
def repair_blockers(spark, sf_dir):
    return rollups.repair_blockers(view(spark, sf_dir, "repairs")).select("id", "blocked")


@query(f"{BLOCKED} select count(*) filter (not blocked and status = 'pending' and attempts < 3) as retryable, count(*) filter (attempts >= 3 and status = 'pending') as exhausted, count(*) filter (status = 'quarantined') as quarantined from b")
def repair_counts(spark, sf_dir):
    n = lambda e, name: F.count(F.when(F.expr(e), 1)).alias(name)
    b = rollups.repair_blockers(view(spark, sf_dir, "repairs"))
    return b.agg(n("not blocked and status = 'pending' and attempts < 3", "retryable"), n("attempts >= 3 and status = 'pending'", "exhausted"), n("status = 'quarantined'", "quarantined"))


@query(f"""{FACTS} select id, case when content is null then 'missing_source' when not contains(content, substring(content, 2, 20)) or id % 19 = 0 then 'excerpt_mismatch'
when length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) not between 6 and 240 then 'content_length' when confidence < 0.75 then 'pending' else 'ok' end as code from facts""")
def proposal_validation(spark, sf_dir):
    f = view(spark, sf_dir, "facts").withColumn("excerpt", F.when(c("id") % 19 == 0, F.lit("\u0001")).otherwise(F.substring("content", 2, 20)))
    return f.select("id", capture.validation_code({"source": c("content"), "excerpt": c("excerpt"), "content": c("content"), "confidence": c("confidence")}).alias("code"))


@query(f"""{FACTS} select id, round(least(1.0, greatest(0.0, 0.45 * confidence + 0.2 * evidence::int + 0.15 * (object_key is not null)::int + 0.1 * (subject_key is not null)::int + 0.05 * (length(content) between 6 and 240)::int
+ 0.05 * regexp_matches(content, '[0-9]')::int)), 6)::double as quality from facts where content is not null""")
def claim_quality(spark, sf_dir):
    n = lambda x: x.cast("double")
    signs = {"confidence": c("confidence"), "evidence": n(c("evidence")), "specific": n(c("object_key").isNotNull()), "subject": n(c("subject_key").isNotNull()), "retrievable": n(F.length("content").between(6, 240)), "numeric": n(F.regexp_like("content", F.lit("[0-9]")))}
    return facts(spark, sf_dir).where("content is not null").select("id", r6(capture.claim_quality(signs)).alias("quality"))


SIGNS = "owner_id, scene_id, bool_or(id % 47 = 0) as host, bool_or(id % 39 = 0) as addressed, bool_or(id % 33 = 0) as viewpoint, bool_or(id % 29 = 0) as present, bool_or(id % 23 = 0) as recent, bool_or(id % 21 = 0) as event, bool_or(id % 17 = 0) as near, bool_or(id % 11 = 0) as mentioned, bool_or(id % 9 = 0) as exited"


@query(f"""{view_sql('traces')}, s as (select {SIGNS} from traces group by owner_id, scene_id)
select owner_id, scene_id, round(greatest(-1.0, least(1.0, host::int * 1.0 + addressed::int * 0.95 + viewpoint::int * 0.9 + present::int * 0.8 + recent::int * 0.65 + event::int * 0.5 + near::int * 0.35 + (mentioned and not present and not addressed)::int * 0.1 - exited::int)), 6)::double as score, exited from s""")
def cast_candidate_score(spark, sf_dir):
    s = view(spark, sf_dir, "traces").groupBy("owner_id", "scene_id").agg(*(F.expr(x.strip()) for x in SIGNS.split(",")[2:]))
    return capture.cast_scores(s, "owner_id", "scene_id").withColumn("score", r6(c("score")))


@query(f"""{view_sql('traces')}, a as (select distinct scene_id, owner_id from traces where id % 3 <> 1), p as (select distinct scene_id, owner_id from traces where id % 3 <> 0)
select scene_id, count(*) filter (p.owner_id is null) as unplanned, count(*) filter (a.owner_id is null) as missing, count(*) filter (a.owner_id is not null and p.owner_id is not null) as matched from a full join p using (scene_id, owner_id) group by scene_id""")
def cast_plan_diff(spark, sf_dir):
    t = view(spark, sf_dir, "traces").select("scene_id", "owner_id", "id")
    # Every trace is of the actual cast, of the planned one, or of both.
    a, p = (t.where(f"id % 3 <> {k}").select("scene_id", "owner_id", F.lit(True).alias(n)).distinct() for k, n in ((1, "actual"), (0, "planned")))
    n = lambda e, name: F.count(F.when(F.expr(e), 1)).alias(name)
    return a.join(p, ["scene_id", "owner_id"], "full").groupBy("scene_id").agg(n("planned is null", "unplanned"), n("actual is null", "missing"), n("actual and planned", "matched"))


@query("""with a as (select lower(trim(c_name)) as name, count(distinct c_custkey) as owners, min(c_custkey) as owner_id from customer group by 1),
m as (select o_orderkey as id, concat('customer#', lpad((o_custkey + o_orderkey % 3 * 100000)::varchar, 9, '0')) as name from orders)
select id, case when owners is null then 'unknown' when owners > 1 then 'ambiguous' else 'resolved' end as resolution, case when owners = 1 then owner_id end as owner_id from m left join a using (name)""")
def alias_resolution(spark, sf_dir):
    a = read(spark, sf_dir, "customer").selectExpr("c_name as alias", "c_custkey as owner_id")
    m = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "concat('  CUSTOMER#', lpad(cast(o_custkey + o_orderkey % 3 * 100000 as string), 9, '0')) as mention")
    return capture.resolve(m, a)


@query(f"""with n as (select distinct unnest({TOKENS}) as name from benchmark), t as (select distinct doc_id, unnest({TOKENS}) as name from documents)
select name, count(*) as texts, min(doc_id) as first_id from t join n using (name) group by name""")
def mention_contains_join(spark, sf_dir):
    names = read(spark, sf_dir, "benchmark").select(F.explode(M.tokens(F.coalesce(c("text"), F.lit("")))).alias("name")).distinct()
    return capture.mentions(read(spark, sf_dir, "documents"), names, "doc_id", "text")


@query(f"""{view_sql('scenes')}, t as (select event_id as id, user_id as chat_key, event_id % 400 as floor from events)
select s.id as scene_id, count(*) as traces, min(t.id) as first_trace from scenes s join t on t.chat_key = s.chat_key and t.floor >= start_floor and (end_floor is null or t.floor <= end_floor) group by s.id""")
def scene_episode_interval_join(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").withColumnRenamed("id", "scene_id")
    t = read(spark, sf_dir, "events").selectExpr("event_id as id", "user_id as chat_key", "event_id % 400 as floor")
    return rollups.counted_in_intervals(t, s, "scene_id", "id").toDF("scene_id", "traces", "first_trace")


@query(f"""{FACTS}, a as (select id, unnest([concat(subject_key, predicate_key), coalesce(object_key, subject_key)]) as item from facts), b as (select event_id as audit_id, unnest([concat('s', event_id % 23, 'p', event_id % 13), concat('o', event_id % 4000)]) as item from events),
p as (select distinct id, audit_id from a join b using (item)) select audit_id, count(*) as facts, min(id) as first_id from p group by audit_id""")
def fact_audit_overlap_join(spark, sf_dir):
    a = view(spark, sf_dir, "facts").selectExpr("id", "array(concat(subject_key, predicate_key), coalesce(object_key, subject_key)) as refs")
    b = read(spark, sf_dir, "events").selectExpr("event_id as audit_id", "array(concat('s', event_id % 23, 'p', event_id % 13), concat('o', event_id % 4000)) as refs")
    return rollups.counted_sharing(a, b, "refs", "id", "audit_id").toDF("audit_id", "facts", "first_id")


@query("""with recursive h as (select n_nationkey as k, n_name as x, 1 as i, 2166136261::bigint as f from nation union all
select k, x, i + 1, (xor(f, unicode(substring(x, i, 1))::bigint) * 16777619) % 4294967296 from h where i <= length(x)) select k as n_nationkey, x as n_name, f::bigint as hash from h where i = length(x) + 1""")
def stable_record_key(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", M.fnv1a(c("n_name")).alias("hash"))


FNV = "(xor({h}, {u}) * 16777619) % 4294967296"
# DuckDB has no NFKC; its NFC agrees with it on texts without compatibility characters.
VARIANTS = ", ".join(
    f"printf('%08x', list_reduce(list_prepend({h}::bigint, list_transform(string_split(nfc_normalize(content), ''), lambda x: unicode(x)::bigint)), lambda h, u: {FNV.format(h='h', u='u')}))"
    for h in M.fnv1a_variants([""])[0].tolist()
)


@query(f"{FACTS} select id, case when content = '' then '{''.join(f'{h:08x}' for h in M.fnv1a_variants([''])[0].tolist())}' when content is not null then concat({VARIANTS}) end as record_key from facts")
def fact_record_key(spark, sf_dir):
    """The reference's 128-bit record key of every fact's content."""
    ship(spark)
    return view(spark, sf_dir, "facts").select("id", M.record_key(c("content")).alias("record_key"))


@query(f"{view_sql('traces')} select fact_id, count(*) as attempts, count(distinct owner_id) as owners, max(strength) as strength, max(clarity) as clarity, array_to_string(list_sort(list(distinct privacy)), ',') as privacies from traces group by fact_id")
def recall_audit_pivot(spark, sf_dir):
    return view(spark, sf_dir, "traces").groupBy("fact_id").agg(
        F.count("*").alias("attempts"), F.countDistinct("owner_id").alias("owners"), F.max("strength").alias("strength"), F.max("clarity").alias("clarity"), F.array_join(F.sort_array(F.collect_set("privacy")), ",").alias("privacies")
    )
