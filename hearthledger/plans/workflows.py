"""Recall and capture steps as queries: candidate sets, staleness, evidence places, update plans, rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.functions import memory as M
from hearthledger.operators import evidence, graph, retrieval
from hearthledger.plans.catalogue import BM25, EDGES, REASON, RUNNING, TOKENS, VECTORS, balances, c, lexical, long, nearest, query, r6, read
from hearthledger.sources.adapters import FACTS, NOW, facts, view, view_sql

LEX = "l as (select query_id, id from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from s) where rank <= 12)"


def best(spark, sf_dir):
    s = lexical(spark, sf_dir, 12).withColumn("score", r6(c("score")))
    return retrieval.top(s, ["query_id"], [F.desc("score"), F.asc("id")], 12).select("query_id", "id")


@query(f"with {BM25}, {LEX}, {VECTORS} select query_id, id from l union select query_id, fact_id from n")
def candidate_union(spark, sf_dir):
    return best(spark, sf_dir).unionByName(nearest(spark, sf_dir).selectExpr("query_id", "fact_id as id")).distinct()


@query(f"{FACTS}, {BM25}, {LEX} select query_id, id from l where id not in (select id from facts where status in ('superseded', 'invalid'))")
def excluded_candidates(spark, sf_dir):
    gone = view(spark, sf_dir, "facts").where("status in ('superseded', 'invalid')").select("id")
    return best(spark, sf_dir).join(gone, "id", "left_anti").select("query_id", "id")


@query(f"""with q as (select distinct item_id as query_id, unnest({TOKENS}) as token from benchmark), t as (select distinct doc_id as id, unnest({TOKENS}) as token from documents)
select query_id, id, count(*) as strong from t join q using (token) where len(token) >= 5 group by query_id, id having count(*) >= 2""")
def overlap_gate(spark, sf_dir):
    rare = lambda t: F.filter(F.array_distinct(M.tokens(F.coalesce(t, F.lit("")))), lambda x: F.length(x) >= 5)
    q = read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), F.explode(rare(c("text"))).alias("token"))
    t = read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.explode(rare(c("text"))).alias("token"))
    return t.join(q, "token").groupBy("query_id", "id").agg(F.count("*").alias("strong")).where("strong >= 2")


@query(f"{FACTS}, {BM25}, {LEX} select l.query_id, l.id, {REASON} is null as selected, coalesce({REASON}, 'none') as omitted from l join facts f on f.id = l.id")
def decision_log(spark, sf_dir):
    why = retrieval.ineligible_reason(None, NOW)
    return best(spark, sf_dir).join(facts(spark, sf_dir), "id").select("query_id", "id", why.isNull().alias("selected"), F.coalesce(why, F.lit("none")).alias("omitted"))


@query("select vec_id, len(embedding)::bigint as dimensions, case when len(embedding) = 0 then 'empty' when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) > 0 then 'not_finite' when len(list_filter(embedding, lambda x: x <> 0)) = 0 then 'zero' else 'ok' end as state from embeddings")
def vector_validation(spark, sf_dir):
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(F.size("embedding") == 0, "empty").when(odd, "not_finite").when(~F.exists("embedding", lambda x: x != 0), "zero").otherwise("ok")
    return read(spark, sf_dir, "embeddings").select("vec_id", long(F.size("embedding")).alias("dimensions"), state.alias("state"))


@query(f"{FACTS} select 'kind' as facet, kind as option, count(*) as n from facts group by kind union all select 'status', status, count(*) from facts group by status union all select 'lang', lang, count(*) from facts group by lang")
def facet_options(spark, sf_dir):
    f = view(spark, sf_dir, "facts").select("kind", "status", "lang")
    # One pass: each row gives its three facets, combined on the map side.
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), c(n).alias("option")) for n in ("kind", "status", "lang")))
    return f.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.option").agg(F.count("*").alias("n"))


@query(f"{view_sql('repairs')}, r as (select *, row_number() over (partition by job_id order by id desc) as attempt from repairs) select job_id, attempt, id, status from r where attempt <= 5")
def recent_attempts(spark, sf_dir):
    return retrieval.top(view(spark, sf_dir, "repairs"), ["job_id"], [F.desc("id")], 5, "attempt").select("job_id", "attempt", "id", "status")


@query(f"{FACTS} select id, sha256(concat_ws('|', chat_key, kind, subject_key, predicate_key, coalesce(object_key, ''), coalesce(content, ''), updated_at::varchar)) as digest from facts")
def content_digest(spark, sf_dir):
    parts = [c("chat_key"), c("kind"), c("subject_key"), c("predicate_key"), F.coalesce("object_key", F.lit("")), F.coalesce("content", F.lit("")), c("updated_at").cast("string")]
    return view(spark, sf_dir, "facts").select("id", F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))


@query(f"{FACTS}, r as (select id as fact_id, updated_at - (id % 4 = 0)::int as seen from facts union all select -1, 0) select fact_id, case when f.id is null then 'missing' when updated_at <> seen then 'stale' else 'fresh' end as state from r left join facts f on f.id = fact_id")
def read_set_staleness(spark, sf_dir):
    f = view(spark, sf_dir, "facts").select("id", "updated_at")
    seen = f.selectExpr("id as fact_id", "updated_at - cast(id % 4 = 0 as int) as seen").unionByName(spark.sql("select -1L as fact_id, 0L as seen"))
    state = F.when(c("id").isNull(), "missing").when(c("updated_at") != c("seen"), "stale").otherwise("fresh")
    return seen.join(f, seen["fact_id"] == f["id"], "left").select("fact_id", state.alias("state"))


@query("""select item_id, doc_id, strpos(d.text, b.text)::bigint - 1 as start, ((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text))::bigint as places from benchmark b join documents d on b.text <> '' and contains(d.text, b.text)""")
def evidence_offsets(spark, sf_dir):
    """Where a whole excerpt lies in a source: its first place and how many there are."""
    excerpts = read(spark, sf_dir, "benchmark").select("item_id", c("text").alias("excerpt"))
    return evidence.places(excerpts, read(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query(f"{view_sql('blocks')}, a as (select chat_key, min(floor) as lo, max(floor) as hi from blocks where role = 'system' group by chat_key) select b.chat_key, b.floor from (select distinct chat_key, floor from blocks) b join a using (chat_key) where floor between lo - 1 and hi + 1")
def repair_source_window(spark, sf_dir):
    b = view(spark, sf_dir, "blocks")
    a = b.where("role = 'system'").groupBy("chat_key").agg(F.min("floor").alias("lo"), F.max("floor").alias("hi"))
    return b.select("chat_key", "floor").distinct().join(a, "chat_key").where("floor between lo - 1 and hi + 1").select("chat_key", "floor")


@query(f"{EDGES}, f as (select distinct chat_key, unnest([from_key, to_key]) as entity_key from e where from_key = 's7' or to_key = 's7') select fact_id, chat_key, from_key, to_key from e where exists (select 1 from f where f.chat_key = e.chat_key and f.entity_key = e.from_key) or exists (select 1 from f where f.chat_key = e.chat_key and f.entity_key = e.to_key)")
def graph_focus(spark, sf_dir):
    e = graph.edges(facts(spark, sf_dir))
    near = graph.ends(e.where("from_key = 's7' or to_key = 's7'")).select("chat_key", "entity_key").distinct()
    return graph.ends(e).join(near, ["chat_key", "entity_key"], "left_semi").select("fact_id", "chat_key", "from_key", "to_key").distinct()


@query(f"{RUNNING} select s.chat_key, s.item_id, s.event_id, case when s.before = s.after then 'noop' when s.after = 0 then 'used_up' when s.before = 0 then 'create' when s.after > s.before then 'increase' else 'decrease' end as decision from s")
def inventory_update_plan(spark, sf_dir):
    before, after = c("before"), c("after")
    decision = F.when(before == after, "noop").when(after == 0, "used_up").when(before == 0, "create").when(after > before, "increase").otherwise("decrease")
    return balances(spark, sf_dir).select("chat_key", "item_id", "event_id", decision.alias("decision"))


@query(f"{FACTS}, a as (select id, case when id % 3 = 0 then null else status end as before, status as after from facts where id % 9 < 6), n as (select f.id, a.id is not null as touched, before, status from facts f left join a on a.id = f.id) select id, coalesce(before, status) as status, touched from n where not (touched and before is null)")
def rolled_back(spark, sf_dir):
    """Undo a change set: before-images return, rows that it created go, all others stay."""
    f = view(spark, sf_dir, "facts").select("id", "status")
    images = f.where("id % 9 < 6").select("id", F.when(c("id") % 3 != 0, c("status")).alias("before"), F.lit(True).alias("touched"))
    j = f.join(images, "id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    return j.where(~(c("touched") & c("before").isNull())).select("id", F.coalesce("before", "status").alias("status"), "touched")


@query(f"{FACTS} select id, concat_ws('::', subject_key, predicate_key, case when kind in ('relationship', 'preference', 'capability') then object_key end) as slot_key, concat_ws('::', subject_key, predicate_key, object_key) as canonical_key from facts")
def fact_keys(spark, sf_dir):
    slot = F.when(c("kind").isin("relationship", "preference", "capability"), M.key_part(c("object_key")))
    return view(spark, sf_dir, "facts").select(
        "id", F.concat_ws("::", M.key_part(c("subject_key")), M.key_part(c("predicate_key")), slot).alias("slot_key"), M.canonical_key(c("subject_key"), c("predicate_key"), c("object_key")).alias("canonical_key")
    )


@query(f"{view_sql('traces')}, g as (select owner_id, count(*) as n from traces group by owner_id) select owner_id, case when owner_id = 'u0' then 0.2 when owner_id = 'u1' then 0.1 else 0.7 / greatest(1, count(*) over () - 2) end::double as share from g")
def budget_partition(spark, sf_dir):
    owners = view(spark, sf_dir, "traces").select("owner_id").distinct()
    others = owners.agg((F.count("*") - 2).alias("others"))
    share = F.when(c("owner_id") == "u0", 0.2).when(c("owner_id") == "u1", 0.1).otherwise(0.7 / F.greatest(F.lit(1), c("others")))
    return owners.join(F.broadcast(others), F.lit(True)).select("owner_id", share.alias("share"))  # one row


@query(f"{view_sql('traces')}, u as (select owner_id, fact_id, id, id % 2 as later from traces), r as (select *, row_number() over (partition by owner_id, fact_id order by later, id) as k from u) select owner_id, fact_id, id from r where k = 1")
def response_merge(spark, sf_dir):
    """First response wins, the expansion adds facts that it lacks."""
    t = view(spark, sf_dir, "traces").select("owner_id", "fact_id", "id")
    both = t.withColumn("later", c("id") % 2)  # even ids are of the first response
    return both.groupBy("owner_id", "fact_id").agg(F.min(F.struct("later", "id")).alias("m")).select("owner_id", "fact_id", c("m.id").alias("id"))


@query(f"{FACTS} select chat_key, subject_key, last(id order by updated_at, id) as last_id, count(*) as n from facts group by chat_key, subject_key")
def unique_last(spark, sf_dir):
    return view(spark, sf_dir, "facts").groupBy("chat_key", "subject_key").agg(F.max_by("id", F.struct("updated_at", "id")).alias("last_id"), F.count("*").alias("n"))
