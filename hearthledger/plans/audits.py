"""Queries over sources, scenes, coverage, lineage and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthledger import ship
from hearthledger.operators import audits as A
from hearthledger.operators import usage as U
from hearthledger.operators import graph
from hearthledger.plans.catalogue import OK_SQL, TRACES, c, long, query, r6, read, recallable
from hearthledger.sources.adapters import FACTS, facts, pick, view, view_sql

BLOCK = {
    "id": "conv_id * 1000 + turn",
    "chat_key": "conv_id",
    "floor": "turn",
    "kind": "case when turn % 9 = 4 then 'worldbook' else 'message' end",
    "role": "role",
    "message_type": "case when (conv_id + turn) % 13 = 0 then 'tool' when (conv_id + turn) % 17 = 0 then 'reasoning' else 'conversation' end",
    "hidden": "(conv_id % 5 = 0 and turn % 3 = 1)",
    "visibility": "case when (conv_id + turn) % 19 = 0 then 'control' else 'shown' end",
    "content": "coalesce(text, '')",
}
BLOCKS = "sourced as (select " + ", ".join(f"{e} as {n}" for n, e in BLOCK.items()) + " from conversations)"
CLEAN = "trim(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')"


def sourced(spark, sf_dir):
    return read(spark, sf_dir, "conversations").selectExpr(*(f"{e} as {n}" for n, e in BLOCK.items()))


OPEN = f"select id, chat_key, floor, length({CLEAN}) as chars from sourced where visibility <> 'control' and message_type not in ('tool', 'reasoning', 'system') and role not in ('tool', 'system') and {CLEAN} <> ''"


@query(f"with {BLOCKS} {OPEN} and not hidden")
def open_source_blocks(spark, sf_dir):
    return A.open_sources(sourced(spark, sf_dir)).select("id", "chat_key", "floor", long(F.length("content")).alias("chars"))


@query(f"with {BLOCKS} {OPEN} and (not hidden or (kind = 'message' and role in ('user', 'assistant')))")
def open_source_blocks_with_hidden(spark, sf_dir):
    return A.open_sources(sourced(spark, sf_dir), hidden_too=True).select("id", "chat_key", "floor", long(F.length("content")).alias("chars"))


@query("""with a as (select conv_id::varchar as id, 'chat' as kind, text, 0 as place from conversations where turn = 0 union all select doc_id::varchar, 'worldbook', text, 1 from documents union all select c_custkey::varchar, 'persona', c_name, 2 from customer
union all select concat('b', item_id), 'state', text, 3 from benchmark union all select n_nationkey::varchar, 'host_card', n_name, 4 from nation),
r as (select *, row_number() over (partition by id order by place) as k from a) select id, kind, length(coalesce(text, '')) as chars from r where k = 1""")
def current_chat_sources(spark, sf_dir):
    """Sources of five kinds in one list; the first kind that has an id gives its row."""
    of = lambda t, key, kind, text, where="true": read(spark, sf_dir, t).where(where).selectExpr(f"{key} as id", f"'{kind}' as kind", f"{text} as text")
    lists = [
        of("conversations", "cast(conv_id as string)", "chat", "text", "turn = 0").groupBy("id").agg(F.first("kind").alias("kind"), F.first("text").alias("text")), of("documents", "cast(doc_id as string)", "worldbook", "text"),
        of("customer", "cast(c_custkey as string)", "persona", "c_name"), of("benchmark", "concat('b', item_id)", "state", "text"), of("nation", "cast(n_nationkey as string)", "host_card", "n_name"),
    ]
    return A.all_sources(*lists).select("id", "kind", long(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query(f"""{view_sql('blocks')}, a as (select chat_key, floor, sum(length(content))::bigint as size from blocks where role in ('user', 'assistant') group by all),
b as (select *, (row_number() over (partition by chat_key order by floor) - 1) // 3 as batch from a),
p as (select *, unnest(generate_series(0, (size - 1) // 400)) as piece from b where size > 0) select chat_key, batch, floor, piece, piece * 400 as start, least(400, size - piece * 400) as chars from p""")
def capped_floor_batches(spark, sf_dir):
    return A.capped_batches(view(spark, sf_dir, "blocks"), 3, 400)


@query(f"""{view_sql('blocks')}, a as (select chat_key, floor, sum(length(content))::bigint as n from blocks where role in ('user', 'assistant') group by all), l as (select chat_key, list({{'f': floor, 'n': n}} order by floor) as rows_ from a group by chat_key),
k as (select chat_key, list_reduce(rows_, lambda s, r: list_append(s, case when len(s) = 0 then {{'f': r.f, 'b': 0::bigint, 'u': r.n, 'k': 1::bigint}} when s[-1].u >= 1600 or s[-1].u + r.n > 1600 or s[-1].k >= 4 then {{'f': r.f, 'b': s[-1].b + 1, 'u': r.n, 'k': 1::bigint}}
 else {{'f': r.f, 'b': s[-1].b, 'u': s[-1].u + r.n, 'k': s[-1].k + 1}} end), []::struct(f bigint, b bigint, u bigint, k bigint)[]) as out_ from l) select chat_key, o.f as floor, o.b as batch, o.u as used from (select chat_key, unnest(out_) as o from k)""")
def character_batches(spark, sf_dir):
    """Floors in batches by their characters."""
    ship(spark)
    return A.character_batches(view(spark, sf_dir, "blocks"), 1_600, 4)


@query()
def snapshot_chunks(spark, sf_dir):
    """Texts in chunks of 4 KiB of UTF-8, cut between characters, with a digest of each; tests hold it against a plain loop."""
    ship(spark)
    return A.utf8_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 4096).select("doc_id", "chunk", long(F.octet_length("text")).alias("bytes"), F.md5("text").alias("digest"))


# ---------------------------------------------------------------- scenes and casts
MOVES = f"{view_sql('traces')}, moves as (select scene_id as chat_key, owner_id, case when id % 3 = 0 then concat('place', id % 4) end as place, floor, id, id % 5 <> 0 as entered from traces)"


@query(f"""{MOVES}, p as (select *, lag(place) over (partition by chat_key order by floor, id) as before from moves where place is not null),
l as (select chat_key, sum((place <> before)::int)::bigint as epoch, last(place order by floor, id) as place from p group by chat_key),
o as (select chat_key, owner_id, last(entered order by floor, id) as entered from moves group by all),
w as (select chat_key, count(*) filter (entered) as present, count(*) filter (not entered) as exited from o group by chat_key) select w.chat_key, present, exited, coalesce(epoch, 0) as epoch, place from w left join l using (chat_key)""")
def scene_state(spark, sf_dir):
    m = view(spark, sf_dir, "traces").selectExpr("scene_id as chat_key", "owner_id", "case when id % 3 = 0 then concat('place', id % 4) end as place", "floor", "id", "id % 5 <> 0 as entered")
    return A.scene_state(m).select("chat_key", "present", "exited", F.coalesce("epoch", F.lit(0)).alias("epoch"), "place")


@query(f"""{view_sql('traces')}, s as (select scene_id, owner_id, id % 7 = 0 as first, floor, id % 4 = 0 as moved, id % 6 = 0 as crossed, learned_at < 3000000 as old, id from traces)
select id, case when first then 'scene_transition' when moved then 'scene_transition' when crossed then 'update_presence' else 'reuse' end as decision, case when first then 'initial' when moved then 'explicit' when crossed then 'presence' when old then 'history' else 'reuse' end as reason from s""")
def scene_update_plan(spark, sf_dir):
    """What a source does to a scene: the first rule that holds."""
    s = view(spark, sf_dir, "traces").selectExpr("id", "id % 7 = 0 as first", "id % 4 = 0 as moved", "id % 6 = 0 as crossed", "learned_at < 3000000 as old")
    what = F.when(c("first") | c("moved"), "scene_transition").when(c("crossed"), "update_presence").otherwise("reuse")
    return s.select("id", what.alias("decision"), F.when(c("first"), "initial").when(c("moved"), "explicit").when(c("crossed"), "presence").when(c("old"), "history").otherwise("reuse").alias("reason"))


@query(f"{view_sql('traces')}, m as (select distinct scene_id, owner_id from traces where id % 3 = 0), s as (select distinct scene_id, owner_id from traces where id % 4 <> 0) select scene_id, owner_id, 'present' as role from s anti join m using (scene_id, owner_id) union all select scene_id, owner_id, 'member' from m")
def planning_scene(spark, sf_dir):
    """A scene's members, and those present in its state whom the members lack."""
    t = view(spark, sf_dir, "traces")
    m, s = (t.where(e).select("scene_id", "owner_id").distinct() for e in ("id % 3 = 0", "id % 4 <> 0"))
    return m.withColumn("role", F.lit("member")).unionByName(s.join(m, ["scene_id", "owner_id"], "left_anti").withColumn("role", F.lit("present")))


@query(f"""{FACTS}, ok as (select * from facts where status = 'active' and (valid_from is null or valid_from <= 2592000000) and (valid_until is null or valid_until >= 1000000000))
select chat_key, kind, subject_key as owner, count(*) as facts from ok where kind in ('location', 'goal') and chat_key is not null group by all""")
def related_owners(spark, sf_dir):
    """Owners whom valid facts of place and goal tie to a chat."""
    f = view(spark, sf_dir, "facts").where("status = 'active' and (valid_from is null or valid_from <= 2592000000) and (valid_until is null or valid_until >= 1000000000)")
    return f.where("kind in ('location', 'goal') and chat_key is not null").groupBy("chat_key", "kind", c("subject_key").alias("owner")).agg(F.count("*").alias("facts"))


@query("with e as (select *, case event_type when 'error' then 'failed' else 'done' end as state from events) select event_id as id, user_id as scene, state from e where state = 'failed' and value is not null and value > 10 order by ts desc, event_id limit 200")
def visible_scene_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("state", F.when(c("event_type") == "error", "failed").otherwise("done"))
    return e.where("state = 'failed' and value is not null and value > 10").orderBy(F.desc("ts"), "event_id").limit(200).select(c("event_id").alias("id"), c("user_id").alias("scene"), "state")


@query(f"{view_sql('inventory')}, i as (select chat_key, item_id, count(*) as events, max(amount) as most, bool_or(operation = 'set') as counted from inventory group by all) select chat_key, item_id, events, most from i where counted and events >= 2 and item_id % 10 in (1, 5)")
def inventory_workbench(spark, sf_dir):
    """Items whose amount was ever counted, filtered by number of events and name."""
    i = view(spark, sf_dir, "inventory").groupBy("chat_key", "item_id").agg(F.count("*").alias("events"), F.max("amount").alias("most"), F.bool_or(c("operation") == "set").alias("counted"))
    return i.where("counted and events >= 2 and item_id % 10 in (1, 5)").select("chat_key", "item_id", "events", "most")


# ---------------------------------------------------------------- joins of audits
@query(f"""{view_sql('repairs')}, q as (select id as repair_id, job_id, batch, status from repairs where status <> 'resolved'), r as (select event_id as rejection_id, user_id as job_id, event_id % 7 as batch from events where event_type = 'error')
select coalesce(q.job_id, r.job_id) as job_id, coalesce(q.batch, r.batch) as batch, count(distinct repair_id) as repairs, count(distinct rejection_id) as rejections from q full join r on q.repair_id = r.rejection_id and q.job_id = r.job_id and q.batch = r.batch group by 1, 2""")
def rejection_repairs(spark, sf_dir):
    """Rejections and the repairs that took them up, within job and batch; either side may stand alone."""
    q = view(spark, sf_dir, "repairs").where("status <> 'resolved'").selectExpr("id as rejection_id", "job_id", "batch", "id as repair_id")
    r = read(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("event_id as rejection_id", "user_id as job_id", "event_id % 7 as batch", "event_id as rejected")
    j = q.join(r, ["rejection_id", "job_id", "batch"], "full")
    return j.groupBy("job_id", "batch").agg(F.countDistinct("repair_id").alias("repairs"), F.countDistinct("rejected").alias("rejections"))


NAMED = "a as (select c_custkey as owner_id, split_part(c_name, '#', 2) as tail, c_name from customer), t as (select tail, count(*) as n, min(owner_id) as owner_id from (select owner_id, right(tail, 3) as tail from a) group by tail)"


@query(f"""with {NAMED}, m as (select o_orderkey as id, case when o_orderkey % 2 = 0 then concat('Customer#', lpad(o_custkey::varchar, 9, '0')) else lpad((o_custkey % 1000)::varchar, 3, '0') end as ref from orders)
select id, case when a.owner_id is not null then 'exact' when n = 1 then 'suffix' when n > 1 then 'ambiguous' else 'unknown' end as repair, coalesce(a.owner_id, case when n = 1 then t.owner_id end) as owner_id from m left join a on a.c_name = ref left join t on t.tail = right(ref, 3) and a.owner_id is null""")
def unique_suffix_repair(spark, sf_dir):
    """A reference by exact name, else by an ending that one name alone has; two equi-joins."""
    a = read(spark, sf_dir, "customer").selectExpr("c_custkey as exact_id", "c_name as ref")
    t = a.groupBy(F.expr("right(ref, 3)").alias("tail")).agg(F.count("*").alias("n"), F.min("exact_id").alias("suffix_id"))
    m = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 2 = 0 then concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) else lpad(cast(o_custkey % 1000 as string), 3, '0') end as ref")
    j = m.join(a, "ref", "left").withColumn("tail", F.when(c("exact_id").isNull(), F.expr("right(ref, 3)"))).join(t, "tail", "left")
    how = F.when(c("exact_id").isNotNull(), "exact").when(c("n") == 1, "suffix").when(c("n") > 1, "ambiguous").otherwise("unknown")
    return j.select("id", how.alias("repair"), F.coalesce("exact_id", F.when(c("n") == 1, c("suffix_id"))).alias("owner_id"))


DETAIL = "d as (select event_id as detail_id, event_id * 3 as message_id, user_id * 100000 + event_id % 40 as created, event_id % 977 as position from events), m as (select o_orderkey as message, o_orderkey as message_id, o_custkey * 100000 + o_orderkey % 40 as created, o_orderkey % 977 as position from orders)"


@query(f"""with {DETAIL}, u as (select message, detail_id, 1 as tier from m join d using (message_id) union all select message, detail_id, 2 from m join d using (created) union all select message, detail_id, 3 from m join d using (position)),
r as (select message, tier, min(detail_id) as detail_id, min(tier) over (partition by message) as best from u group by message, tier) select message, detail_id, tier::bigint as tier from r where tier = best""")
def message_recall_detail(spark, sf_dir):
    """A message's recall detail: by id, else by moment, else by place."""
    d = read(spark, sf_dir, "events").selectExpr("event_id as detail_id", "event_id * 3 as message_id", "user_id * 100000 + event_id % 40 as created", "event_id % 977 as position")
    m = read(spark, sf_dir, "orders").selectExpr("o_orderkey as message", "o_orderkey as message_id", "o_custkey * 100000 + o_orderkey % 40 as created", "o_orderkey % 977 as position")
    return A.matched_in_turn(m, d, "message", "detail_id", ["message_id", "created", "position"])


@query(f"{view_sql('blocks')}, t as (select distinct o_custkey as chat_key, o_orderkey % 6 as floor from orders) select b.chat_key, b.floor, role from blocks b semi join t using (chat_key, floor)")
def messages_at_targets(spark, sf_dir):
    """Messages at many asked places, as one semi-join rather than a lookup each."""
    t = read(spark, sf_dir, "orders").selectExpr("o_custkey as chat_key", "o_orderkey % 6 as floor").distinct()
    return view(spark, sf_dir, "blocks").join(t, ["chat_key", "floor"], "left_semi").select("chat_key", "floor", "role")


@query(f"""{view_sql('traces', 'scenes')}, o as (select id, unnest([fact_id, fact_id + 1]) as fact_id, scene_id, floor from traces), e as (select min(id) as episode_id, chat_key, start_floor from scenes group by chat_key, start_floor)
select fact_id, count(distinct o.id) as observations, count(distinct episode_id) as episodes, min(episode_id) as first_episode from o left join e on e.chat_key = scene_id and start_floor = floor group by fact_id""")
def observed_facts(spark, sf_dir):
    """Facts with the observations that name them and the episodes those belong to."""
    o = view(spark, sf_dir, "traces").select("id", F.explode(F.array(c("fact_id"), c("fact_id") + 1)).alias("fact_id"), c("scene_id").alias("chat_key"), c("floor").alias("start_floor"))
    e = view(spark, sf_dir, "scenes").groupBy("chat_key", "start_floor").agg(F.min("id").alias("episode_id"))
    return o.join(e, ["chat_key", "start_floor"], "left").groupBy("fact_id").agg(F.countDistinct("id").alias("observations"), F.countDistinct("episode_id").alias("episodes"), F.min("episode_id").alias("first_episode"))


@query(f"""{view_sql('traces')}, k as (select owner_id, fact_id, list(id) as trace_ids, max(strength) as score from traces group by all), p as (select owner_id, id as trace_id, fact_id from traces),
j as (select p.owner_id, trace_id, p.fact_id, score from p join k on k.owner_id = p.owner_id and list_contains(trace_ids, trace_id)) select fact_id, max(trace_id) as trace_id, count(*) as packets, max(score) as score from j group by fact_id""")
def injected_rows(spark, sf_dir):
    """Packets with the candidates whose traces hold them; by exploded trace ids, one row a fact."""
    t = view(spark, sf_dir, "traces")
    k = t.groupBy("owner_id", "fact_id").agg(F.collect_list("id").alias("trace_ids"), F.max("strength").alias("score"))
    held = k.select("owner_id", F.explode("trace_ids").alias("trace_id"), "score")
    p = t.select("owner_id", c("id").alias("trace_id"), "fact_id")
    return p.join(held, ["owner_id", "trace_id"]).groupBy("fact_id").agg(F.max("trace_id").alias("trace_id"), F.count("*").alias("packets"), F.max("score").alias("score"))


# ---------------------------------------------------------------- roll-ups and set tests
@query(f"{view_sql('usage')}, s as (select id, prompt, completion, case when id % 13 = 0 then null when prompt is null and completion is null then null else coalesce(prompt, 0) + coalesce(completion, 0) end as total from usage) select count(*) as stages, sum(prompt)::bigint as prompt, sum(completion)::bigint as completion, sum(total)::bigint as total, count(total) as reported from s")
def stage_usage(spark, sf_dir):
    """Usage of all stages; what no stage reports stays unknown."""
    total = F.when((c("id") % 13 == 0) | (c("prompt").isNull() & c("completion").isNull()), F.lit(None)).otherwise(F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)))
    u = view(spark, sf_dir, "usage").withColumn("total", total)
    return u.agg(F.count("*").alias("stages"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("total").alias("total"), F.count("total").alias("reported"))


@query(f"{view_sql('repairs')} select job_id, batch, count(*) as records, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'resolved') as resolved, max(attempts) as attempts, count(distinct collection) as collections, bool_or(status = 'quarantined') as failed from repairs group by job_id, batch")
def pipeline_audit(spark, sf_dir):
    n = lambda s: F.count(F.when(c("status") == s, 1))
    return view(spark, sf_dir, "repairs").groupBy("job_id", "batch").agg(
        F.count("*").alias("records"), n("pending").alias("pending"), n("resolved").alias("resolved"), F.max("attempts").alias("attempts"), F.countDistinct("collection").alias("collections"), F.bool_or(c("status") == "quarantined").alias("failed")
    )


@query(f"""{view_sql('repairs')} select job_id, id, status, attempts from repairs where status in ('pending', 'quarantined') and attempts >= 2 and collection <> 'batch' order by attempts desc, id desc limit 100""")
def audit_page(spark, sf_dir):
    r = view(spark, sf_dir, "repairs").where("status in ('pending', 'quarantined') and attempts >= 2 and collection <> 'batch'")
    return r.orderBy(F.desc("attempts"), F.desc("id")).limit(100).select("job_id", "id", "status", "attempts")


@query(f"{view_sql('repairs')}, r as (select *, row_number() over (partition by job_id order by collection_rank, batch, item, id) as place from repairs where status = 'pending') select job_id, id, place, (place - 1) // 8 as turn from r")
def repair_order(spark, sf_dir):
    """Waiting repairs in their order, eight at a time."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("collection_rank", "batch", "item", "id"))
    r = view(spark, sf_dir, "repairs").where("status = 'pending'").withColumn("place", long(place))
    return r.select("job_id", "id", "place", long(F.floor((c("place") - 1) / 8)).alias("turn"))


@query(f"""{TRACES}, {OK_SQL}, s as (select owner_id, permission, count(*) filter (id % 3 = 0) as packets, count(*) filter (privacy <> 'public' and permission in ('public_only', 'identity_only')) as breaches from ok group by all)
select p.owner_id, coalesce(packets, 0) as packets, coalesce(breaches, 0) as breaches, p.budget > 3 and coalesce(packets, 0) = 0 as missing from plan p left join s using (owner_id)""")
def coverage_check(spark, sf_dir):
    """Per owner of the plan: packets, breaches of privacy, and whether a required owner has none."""
    s = recallable(spark, sf_dir).groupBy("owner_id").agg(F.count(F.when(c("id") % 3 == 0, 1)).alias("packets"), F.count(F.when((c("privacy") != "public") & c("permission").isin("public_only", "identity_only"), 1)).alias("breaches"))
    p = spark.range(40).selectExpr("concat('u', id) as owner_id", "id % 6 + 1 as budget")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return p.join(s, "owner_id", "left").select("owner_id", zero("packets").alias("packets"), zero("breaches").alias("breaches"), ((c("budget") > 3) & (zero("packets") == 0)).alias("missing"))


@query(f"{view_sql('traces')}, a as (select distinct owner_id, fact_id from traces where id % 2 = 0), b as (select distinct owner_id, fact_id from traces where id % 2 = 1) select owner_id, count(*) filter (a.fact_id is null) as fresh, count(*) filter (a.fact_id is null) > 0 as expands from b left join a using (owner_id, fact_id) group by owner_id")
def expansion_is_new(spark, sf_dir):
    """Whether an expansion finds anything that the first response lacks."""
    t = view(spark, sf_dir, "traces")
    a, b = (t.where(f"id % 2 = {k}").select("owner_id", "fact_id").distinct() for k in (0, 1))
    j = b.join(a.withColumn("held", F.lit(True)), ["owner_id", "fact_id"], "left").groupBy("owner_id").agg(F.count(F.when(c("held").isNull(), 1)).alias("fresh"))
    return j.select("owner_id", "fresh", (c("fresh") > 0).alias("expands"))


@query(f"{view_sql('repairs')}, w as (select distinct source_ref from repairs where id % 31 = 5 and status = 'resolved') select id, source_ref, 'old' as origin from repairs anti join w using (source_ref) where status = 'quarantined' union all select id, source_ref, 'new' from repairs semi join w using (source_ref) where status = 'pending'")
def rejection_replacement(spark, sf_dir):
    """Rejections of rewritten sources give way to the new ones; all others stay."""
    r = view(spark, sf_dir, "repairs").select("id", "source_ref", "status")
    w = r.where("id % 31 = 5 and status = 'resolved'").select("source_ref").distinct()
    old = r.where("status = 'quarantined'").join(w, "source_ref", "left_anti").select("id", "source_ref", F.lit("old").alias("origin"))
    return old.unionByName(r.where("status = 'pending'").join(w, "source_ref", "left_semi").select("id", "source_ref", F.lit("new").alias("origin")))


# Outputs of a chat, line by line: some name a speaker; memories are sentences of the chat's turns.
OWNERS = [("u0", "Ann"), ("u1", "Bob"), ("u2", "Cy Lo")]
OUTPUT = "concat(case when turn % 2 = 0 then 'Ann: ' else '**Bob**： ' end, split_part(coalesce(text, ''), '.', 1), chr(10), '[cy lo]：', split_part(coalesce(text, ''), '.', 2), chr(10), split_part(coalesce(text, ''), '.', 3), chr(10), case when turn % 3 = 0 then 'Nobody: x' else '' end)"
MARKER = "trim(split_part(coalesce(text, ''), '.', cast(1 + (conv_id + turn * 2) % 4 as int)))"
SAYS = f"""o as (select conv_id * 1000 + turn as output_id, conv_id as chat_key, {OUTPUT} as text from conversations), p as (select conv_id * 1000 + turn as packet_id, conv_id as chat_key, concat('u', (conv_id + turn) % 3) as owner_id, {MARKER} as marker from conversations),
l as (select output_id, chat_key, unnest(regexp_split_to_array(text, '\\r?\\n')) as line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) as n from o),
w as (select output_id, chat_key, n, lower(regexp_replace(regexp_extract(line, '{U.LABEL}', 1), '[\\s*]+', '', 'g')) as name, regexp_extract(line, '{U.LABEL}', 2) as words from l),
t as (select output_id, chat_key, owner_id, string_agg(words, chr(10) order by n) as text from w join (values {', '.join(f"('{o}', '{n.lower().replace(' ', '')}')" for o, n in OWNERS)}) k(owner_id, name) using (name) group by all)"""


def told(spark, sf_dir):
    b = read(spark, sf_dir, "conversations")
    outputs = b.selectExpr("conv_id * 1000 + turn as output_id", "conv_id as chat_key", f"{OUTPUT} as text")
    packets = b.selectExpr("conv_id * 1000 + turn as packet_id", "conv_id as chat_key", "concat('u', (conv_id + turn) % 3) as owner_id", f"{MARKER} as marker")
    owners = b.select(c("conv_id").alias("chat_key")).distinct().select("chat_key", F.inline(F.array(*(F.struct(F.lit(o).alias("owner_id"), F.lit(n).alias("name")) for o, n in OWNERS))))
    return outputs, U.spoken(outputs, owners), packets


@query(f"with {SAYS} select distinct output_id, t.owner_id, p.owner_id as leaked_from, marker from t join p on p.chat_key = t.chat_key and p.owner_id <> t.owner_id and length(marker) >= 6 and contains(text, marker)")
def knowledge_leaks(spark, sf_dir):
    """Memories of one owner that another one of its chat says word for word."""
    _, said, packets = told(spark, sf_dir)
    return U.leaks(said, packets)


@query(f"""with {SAYS}, e as (select distinct packet_id from p join t on t.chat_key = p.chat_key and t.owner_id = p.owner_id and length(marker) >= 6 and contains(text, marker)), i as (select distinct packet_id from p join o on o.chat_key = p.chat_key and length(marker) >= 8 and contains(text, marker)),
u as (select packet_id, case when e.packet_id is not null then 'explicit' when i.packet_id is not null then 'implicit' else 'not_used' end as usage from (select distinct packet_id from p) left join e using (packet_id) left join i using (packet_id))
select packet_id, usage, case usage when 'explicit' then 1.0 when 'implicit' then 0.8 else 0.0 end::double as confidence from u""")
def memory_usage(spark, sf_dir):
    """How outputs used each memory: by its owner's own words, anyhow, or not."""
    outputs, said, packets = told(spark, sf_dir)
    return U.used(outputs, said, packets)


@query(f"{FACTS} select id, substring(content, greatest(1, strpos(content, ' the ') - 10), 40) as preview from facts where contains(content, ' the ')")
def source_preview(spark, sf_dir):
    """A window of text around what was asked for."""
    f = view(spark, sf_dir, "facts").where(F.contains("content", F.lit(" the ")))
    at = F.greatest(F.lit(1), F.locate(" the ", c("content")) - 10)
    return f.select("id", F.substring("content", at, F.lit(40)).alias("preview"))


# ---------------------------------------------------------------- integrity and fan-out
STORED = f"""{FACTS}, b as (select *, status = 'active' and confidence >= 0.75 and evidence and object_key is not null and kind in ('relationship', 'location', 'world_rule', 'goal', 'commitment', 'event') as backed from facts),
h as (select id + case when id % 50 = 0 then 1000000 else 0 end as fact_id, case when id % 60 = 1 then 'other' else chat_key end as chat_key from facts where status = 'active'), e as (select id as fact_id from facts where object_key is not null and id % 4 = 0), v as (select vec_id as fact_id from embeddings)"""


@query(f"""{STORED} select 'fact_without_chat' as problem, count(*) as n from facts where chat_key is null or trim(chat_key) = '' union all select 'head_without_fact', count(*) from h left join b on b.id = fact_id where b.chat_key is null
union all select 'head_of_other_chat', count(*) from h join b on b.id = fact_id where b.chat_key <> h.chat_key union all select 'edge_without_backing', count(*) from e left join b on b.id = fact_id where b.chat_key is null or not backed
union all select 'vector_without_fact', count(*) from v left join b on b.id = fact_id where b.chat_key is null""")
def integrity_problems(spark, sf_dir):
    f = facts(spark, sf_dir)
    backed = f.withColumn("backed", F.expr("status = 'active' and confidence >= 0.75 and evidence and object_key is not null and kind in ('relationship', 'location', 'world_rule', 'goal', 'commitment', 'event')"))
    h = f.where("status = 'active'").selectExpr("id + case when id % 50 = 0 then 1000000 else 0 end as fact_id", "case when id % 60 = 1 then 'other' else chat_key end as chat_key")
    return A.integrity(backed, h, f.where("object_key is not null and id % 4 = 0").selectExpr("id as fact_id"), view(spark, sf_dir, "vectors").select("fact_id"))


@query(f"""{FACTS}, e as (select id from facts where kind in ('relationship', 'location', 'world_rule', 'goal', 'commitment', 'event') and status = 'active' and confidence >= 0.75 and evidence and object_key is not null)
select 'graph' as derivation, count(*) as n from e union all select 'links', count(*) from facts where object_key is not null union all select 'vectors', count(*) from facts where status = 'active'""")
def derivation_fan_out(spark, sf_dir):
    """How many rows a capture derives of each kind."""
    f = facts(spark, sf_dir)
    n = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("derivation"), "n")
    return n(graph.edges(f), "graph").unionByName(n(f.where("object_key is not null"), "links")).unionByName(n(f.where("status = 'active'"), "vectors"))


@query(f"{FACTS}, h as (select chat_key, subject_key, predicate_key, count(*) as versions, max(updated_at) as newest, count(distinct kind) as kinds from facts group by all) select chat_key, count(*) as slots, sum(versions)::bigint as facts, round(avg(versions), 6) as mean_versions, max(newest) as newest from h group by chat_key")
def slot_lineage(spark, sf_dir):
    """Slots of each chat and how often they were rewritten."""
    h = view(spark, sf_dir, "facts").groupBy("chat_key", "subject_key", "predicate_key").agg(F.count("*").alias("versions"), F.max("updated_at").alias("newest"))
    return h.groupBy("chat_key").agg(F.count("*").alias("slots"), F.sum("versions").alias("facts"), r6(F.avg("versions")).alias("mean_versions"), F.max("newest").alias("newest"))
