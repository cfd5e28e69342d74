"""Queries about queries: what is asked, of whom, and how candidates are held against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.functions import memory as M
from hearthledger.operators import planning as P
from hearthledger.operators import selection as S
from hearthledger.plans.catalogue import ORACLE, TOKENS, c, long, query, r6, read, recalled
from hearthledger.sources.adapters import FACTS, SCOPES, pick, view

ASKED = """艾琳和林川是什么关系？他们现在还是朋友吗|林川现在在哪里？他的状态如何|世界规则是什么|之前发生过什么事件，艾琳知不知道|接下来应该如何指挥行动|防护服为什么会被污染；林川是否知道
从开始到现在经历的变化|名为星图 的地图在哪儿|艾琳能做什么|旁白如何描述镜头|这次污染的影响|你是谁|昨天艾琳答应了什么，林川为什么离开？最后呢|where is "star-map" and who owns it| |请问艾琳与林川、夏洛特的目标""".replace("\n", "|").split("|")
ASKS = f"""asks as (select item_id as id, concat({pick('item_id', ASKED)}, case when item_id % 3 = 1 then '，' when item_id % 3 = 2 then '？' else ' ' end, coalesce(text, '')) as query from benchmark),
named as (select *, list_filter(['艾琳', '林川', '夏洛特'], lambda n: contains(query, n)) as named from asks)"""


def asks(spark, sf_dir):
    """One question per benchmark item, before the item's own text, with the names of known owners that it holds."""
    a = read(spark, sf_dir, "benchmark").selectExpr("item_id as id", f"concat({pick('item_id', ASKED)}, case when item_id % 3 = 1 then '，' when item_id % 3 = 2 then '？' else ' ' end, coalesce(text, '')) as query")
    known = F.array(*(F.lit(n) for n in ("艾琳", "林川", "夏洛特")))
    return a.withColumn("named", F.filter(known, lambda n: F.contains(c("query"), n)))


has = lambda name: f"regexp_matches(query, '{P.CUES[name]}')"
SUB = f"""sub as (select id, unnest(p[1:8]) as query, generate_subscripts(p[1:8], 1)::bigint as part from (select id, case when len(p) > 0 then p else [trim(query)] end as p from
(select id, query, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(query), '[，,]([^，,]{{2,}}(?:{P.NEXT_PART}))', chr(10) || '\\1', 'g'), '[？?；;\\n]'), lambda x: trim(x)), lambda x: x <> '') as p from asks where trim(query) <> '')))"""
KINDS_SQL = f"""concat_ws(',', case when {has('identity')} then 'identity' end, case when {has('relationship')} then 'relationship' end, case when {has('event')} or {has('directive')} then 'event' end,
case when {has('directive')} then 'commitment,goal' end, case when {has('capability')} then 'capability' end, case when {has('state')} then 'state,location' end, case when {has('state')} and not {has('directive')} then 'goal' end,
case when {has('world')} or {has('definition')} or {has('protection')} then 'world_rule' end)"""
TIMES = f"({has('time')} or {has('timeline')})"
INTENT = f"""case when {has('relationship')} and n > 0 then 'relationship' when {has('knowledge')} and n > 0 then 'actor_knowledge'
when ({has('identity')} or {has('state')} or {has('capability')} or {has('causal')} or {has('impact')}) and n > 0 then 'actor_entity' when {has('protection')} and n = 0 then 'world_knowledge'
when {has('directive')} then 'scene_action' when {TIMES} then 'timeline' when {has('world')} or {has('definition')} or {has('impact')} then 'world_knowledge' else 'general' end"""
PLAN = f"""{ASKS}, {SUB}, k as (select id, count(*) as parts from sub group by id),
f as (select a.*, len(named) as n, coalesce(parts, 0) as parts, {TIMES}::int + {has('relationship')}::int + {has('event')}::int + {has('state')}::int + (len(named) > 0)::int as breadth from named a left join k using (id)),
g as (select *, {INTENT} as intent_kind, case when {has('time')} and {has('current')} then 'mixed' when {has('time')} then 'historical' when {has('current')} then 'current' else 'unspecified' end as temporal,
 case when {has('causal')} and (parts > 1 or n > 1 or breadth >= 3) then 'multi_hop' when parts > 1 or breadth >= 3 then 'multi_topic' else 'direct' end as complexity from f),
p as (select *, case when {has('timeline')} or temporal = 'mixed' then 'timeline' when temporal = 'unspecified' then 'unknown' else temporal end as time_mode from g)"""


@query(f"""with {PLAN} select id, parts, concat_ws(',', case when {TIMES} then 'time' end, case when {has('relationship')} then 'relationship' end, case when {has('event')} then 'event' end, case when {has('state')} then 'state' end, case when n > 0 then 'actor' end) as facets,
temporal, time_mode, {KINDS_SQL} as kinds, intent_kind, case when intent_kind = 'world_knowledge' then 'world' when {has('narrator')} then 'narrator' when n > 0 then 'named_actors' else 'planned_cast' end as actor_mode,
complexity, case complexity when 'multi_hop' then 2 when 'multi_topic' then 1 else 0 end::bigint as graph_hops, complexity <> 'direct' or time_mode = 'timeline' as verify from p""")
def recall_intent_plan(spark, sf_dir):
    return P.plan(asks(spark, sf_dir), "id", "query", "named")


@query(f"with {ASKS}, {SUB} select id, part, query from sub")
def recall_sub_queries(spark, sf_dir):
    return P.sub_queries(asks(spark, sf_dir), "id", "query")


CAST = "case when id % 3 = 0 then ['艾琳'] else [] end as cast_, ['林川', '路人', '店主'] as likely, case when id % 4 = 0 then '夏洛特' end as viewpoint"


@query(f"""with {PLAN}, s as (select id, intent_kind, named, {CAST} from p),
o as (select id, unnest(['owner:world', 'owner:narrator']) as owner_id, false as required from s where intent_kind in ('world_knowledge', 'actor_entity', 'general')
union all select id, unnest(named), intent_kind <> 'actor_entity' from s where intent_kind in ('actor_entity', 'actor_knowledge', 'relationship', 'timeline')
union all select id, unnest(list_concat(case when viewpoint is not null then [viewpoint] else [] end, cast_)), true from s where intent_kind in ('scene_action', 'general') or (intent_kind = 'timeline' and len(named) = 0)
union all select id, unnest(likely[1:2]), false from s where intent_kind in ('scene_action', 'general'))
select id, owner_id, bool_or(required) as required from o group by id, owner_id""")
def recall_owner_scope(spark, sf_dir):
    a = asks(spark, sf_dir)
    intents = P.plan(a, "id", "query", "named").select("id", "intent_kind").join(a.select("id", "named"), "id")
    cast = intents.selectExpr("*", "case when id % 3 = 0 then array('艾琳') else cast(array() as array<string>) end as cast", "array('林川', '路人', '店主') as likely", "case when id % 4 = 0 then '夏洛特' end as viewpoint")
    return P.owner_scope(cast, "id")


SEGMENTS = r"""seg as (select id, unnest(list_filter(list_transform(regexp_split_to_array(query, '[、，,；;|/]|\s+[aA][nN][dD]\s+|和|及|与'), lambda x: trim(regexp_replace(x, '请问|请告诉我|查询|记忆|告诉我', '', 'g'))), lambda x: length(x) >= 2)[1:12]) as segment from asks)"""


@query(f"with {ASKS}, {SEGMENTS} select id, segment from seg")
def query_segments(spark, sf_dir):
    return P.segments(asks(spark, sf_dir), "id", "query")


TERMS = r"""terms as (select distinct id, unnest(list_concat(regexp_extract_all(lower(query), '[“‘"'']([\p{Han}a-z0-9_:-]{2,32})[”’"'']', 1),
regexp_extract_all(lower(query), '(?:名为|名叫|叫做|称为|代号为|编号为)\s*([\p{Han}a-z0-9_:-]{2,32}?)(?:的|[，。？！,!?；;\s]|$)', 1))) as term from asks)"""


@query(f"with {ASKS}, {TERMS} select id, term from terms")
def explicit_named_terms(spark, sf_dir):
    return P.named_terms(asks(spark, sf_dir), "id", "query")


NAMING = f"concat('where is “', coalesce(list_extract({TOKENS}, 3), 'x'), '”, 名为', coalesce(list_extract({TOKENS}, 5), 'y'), '的 thing? ', coalesce(text, ''))"


@query(rf"""with q as (select item_id as query_id, lower({NAMING}) as ask from benchmark),
n as (select query_id, unnest(list_distinct(regexp_extract_all(ask, '[“‘"'']([一-鿿a-z0-9_:-]{{2,32}})[”’"'']', 1) || regexp_extract_all(ask, '(?:名为|名叫|叫做|称为|代号为|编号为)\s*([一-鿿a-z0-9_:-]{{2,32}}?)(?:的|[，。？！,!?；;\s]|$)', 1))) as term from q)
select query_id, count(distinct doc_id) as passing, min(doc_id) as first_id from n join documents on contains(lower(text), term) group by query_id""")
def named_entity_gate(spark, sf_dir):
    """Facts that hold a name that a query puts in quotes or calls a name; all others are gated out."""
    get = lambda i: F.get(M.tokens(F.coalesce(c("text"), F.lit(""))), F.lit(i))
    ask = F.concat(F.lit("where is “"), F.coalesce(get(2), F.lit("x")), F.lit("”, 名为"), F.coalesce(get(4), F.lit("y")), F.lit("的 thing? "), F.coalesce("text", F.lit("")))
    terms = P.named_terms(read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), ask.alias("ask")), "query_id", "ask")
    held = S.holding_names(read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text"), terms)
    return held.groupBy("query_id").agg(F.count("*").alias("passing"), F.min("id").alias("first_id"))


ASKED_SCOPE = {"hosts": ["h0", "h1"], "people": ["c1", "c4"], "worlds": ["w0"], "scenes": ["s1"]}


def _scope_sql() -> str:
    held = ", ".join(f"{e.format(a='list_value').replace('list_value()', '[]::varchar[]')} as {n}" for n, e in SCOPES.items())
    hit = " + ".join(f"(list_has_any({n}, {v}))::int" for n, v in ASKED_SCOPE.items())
    dims = " + ".join(f"(len({n}) > 0)::int" for n in SCOPES)
    return f"{FACTS}, s as (select id, stable_anchor, {held} from facts), t as (select *, {hit} as hit, {dims} as dims from s) select id, case when dims = 0 then 0.0 else round(hit / dims, 6) end::double as scope, stable_anchor and hit > 0 as anchor from t"


@query(_scope_sql())
def scope_score(spark, sf_dir):
    """Share of a fact's scope dimensions that the query meets; stable anchors that meet any are taken."""
    held = [f"{e.format(a='array').replace('array()', 'cast(array() as array<string>)')} as {n}" for n, e in SCOPES.items()]
    s = view(spark, sf_dir, "facts").selectExpr("id", "stable_anchor", *held)
    hit = sum((F.arrays_overlap(n, F.array(*map(F.lit, v))).cast("int") for n, v in ASKED_SCOPE.items()), F.lit(0))
    dims = sum(((F.size(n) > 0).cast("int") for n in SCOPES), F.lit(0))
    return s.select("id", F.when(dims == 0, 0.0).otherwise(r6(hit / dims)).alias("scope"), (c("stable_anchor") & (hit > 0)).alias("anchor"))


@query(f"{FACTS}, s as (select id, list_distinct([subject_key, predicate_key, coalesce(object_key, subject_key)]) as a, ['s1', 's4', 'p2', 'p3', 'o5'] as b from facts) select id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6)::double as ratio from s")
def entity_overlap_ratio(spark, sf_dir):
    a, b = F.array_distinct(F.array("subject_key", "predicate_key", F.coalesce("object_key", "subject_key"))), F.array(*map(F.lit, ("s1", "s4", "p2", "p3", "o5")))
    return view(spark, sf_dir, "facts").select("id", r6(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).alias("ratio"))


@query(f"""with {PLAN}, w as (select *, {KINDS_SQL} as kinds from p) select id, case when complexity <> 'direct' or kinds <> '' or time_mode <> 'unknown' then 8 else 4 end::bigint as documents,
concat_ws(' ', case when contains(kinds, 'capability') then 'capability' end, case when time_mode = 'current' then 'latest' when time_mode in ('historical', 'timeline') then 'earliest' end, case when kinds <> '' then concat('kinds:', kinds) end) as priorities from w""")
def rerank_plan(spark, sf_dir):
    """How many documents a query sends to a reranker, and what it asks the reranker to prefer."""
    p = P.plan(asks(spark, sf_dir), "id", "query", "named")
    many = (c("complexity") != "direct") | (c("kinds") != "") | (c("time_mode") != "unknown")
    when = F.when(c("time_mode") == "current", "latest").when(c("time_mode").isin("historical", "timeline"), "earliest")
    return p.select("id", long(F.when(many, 8).otherwise(4)).alias("documents"), F.concat_ws(" ", F.when(F.contains("kinds", F.lit("capability")), "capability"), when, F.when(c("kinds") != "", F.concat(F.lit("kinds:"), "kinds"))).alias("priorities"))


@query(ORACLE["recall_bm25"].replace("select query_id, id, round(score, 6) as score, rank from r where rank <= 12", f"""select query_id, id, len(list_filter({TOKENS.replace('text', 'b.text')}, lambda t: contains(lower(x.text), t))) > 0 as signal
from r join benchmark b on b.item_id = query_id join documents x on x.doc_id = id where rank <= 12"""))
def query_signal(spark, sf_dir):
    """Whether a recalled text holds any token of its query."""
    texts = read(spark, sf_dir, "documents").selectExpr("doc_id as id", "lower(text) as held")
    want = read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), M.tokens(F.coalesce(c("text"), F.lit(""))).alias("ts"))
    return texts.join(recalled(spark, sf_dir).select("query_id", "id"), "id").join(want, "query_id").select("query_id", "id", F.exists("ts", lambda t: F.contains(c("held"), t)).alias("signal"))
