"""Queries over the last steps of recall: graph candidates, fusion of three lists, diversified choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.cuts import cut
from hearthledger.functions import memory as M
from hearthledger.operators import graph, retrieval
from hearthledger.operators import planning as Q
from hearthledger.operators import selection as S
from hearthledger.functions.memory import MUTABLE_KINDS
from hearthledger.plans.catalogue import AFFINITY_SQL, BLEND, BM25, CONTEXT_SQL, EDGES, ENTITY_SQL, REASON, LEXICAL_SQL, ORACLE, TOKENS, VECTORS, blended, nearest, weighed, c, query, r6, read, recall_bm25, recall_lexical_topk, recalled
from hearthledger.plans.workflows import LEX
from hearthledger.sources.adapters import FACTS, facts, view

CHAT = "concat('src', item_id % 20)"
GRAPH = f"""{EDGES}, {BM25}, {LEX}, own as (select distinct query_id, chat_key, unnest([subject_key, object_key]) as entity_key from l join facts using (id) where chat_key is not null),
given as (select * from own where entity_key is not null), lab as (select distinct chat_key, entity_key from n),
qs as (select item_id as query_id, {CHAT} as chat_key, lower(coalesce(text, '')) as text, {TOKENS} as ts from benchmark),
hit as (select query_id, chat_key, entity_key from qs join lab using (chat_key) where contains(text, lower(entity_key)) or len(list_filter(ts, lambda t: contains(lower(entity_key), t))) > 0),
more as (select hit.*, 8 - coalesce(k.n, 0) as free, row_number() over (partition by query_id order by entity_key, chat_key) as k from hit anti join given using (query_id, chat_key, entity_key) left join (select query_id, count(*) as n from given group by query_id) k using (query_id)),
seed as (select query_id, chat_key, entity_key from (select query_id, chat_key, entity_key from given union all select query_id, chat_key, entity_key from more where k <= free) qualify row_number() over (partition by query_id order by entity_key, chat_key) <= 8),
one as (select distinct query_id, chat_key, fact_id, from_key, to_key, confidence, updated_at from seed join n using (chat_key, entity_key)),
a as (select * from one qualify row_number() over (partition by query_id order by confidence desc, updated_at desc, fact_id) <= 24),
fr as (select distinct query_id, chat_key, unnest([from_key, to_key]) as entity_key from a),
b as (select distinct query_id, chat_key, fact_id, n.from_key, n.to_key, confidence, updated_at from fr join n using (chat_key, entity_key) anti join (select query_id, fact_id from a) using (query_id, fact_id)),
u as (select *, 1 as hop from a union all by name select *, 2 as hop from b), got as (select * from u qualify row_number() over (partition by query_id order by hop, confidence desc, updated_at desc, fact_id) <= 24),
g as (select query_id, fact_id as id, round(greatest(0.01, least(1.0, confidence)) / hop, 6) as score, row_number() over (partition by query_id order by greatest(0.01, least(1.0, confidence)) / hop desc, updated_at desc, fact_id) as rank from got)"""


def reached(spark, sf_dir, found):
    """(query_id, id, score, rank) of the graph: seeds are what the best facts, `found` (a table), are about, and labels that a query names."""
    e = graph.edges(facts(spark, sf_dir))
    about = found.join(view(spark, sf_dir, "facts").where("chat_key is not null"), "id").select("query_id", "chat_key", F.explode(F.array("subject_key", "object_key")).alias("entity_key")).where("entity_key is not null")
    q = read(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", f"{CHAT} as chat_key", "text")
    return S.graph_list(e, S.seeds(about, graph.ends(e).select("chat_key", "entity_key"), q))


@query(f"{GRAPH} select query_id, id, score, rank from g")
def graph_candidates(spark, sf_dir):
    """Facts within two hops of what each query is about."""
    return reached(spark, sf_dir, cut(recall_bm25(spark, sf_dir).select("query_id", "id"))).withColumn("score", r6(c("score")))


@query(f"""{GRAPH}, {VECTORS.replace('n as (select', 'vn as (select')}, w as (select query_id, id, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from s),
r as (select query_id, id, 'lexical' as list, rank, 0.4 / (60 + rank) as part from w where rank <= 12 union all select query_id, fact_id, 'vector', rank, 0.4 / (60 + rank) from vn union all select query_id, id, 'graph', rank, 0.2 / (60 + rank) from g)
select query_id, id, round(sum(part), 6)::double as fusion, max(rank) filter (list = 'lexical') as lexical_rank, max(rank) filter (list = 'vector') as vector_rank, max(rank) filter (list = 'graph') as graph_rank from r group by query_id, id""")
def rrf_three_lists(spark, sf_dir):
    """Reciprocal ranks of words, vectors and graph, fused."""
    lex = cut(recall_bm25(spark, sf_dir).select("query_id", "id", "rank"))  # twelve rows a query, which the list and the graph read
    vec = nearest(spark, sf_dir).selectExpr("query_id", "fact_id as id", "rank")
    out = retrieval.fused({"lexical": (lex, 0.4), "vector": (vec, 0.4), "graph": (reached(spark, sf_dir, lex).select("query_id", "id", "rank"), 0.2)})
    return out.select("query_id", "id", r6(c("fusion")).alias("fusion"), "lexical_rank", "vector_rank", "graph_rank")


# Every fourth question asks for the past, every fourth for the earliest; parts are those of the items' own texts.
ASK = "concat(coalesce(text, ''), case item_id % 4 when 1 then '，之前' when 2 then '，最早' when 3 then '，一开始' else '' end)"
HELD = "lower(concat_ws(' ', coalesce(content, ''), subject_key, predicate_key, coalesce(object_key, '')))"
CUT = r"list_filter(list_transform(regexp_split_to_array(ask, '[、，,；;|/]|\s+[aA][nN][dD]\s+|和|及|与'), lambda x: trim(regexp_replace(x, '请问|请告诉我|查询|记忆|告诉我', '', 'g'))), lambda x: length(x) >= 2)[1:12]"


@query(f"""{LEXICAL_SQL}, qs as (select item_id as query_id, {ASK} as ask, item_id % 4 in (1, 2, 3) as historical, item_id % 4 in (2, 3) as earliest from benchmark), sg as (select *, {CUT} as segs from qs),
p as (select b.query_id, b.id, b.blend as score, f.updated_at, f.floor, f.stable_anchor as anchor, {AFFINITY_SQL.replace('kind', 'f.kind')} as affinity, {HELD} as held from b join facts f on f.id = b.id qualify row_number() over (partition by b.query_id order by b.blend desc, f.updated_at desc, b.id) <= 120),
h as (select p.* exclude (held), list_transform(segs, lambda x: len(list_filter(regexp_extract_all(lower(x), '[a-z0-9_:-]{{2,}}'), lambda t: contains(held, t)))) as hits, historical, earliest, len(segs) as asked from p join sg using (query_id)),
o as (select query_id, any_value(historical) as historical, any_value(earliest) as earliest, any_value(asked) as asked, (list(id order by score desc, updated_at desc, id) filter (anchor))[1:3] as anchors,
 list({{'id': id, 'score': score, 'updated_at': updated_at, 'hits': hits}} order by score desc, updated_at desc, id) filter (not anchor) as rows_,
 list(id order by floor, score desc, updated_at, id) filter (not anchor and affinity >= 0.8) as fitting from h group by query_id),
e2 as (select *, case when earliest and fitting is not null then fitting[1:1] else [] end as first from o),
g2 as (select *, list_filter(coalesce(rows_, []), lambda r: not list_contains(first, r.id)) as open from e2),
d2 as (select *, first || case when historical and asked >= 3 then list_transform(list_sort(list_transform(open, lambda r: {{'a': r.updated_at, 'b': r.id}})), lambda r: r.b)[1:12]
 when asked >= 2 then list_reduce(range(1, asked + 1), lambda taken, i: taken || list_filter([-(list_sort(list_transform(list_filter(open, lambda r: r.hits[i] > 0 and not list_contains(taken, r.id)), lambda r: {{'a': case when historical then -r.updated_at else 0 end, 'b': r.hits[i], 'c': r.score, 'd': -r.id}}))[-1]).d], lambda v: v is not null), []::bigint[]) else [] end as chosen from g2),
z as (select query_id, coalesce(anchors, []) || (chosen || list_filter(list_transform(coalesce(rows_, []), lambda r: r.id), lambda i: not list_contains(chosen, i)))[1:12 - len(coalesce(anchors, []))] as ids from d2)
select query_id, unnest(ids) as id, generate_subscripts(ids, 1) as place from z""")
def recall_diversified(spark, sf_dir):
    """What a query finally gets: anchors, rows for its parts or its time, then the best of the rest."""
    q = read(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", f"{ASK} as ask", "item_id % 4 in (1, 2, 3) as historical", "item_id % 4 in (2, 3) as earliest")
    f = view(spark, sf_dir, "facts").selectExpr("id", "updated_at", "floor", "kind", f"{HELD} as held").withColumn("affinity", M.kind_affinity(c("kind"), ["event", "state"]))
    pool = retrieval.top(blended(spark, sf_dir), ["query_id"], [F.desc("blend"), F.desc("updated_at"), F.asc("id")], S.POOL, "turn").drop("turn", "updated_at")
    rows = f.join(retrieval.sent(pool, q), "id").join(q, "query_id")
    hits = S.segment_scores(c("held"), Q.segments_of(c("ask")))
    return S.diversified(rows.select("query_id", "id", c("blend").alias("score"), "updated_at", "floor", "affinity", "anchor", hits.alias("hits"), "historical", "earliest"))


SENT, HEAD = 8, "case when query_id % 4 = 1 then 2 when query_id % 4 = 2 then 1 else 0 end"
GIVEN = "unnest([{'at': 0, 'index': query_id % 3, 'score': 0.4}, {'at': 1, 'index': (query_id * 7) % 9, 'score': 0.9}, {'at': 2, 'index': 5, 'score': (query_id % 10) / 10.0}, {'at': 3, 'index': 5, 'score': 0.99}, {'at': 4, 'index': -1, 'score': 0.5}, {'at': 5, 'index': 40, 'score': 0.5}, {'at': 6, 'index': 1, 'score': 1.5}, {'at': 7, 'index': 4, 'score': 0.9}])"


@query(ORACLE["recall_lexical_topk"].replace("select query_id, id, blend, anchor, rank from r where rank <= 12", f"""select query_id, id, blend, rank, rank - 1 - {HEAD} as index from r where rank <= 12""").join(["with ranked as (", f"""), most as (select query_id, max(index) as most from ranked group by query_id), given as (select query_id, g.at as "turn", g.index as index, g.score::double as score from (select item_id as query_id, {GIVEN.replace('query_id', 'item_id')} as g from benchmark)),
good as (select query_id, index, arg_min(score, turn) as rerank from given join most using (query_id) where index >= 0 and index < least(most + 1, {SENT}) and score between 0 and 1 group by all),
j as (select query_id, id, rank, blend, index, case when index >= 0 then rerank end as rerank from ranked left join good using (query_id, index)),
k as (select *, case when index < 0 then 0 when rerank is not null then 1 when index < {SENT} then 2 else 3 end as kind from j)
select query_id, id, row_number() over (partition by query_id order by kind, case when kind = 1 then rerank end desc nulls last, rank) as place, round(case when rerank is not null then rerank * (0.85 + 0.15 * greatest(0.1, 1.0 / rank)) else blend end, 6)::double as score from k"""]))
def recall_reranked(spark, sf_dir):
    """Items after a reranker's answer, of which some results are wrong or come twice."""
    items = recall_lexical_topk(spark, sf_dir).select("query_id", "id", c("rank").alias("place"), c("blend").alias("score"), F.expr(HEAD).alias("head"))
    one = lambda at, index, score: F.struct(F.lit(at).alias("at"), index.cast("double").alias("index"), score.cast("double").alias("score"))
    q, n = c("item_id"), F.lit
    rows = F.array(one(0, q % 3, n(0.4)), one(1, q * 7 % 9, n(0.9)), one(2, n(5), q % 10 / 10), one(3, n(5), n(0.99)), one(4, n(-1), n(0.5)), one(5, n(40), n(0.5)), one(6, n(1), n(1.5)), one(7, n(4), n(0.9)))
    results = read(spark, sf_dir, "benchmark").select(q.alias("query_id"), F.inline(rows))
    return S.reranked(items, results, "head", SENT).withColumn("score", r6(c("score")))


TOPIC = "[coalesce(list_extract({t}, 3), ''), concat('s', {q} % 8, ' '), concat('P', {q} % 13)]"
BARE = "lower(regexp_replace({}, '\\s+', '', 'g'))"


@query(ORACLE["recall_bm25"].replace("with ", "", 1).join([f"{FACTS}, ", ""]).replace("select query_id, id, round(score, 6) as score, rank from r where rank <= 12", f"""select query_id, id, len(list_filter(terms, lambda t: length(t) >= 2 and len(list_filter(held, lambda v: length(v) >= 2 and (contains(v, t) or contains(t, v)))) > 0)) > 0 as on_topic,
len(list_filter(terms, lambda t: length(t) >= 2 and contains(body, t) and regexp_matches(body[strpos(body, t) + length(t):strpos(body, t) + length(t) + 31], '{S.DEFINES}'))) > 0 as defines
from (select query_id, id, list_transform({TOPIC.format(t=TOKENS.replace('text', 'm.text'), q='query_id')}, lambda x: {BARE.format('x')}) as terms, regexp_replace(concat(coalesce(content, ''), '。s', query_id % 8, '是 x'), '\\s+', '', 'g') as body,
 list_transform([concat(coalesce(content, ''), '。s', query_id % 8, '是 x'), subject_key, predicate_key, coalesce(object_key, '')], lambda x: {BARE.format('x')}) as held from r join facts using (id) join benchmark m on m.item_id = query_id where rank <= 12)"""))
def topic_matches(spark, sf_dir):
    """Which recalled facts are on a question's topic, and which say what the topic is."""
    terms = F.array(F.coalesce(F.get(M.tokens(F.coalesce(c("text"), F.lit(""))), F.lit(2)), F.lit("")), F.concat(F.lit("s"), c("item_id") % 8, F.lit(" ")), F.concat(F.lit("P"), c("item_id") % 13))
    q = read(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), terms.alias("terms"))
    rows = view(spark, sf_dir, "facts").select("id", "content", "subject_key", "predicate_key", "object_key").join(recalled(spark, sf_dir).select("query_id", "id"), "id").join(q, "query_id")
    rows = rows.withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit("。s"), c("query_id") % 8, F.lit("是 x")))
    about = S.matches_topic([c("content"), c("subject_key"), c("predicate_key"), c("object_key")], c("terms"))
    return rows.select("query_id", "id", about.alias("on_topic"), S.defines(F.lower("content"), F.transform("terms", lambda t: F.lower(t))).alias("defines"))


NEWEST = "{'a': coalesce(valid_from, updated_at), 'b': updated_at, 'd': id}"


@query(f"""{FACTS}, {BM25}, st as (select q.query_id, w.id, count(*) as strong from (select distinct item_id as query_id, unnest({TOKENS}) as token from benchmark) q join (select distinct doc_id as id, unnest({TOKENS}) as token from documents) w using (token) where len(token) >= 5 group by all having count(*) >= 2),
x0 as (select query_id, f.*, s.score from facts f join s on f.id = s.id), x as materialized (select *, {REASON} as ineligible, {ENTITY_SQL} as entity, {CONTEXT_SQL} as context, {BLEND} as blend, {NEWEST} as newest from x0),
sn as (select query_id, chat_key, subject_key, max(newest) as snapshot from x where ineligible is null and state_ref group by all), hd as (select query_id, chat_key, kind, subject_key, predicate_key, max(newest) as head from x where ineligible is null and kind in ('state', 'location') group by all),
r as (select x.query_id, x.id, blend, updated_at, case when ineligible is not null then ineligible when kind in ('state', 'location') and not state_ref and coalesce(snapshot > newest, false) then 'snapshot' when kind in ('state', 'location') and coalesce(head > newest, false) then 'slot'
 when coalesce(strong, 0) < 2 and entity <= 0 and context <= 0 then 'overlap' end as reason from x left join sn using (query_id, chat_key, subject_key) left join hd using (query_id, chat_key, kind, subject_key, predicate_key) left join st on st.query_id = x.query_id and st.id = x.id)
select query_id, id, blend, reason, case when reason is null then row_number() over (partition by query_id, reason is null order by blend desc, updated_at desc, id) end as rank from r""")
def candidate_decisions(spark, sf_dir):
    """Every candidate of each question: its score, the gate that bars it, its rank among those that pass."""
    held = ["query_id", "id", "chat_key", "kind", "subject_key", "predicate_key", "updated_at", "valid_from", "state_ref", "entity", "context", "strong", "ineligible", c("blend").alias("score")]
    fit, barred = (weighed(spark, sf_dir, f"ineligible is {which}").select(*held) for which in ("null", "not null"))
    return S.decided(fit, list(MUTABLE_KINDS), barred).select("query_id", "id", c("score").alias("blend"), "reason", "rank")
