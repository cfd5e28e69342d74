"""Queries over captured proposals: six collections of JSON responses, their evidence and the reasons that reject them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.operators import proposals as P
from hearthledger.plans.catalogue import c, long, query, read
from hearthledger.sources.adapters import KINDS, pick

# A response of each conversation, made of its turns: names are words of a turn, excerpts its first sentence.
NAME = "coalesce(nullif(regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0), ''), '')"
SPAN = "trim(split_part(coalesce(text, ''), '.', 1))"
SPAN_ID = "concat('s', case when (conv_id * 3 + turn) % 17 = 4 then 'x' else '' end, turn)"
COMMON = "\"evidenceSpanId\":\"', {span}, '\",\"confidence\":', {conf}, '".format(span=SPAN_ID, conf="case when (conv_id + turn) % 19 = 6 then '1.5' else concat('0.', turn % 9 + 1) end")
ENTITY = "concat('{{\"localId\":\"', {id}, '\",\"displayName\":\"', {name}, '\",\"aliases\":[\"', {name}, 'x\"],\"category\":\"thing\",{common}}}')"
MADE = {
    "actorCandidates": ("turn % 3 = 0", ENTITY.format(id="case when (conv_id + turn) % 13 = 2 then '' else concat('a', case when conv_id % 4 = 1 then 0 else turn end) end", name=NAME, common=COMMON)),
    "locationCandidates": ("turn % 3 = 1", ENTITY.format(id="case when conv_id % 5 = 2 then 'a0' else concat('l', turn) end", name=NAME, common=COMMON)),
    "itemCandidates": ("turn % 3 = 2", ENTITY.format(id="concat('i', turn)", name=f"case when turn % 2 = 0 then {NAME} else 'ladder' end", common=COMMON)),
    "episodes": (
        "turn % 2 = 1",
        "concat('{{\"localId\":\"e', turn % 4, '\",\"summary\":\"', case when conv_id % 7 = 3 then 'short' else concat('told by ', {n}) end, '\",\"evidenceSpanIds\":[', case when conv_id % 11 = 0 then '' else concat('\"s0\",\"', {s}, '\"') end, '],\"participantRefs\":[\"a0\",\"world\"],\"presentRefs\":[\"a', turn % 5, '\"],\"mentionedRefs\":[]}}')".format(n=NAME, s=SPAN_ID),
    ),
    "claims": (
        "turn >= 0",
        "concat('{{\"localId\":\"c', turn % 6, '\",\"kind\":\"', {k}, '\",\"predicateKey\":\"', case when turn = 5 then ' ' else 'p' end, '\",\"subjectRef\":\"', case when turn % 2 = 0 then 'a0' else '' end, '\",\"objectRef\":\"', case when turn % 4 = 3 then 'l1' else '' end, '\",\"content\":\"', {n}, ' is so\",\"episodeLocalId\":\"', case when turn % 3 > 0 then concat('e', turn % 4) else '' end, '\",{common}}}')".format(
            k=pick("(conv_id + turn)", [*KINDS, "rumour"]), n=NAME, common=COMMON
        ),
    ),
    "inventoryOperations": (
        "turn % 2 = 0",
        "concat('{{\"localId\":\"o', turn, '\",\"itemRef\":\"i', turn % 3, '\",\"operation\":\"', {op}, '\",\"precision\":\"', case when turn = 4 then 'unknown' else 'exact' end, '\",\"amount\":', turn, ',{common}}}')".format(op=pick("turn % 3", ["increase", "remove", "set"]), common=COMMON),
    ),
}
WRITTEN = "conv_id as chat_key, concat('m', turn) as source_ref, coalesce(text, '') as content, (conv_id + turn) % 10 <> 9 as writable"
GIVEN = f"conv_id as chat_key, concat('s', turn) as span_id, concat('m', turn) as source_ref, case when (conv_id + turn) % 15 = 7 then concat({SPAN}, '?!') else {SPAN} end as text"
ODD = "case when conv_id % 29 = 3 then '[1]' when conv_id % 29 = 4 then 'none' when conv_id % 29 = 5 then '{\"claims\":[]}' end"
BODY = "concat('{{', {parts}, '}}')"


def captured(spark, sf_dir):
    """(chat_key, response): one JSON text a conversation."""
    turns = read(spark, sf_dir, "conversations")
    parts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr(cond), F.struct("turn", F.expr(made).alias("j"))))), lambda x: x["j"]), ",").alias(name) for name, (cond, made) in MADE.items()]
    whole = F.concat(F.lit("{"), *(F.concat(F.lit(f'{"," if i else ""}"{name}":['), c(name), F.lit("]")) for i, name in enumerate(MADE)), F.lit("}"))
    return turns.groupBy("conv_id").agg(*parts).select(c("conv_id").alias("chat_key"), F.coalesce(F.expr(ODD), whole).alias("response"))


def records(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    found, wrong = P.responses(captured(spark, sf_dir), "chat_key", "response")
    spans, sources = turns.selectExpr(*GIVEN_COLUMNS), turns.selectExpr(*WRITTEN_COLUMNS)
    return P.with_evidence(P.fields(found, "chat_key"), spans, "chat_key"), sources, wrong


GIVEN_COLUMNS = ["conv_id as chat_key", "concat('s', turn) as span_id", "concat('m', turn) as source_ref", GIVEN.rsplit("source_ref, ", 1)[1]]
WRITTEN_COLUMNS = ["conv_id as chat_key", "concat('m', turn) as source_ref", "coalesce(text, '') as content", "(conv_id + turn) % 10 <> 9 as writable"]
_LISTS = ", ".join(f"coalesce(string_agg({made}, ',' order by turn) filter ({cond}), '') as {name}" for name, (cond, made) in MADE.items())
_WHOLE = "concat('{', " + ", ".join(f"'{',' if i else ''}\"{name}\":[', {name}, ']'" for i, name in enumerate(MADE)) + ", '}')"
_GET = "json_extract_string(r, '$.{}')"
RECORDS = f"""j as (select conv_id as chat_key, coalesce({ODD}, {_WHOLE}) as response from (select conv_id, {_LISTS} from conversations group by conv_id)),
w as (select chat_key, case when not json_valid(response) or json_type(response) <> 'OBJECT' then 'type' when {' or '.join(f"coalesce(json_type(response, '$.{n}'), '') <> 'ARRAY'" for n in MADE)} then 'required' end as keyword, response from j),
x as materialized ({' union all '.join(f"select chat_key, '{P.COLLECTIONS[n]}' as type, {i} as rank, unnest(range(json_array_length(response, '$.{n}')::bigint)) as place, unnest(json_extract(response, '$.{n}[*]')) as r from w where keyword is null" for i, n in enumerate(P.COLLECTIONS))}),
f as (select chat_key, type, rank, place, {_GET.format('localId')} as local_id, coalesce({_GET.format('displayName')}, '') as name, case when type = 'episode' then json_extract_string(r, '$.evidenceSpanIds[*]') else [{_GET.format('evidenceSpanId')}] end as spans,
 json_extract_string(r, '$.aliases[*]') as aliases, {_GET.format('confidence')}::double as confidence, {_GET.format('kind')} as kind, {_GET.format('predicateKey')} as predicate_key, case when type = 'episode' then {_GET.format('summary')} else {_GET.format('content')} end as content,
 case when type = 'episode' then list_distinct(json_extract_string(r, '$.participantRefs[*]') || json_extract_string(r, '$.presentRefs[*]')) else list_filter([{_GET.format('subjectRef')}, {_GET.format('objectRef')}, case when type = 'inventory' then {_GET.format('itemRef')} end], lambda v: v is not null and v <> '') end as refs,
 case when type = 'inventory' and {_GET.format('operation')} <> 'remove' and {_GET.format('precision')} <> 'unknown' then {_GET.format('amount')}::double end as amount, nullif({_GET.format('episodeLocalId')}, '') as episode_ref from x),
given as materialized (select {GIVEN} from conversations), source as materialized (select {WRITTEN} from conversations),
sp as (select chat_key, type, place, unnest(spans) as span_id, generate_subscripts(spans, 1) as n from f),
m as (select sp.chat_key, sp.type, sp.place, count(*) filter (g.span_id is null) as unknown, coalesce(list(g.source_ref order by n) filter (g.span_id is not null), []) as refs_, coalesce(list(g.text order by n) filter (g.span_id is not null), []) as excerpts,
 count(*) filter (s.source_ref is null and g.span_id is not null) as lost, bool_or(coalesce(writable, false)) as writable, bool_and(coalesce(contains(s.content, g.text), true)) as verbatim, coalesce(string_agg(s.content, chr(10)), '') as held
 from sp left join given g on g.chat_key = sp.chat_key and g.span_id = sp.span_id left join source s on s.chat_key = sp.chat_key and s.source_ref = g.source_ref group by all),
e as materialized (select f.*, coalesce(unknown, 0) as unknown, coalesce(refs_, []) as source_list, coalesce(excerpts, []) as excerpts, lost, writable, verbatim, held from f left join m using (chat_key, type, place))"""


@query(f"with {RECORDS} select chat_key, type, place::bigint as place, local_id, unknown, array_to_string(list_sort(list_distinct(source_list)), ',') as sources, len(excerpts)::bigint as excerpts, amount from e")
def capture_records(spark, sf_dir):
    """Records of all six collections with the sources of their evidence; `unknown` counts spans that no source has."""
    rows, _, _ = records(spark, sf_dir)
    return rows.select("chat_key", "type", long(c("place")).alias("place"), "local_id", "unknown", F.array_join(F.array_sort("sources"), ",").alias("sources"), long(F.size("excerpts")).alias("excerpts"), "amount")


@query(f"with {RECORDS} select chat_key, '$' as path, keyword from w where keyword is not null union all select chat_key, concat('$.', case type {' '.join(f'''when '{t}' then '{n}' ''' for n, t in P.COLLECTIONS.items())} end, '[', place, '].evidenceSpanId'), 'enum' from e where unknown > 0")
def capture_rejections(spark, sf_dir):
    """Responses that are no response, and records whose evidence lies outside the closed set."""
    rows, _, wrong = records(spark, sf_dir)
    name = F.element_at(F.create_map(*(F.lit(x) for n, t in P.COLLECTIONS.items() for x in (t, n))), c("type"))
    lost = rows.where("unknown > 0").select("chat_key", F.concat(F.lit("$."), name, F.lit("["), c("place"), F.lit("].evidenceSpanId")).alias("path"), F.lit("enum").alias("keyword"))
    return wrong.unionByName(lost)


ENTITIES = "type in ('actor', 'location', 'item')"


VERDICTS = f"""{RECORDS}, b as (select *, case when {ENTITIES} then 'entity' else type end as space, coalesce(local_id, '') = '' or ({ENTITIES} and trim(name) = '') as blank from e),
c as (select *, case when unknown > 0 then 'schema_validation_failed' when blank then 'invalid_shape' when len(source_list) = 0 or lost > 0 or not coalesce(writable, false) then 'invalid_reference' when type = 'episode' and length(coalesce(content, '')) < 6 then 'invalid_shape'
 when type <> 'episode' and not verbatim then 'excerpt_mismatch' when type = 'item' and not contains(excerpts[1], name) then 'excerpt_mismatch' when type = 'claim' and kind not in ({', '.join(f"'{k}'" for k in KINDS)}) then 'invalid_enum'
 when type <> 'episode' and not coalesce(confidence between 0 and 1, false) then 'invalid_confidence' when type = 'claim' and (length(content) not between 6 and 280 or trim(predicate_key) = '') then 'invalid_shape' end as base from b),
d as materialized (select *, case when not blank and unknown = 0 and exists (select 1 from c o where o.chat_key = c.chat_key and o.space = c.space and o.local_id = c.local_id and o.base is null and (o.rank, o.place) < (c.rank, c.place)) then 'duplicate_proposal' else base end as base2 from c),
r as (select chat_key, type, place, held, unnest(refs) as ref from d where base2 is null and space <> 'entity'),
k as (select r.chat_key, r.type, r.place, bool_or(t.local_id is null) as absent, bool_or(t.local_id is not null and not ((t.name <> '' and contains(r.held, t.name)) or len(list_filter(t.aliases, lambda a: a <> '' and contains(r.held, a))) > 0)) as unsaid
 from r left join (select * from d where space = 'entity' and base2 is null) t on t.chat_key = r.chat_key and t.local_id = r.ref where ref not in ('world', 'narrator', 'player') group by all),
v as materialized (select d.*, coalesce(base2, case when absent then 'invalid_reference' when unsaid then 'entity_ref_unsupported' end, 'accepted') as verdict from d left join k using (chat_key, type, place)),
claimed as (select v.*, ep.place as episode, ep.refs as episode_refs, concat('fact:', md5(concat_ws('|', v.chat_key::varchar, v.place::varchar, v.kind, v.predicate_key, v.content, v.source_list[1]))) as fact_id from v
 left join (select chat_key, local_id, place, refs from v where type = 'episode' and verdict = 'accepted') ep on ep.chat_key = v.chat_key and ep.local_id = v.episode_ref where type = 'claim' and verdict = 'accepted')"""


@query(f"with {VERDICTS} select chat_key, type, place::bigint as place, verdict from v")
def capture_verdicts(spark, sf_dir):
    """Every record of all six collections: accepted, or the first rule that rejects it."""
    rows, sources, _ = records(spark, sf_dir)
    return P.validated(rows, sources, "chat_key").select("chat_key", "type", long(c("place")).alias("place"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))


@query(f"with {VERDICTS} select chat_key, fact_id, kind, content, source_list[1] as source_ref, excerpts[1] as excerpt, confidence, episode::bigint as episode from claimed")
def captured_facts(spark, sf_dir):
    """Facts of accepted claims, with their evidence and episode."""
    rows, sources, _ = records(spark, sf_dir)
    return P.materialized(P.validated(rows, sources, "chat_key"), "chat_key")[0].drop("predicate_key")


@query(f"""with {VERDICTS}, o as (select distinct chat_key, fact_id, unnest(refs || coalesce(episode_refs, [])) as owner_ref from claimed)
select o.* from o where owner_ref in ('world', 'narrator', 'player') or exists (select 1 from v where v.chat_key = o.chat_key and type = 'actor' and verdict = 'accepted' and local_id = owner_ref)""")
def captured_observations(spark, sf_dir):
    """Who observed captured facts."""
    rows, sources, _ = records(spark, sf_dir)
    return P.materialized(P.validated(rows, sources, "chat_key"), "chat_key")[1]
