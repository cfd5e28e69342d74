"""Queries over variable states: patches as operations, states after all patches, leaves at any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger import ship
from hearthledger.operators import states as S
from hearthledger.plans.catalogue import c, long, query, read
from hearthledger.sources.adapters import pick

# Messages with patches, from events: nested paths that meet again, values of all kinds, and texts that are no patch.
PATH = "concat('/', {p}, case when event_id % 3 = 0 then '' else concat('/', cast(floor(event_id / 3) as bigint) % 4) end, case when event_id % 6 = 1 then '/x~1y' else '' end)".format(p=pick("(event_id * 7 % 5)", ["hp", "bag", "place", "mood", "hp"]))
VALUE = """case event_id % 4 when 0 then concat('', event_id) when 1 then concat('"', event_type, '"') when 2 then concat('{"a":{"b":', event_id, ',"c":[', event_id % 9, ',true]},"props":', props, '}') else '[]' end"""
MESSAGE = "case when event_id % 23 = 5 then concat('broken ', event_type) else concat('[{{\"op\":\"', {op}, '\",\"path\":\"', {path}, '\",\"value\":', {value}, '}},{{\"op\":\"', {second}, '\",\"path\":\"/bag/', event_id % 4, '/a\"}}]') end".format(
    op=pick("(event_id * 3 % 7)", ["add", "replace", "remove", "Add", "replace", "move", "add"]), path=PATH, value=VALUE, second="case when event_id % 5 = 0 then 'remove' else 'test' end"
)


def messages(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("user_id as chat_key", "event_id", f"{MESSAGE} as content")


OPS = f"""m as (select user_id as chat_key, event_id, {MESSAGE} as content from events),
p as (select chat_key, event_id, unnest(from_json(content, '[{{"op":"VARCHAR","path":"VARCHAR","value":"JSON"}}]')) as o, unnest(range(json_array_length(content)::bigint)) as place from m where json_valid(content)),
o as (select chat_key, event_id, place, lower(o.op) as op, list_transform(list_filter(string_split(o.path, '/'), lambda x: x <> ''), lambda x: replace(replace(x, '~1', '/'), '~0', '~')) as path, o.value as value from p
 where lower(o.op) in ('add', 'replace', 'remove') and starts_with(o.path, '/'))"""


@query(f"with {OPS} select chat_key, event_id, place::bigint as place, op, array_to_string(path, ' / ') as path, case when op <> 'remove' then value end::varchar as value from o")
def patch_operations(spark, sf_dir):
    """Operations of all patches of a chat, one a row."""
    o = S.operations(messages(spark, sf_dir), "chat_key", ["event_id"], "content")
    return o.select("chat_key", "event_id", long(c("place")).alias("place"), "op", F.array_join("path", " / ").alias("path"), F.when(c("op") != "remove", c("value")).alias("value"))


LEAF = "list_filter(string_split_regex(t.fullkey, '[.\\[\\]]'), lambda x: x not in ('', '$'))"


@query(f"""with {OPS}, n as (select *, row_number() over (order by event_id, place) as at from o),
l as (select n.chat_key, n.at, n.path || {LEAF} as path, case when t.type = 'VARCHAR' then json_extract_string(t.value, '$') else t.value::varchar end as value from n, json_tree(n.value) t
 where n.op <> 'remove' and (t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')))
select chat_key, array_to_string(path, ' / ') as path, value from l where not exists (select 1 from n where n.chat_key = l.chat_key and n.at > l.at and n.path = l.path[1:len(n.path)])
 and not exists (select 1 from n where n.chat_key = l.chat_key and n.at > l.at and n.op <> 'remove' and len(n.path) > len(l.path) and n.path[1:len(l.path)] = l.path)""")
def folded_states(spark, sf_dir):
    """The state of each chat after all its patches."""
    ship(spark)
    o = S.operations(messages(spark, sf_dir), "chat_key", ["event_id"], "content")
    return S.folded(o, "chat_key", ["event_id"]).select("chat_key", F.array_join("path", " / ").alias("path"), "value")


NESTED = "concat('{\"props\":', props, ',\"seen\":[', event_id % 9, ',{\"by\":\"', event_type, '\"}],\"none\":', case when event_id % 4 = 0 then '{}' else 'null' end, '}')"


@query(f"""select event_id as id, array_to_string({LEAF}, ' / ') as path, case when t.type = 'VARCHAR' then json_extract_string(t.value, '$') else t.value::varchar end as value
from (select event_id, {NESTED} as s from events) e, json_tree(e.s) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')""")
def state_leaves(spark, sf_dir):
    """Leaves of JSON states, at any depth, as rows of path and value."""
    ship(spark)
    e = read(spark, sf_dir, "events").select(c("event_id").alias("id"), F.explode(S.leaves(F.expr(NESTED))).alias("leaf"))
    return e.select("id", F.array_join("leaf.path", " / ").alias("path"), "leaf.value")


@query(f"""with e as (select user_id as chat_key, event_id, case when event_id % 3 = 0 then '' when event_id % 7 = 1 then 'not json' else {NESTED} end as s from events),
l as (select chat_key, arg_max(s, event_id) as s, max(event_id) as event_id from e where json_valid(s) and s <> '' group by chat_key)
select chat_key, event_id, array_to_string({LEAF}, ' / ') as path, case when t.type = 'VARCHAR' then json_extract_string(t.value, '$') else t.value::varchar end as state from l, json_tree(l.s) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('{{}}', '[]')""")
def latest_variable_state(spark, sf_dir):
    """The state of each chat's last message that holds one: later messages whose state is empty or broken are passed over."""
    ship(spark)
    s = F.expr(f"case when event_id % 3 = 0 then '' when event_id % 7 = 1 then 'not json' else {NESTED} end")
    e = read(spark, sf_dir, "events").select(c("user_id").alias("chat_key"), "event_id", s.alias("s")).where(F.try_parse_json("s").isNotNull())
    last = e.groupBy("chat_key").agg(F.max_by("s", "event_id").alias("s"), F.max("event_id").alias("event_id"))
    return last.select("chat_key", "event_id", F.explode(S.leaves(c("s"))).alias("leaf")).select("chat_key", "event_id", F.array_join("leaf.path", " / ").alias("path"), c("leaf.value").alias("state"))


ORDERED = "case when event_id % 31 = 7 then 'none' when event_id % 2 = 0 then concat('{\"a\":', cast(floor(event_id / 40) as bigint) % 3, ', \"b\":{\"x\":[1,2],\"y\":', user_id % 2, '}}') else concat('{\"b\": {\"y\":', user_id % 2, ',\"x\":[1, 2]},\"a\":', cast(floor(event_id / 40) as bigint) % 3, '}') end"


@query(f"""with e as (select user_id as chat_key, event_id, {ORDERED} as s from events), f as (select chat_key, event_id, case when json_valid(s) then concat(json_extract(s, '$.a'), '|', json_extract(s, '$.b.x[0]'), '|', json_extract(s, '$.b.x[1]'), '|', json_extract(s, '$.b.y')) else '-' end as form from e),
g as (select *, coalesce(form = lag(form) over (partition by chat_key order by event_id), false) as same from f) select chat_key, event_id, same, (sum((not same)::int) over (partition by chat_key order by event_id))::bigint as revision from g""")
def state_revisions(spark, sf_dir):
    """Which states of a chat say something new, whatever the order of their keys."""
    e = read(spark, sf_dir, "events").selectExpr("user_id as chat_key", "event_id", f"{ORDERED} as s")
    return S.revisions(e, "chat_key", "event_id", "s")
