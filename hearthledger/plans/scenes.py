"""Queries over scenes as texts tell them: moves, casts, named items and citable spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger import ship
from hearthledger.operators import scenes as S
from hearthledger.plans.catalogue import c, query, read
from hearthledger.sources.adapters import pick

LINES = "艾琳走进房间里，林川站在她身旁。|林川说：我们一起来到旧港口里。|第二天，众人一起抵达北方哨站。|艾琳心想：林川不在这里。|夏洛特离开了，小夏仍在附近。|旁白：镜头转到 钟楼内。|与此同时，艾琳消失！阿川返回？|叶说道：夏洛特未到。叶片落下。|「阿川」低声 心里想着对面的艾琳。||艾琳出现在大厅，所有人离场\n另一边，叶 跟着小夏".split("|")
NAMES = [("actor:a", "艾琳", 1.0), ("actor:l", "林川", 1.0), ("actor:l", "阿川", 0.9), ("actor:x", "夏洛特", 1.0), ("actor:x", "小夏", 0.8), ("actor:y", "叶", 0.6)]
STORY = {
    "id": "conv_id * 1000 + turn",
    "chat_key": "conv_id",
    "floor": "turn",
    "kind": "case when (conv_id + turn) % 9 = 4 then 'worldbook' else 'message' end",
    "role": "role",
    "author": "case conv_id % 3 when 0 then '林川' when 1 then ' 路人甲 ' end",
    "content": f"concat({pick('(conv_id * 5 + turn)', LINES)}, coalesce(text, ''))",
}
STORIES = f"""story as (select {', '.join(f'{e} as {n}' for n, e in STORY.items())} from conversations),
names as (select chat_key, owner_id, name, confidence from (select distinct conv_id as chat_key from conversations), (values {', '.join(f"('{o}', '{n}', {x}::double)" for o, n, x in NAMES)}) v(owner_id, name, confidence))"""


def story(spark, sf_dir):
    return read(spark, sf_dir, "conversations").selectExpr(*(f"{e} as {n}" for n, e in STORY.items()))


def names(spark, sf_dir):
    """The registry of each chat."""
    each = F.array(*(F.struct(F.lit(o).alias("owner_id"), F.lit(n).alias("name"), F.lit(x).alias("confidence")) for o, n, x in NAMES))
    return read(spark, sf_dir, "conversations").select(c("conv_id").alias("chat_key")).distinct().select("chat_key", F.inline(each))


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PLACE = "case " + " ".join(f"when regexp_matches(sentence, '{p}') then regexp_extract(sentence, '{p}', 1)" for p in S.PLACES) + " end"


TOLD = rf"""raw as (select id, chat_key, unnest(regexp_split_to_array(content, '{S.SENTENCE_END}')) as sentence from story),
s as (select id, chat_key, {TRIM.format('sentence')} as sentence from raw where {TRIM.format('sentence')} <> ''),
p as (select id, chat_key, regexp_replace({TRIM.format(PLACE)}, '(?:里|内|中)$', '') as place from s),
e as (select id, chat_key, 'place' as kind, place as value from p where place <> '' union select id, chat_key, 'time_jump', '' from s where regexp_matches(sentence, '{S.TIME_JUMP}')
 union select id, chat_key, 'reset', '' from s where regexp_matches(sentence, '{S.RESET}')
 union select id, chat_key, case when regexp_matches(sentence, '{S.EXIT}') then 'exited' else 'entered' end, owner_id from s join names using (chat_key) where regexp_matches(sentence, '{S.ENTRY}|{S.EXIT}') and contains(sentence, name))"""


@query(f"with {STORIES}, {TOLD} select chat_key, kind, value, count(distinct id) as sources, min(id) as first_source from e group by all")
def scene_transitions(spark, sf_dir):
    return S.transitions(story(spark, sf_dir), names(spark, sf_dir))


@query(f"""with {STORIES}, {TOLD}, m as (select distinct e.chat_key, floor, e.kind, value from e join story using (id)),
f as (select chat_key, floor, coalesce(array_to_string(list_sort(list(value) filter (kind = 'place')), '|'), '') as here, bool_or(kind = 'time_jump') as jump, bool_or(kind = 'reset') as reset from m group by all),
g as (select *, last_value(nullif(here, '') ignore nulls) over w as places, row_number() over w = 1 as first from f window w as (partition by chat_key order by floor)),
h as (select *, lag(places) over (partition by chat_key order by floor) as before from g), i as (select *, not first and here <> '' and here <> coalesce(before, '') as moved from h), j as (select *, moved or jump or reset as new from i),
o as (select chat_key, floor, value as owner_id, bool_or(kind = 'entered') as enters, bool_or(kind = 'exited') as exits from m where kind in ('entered', 'exited') group by all),
q as (select *, case when enters and exits then '' when enters then 'in' else 'out' end as state from o), r as (select *, coalesce(lag(state) over (partition by chat_key, owner_id order by floor), '') as was from q),
t as (select chat_key, floor, sum((state = 'in')::int - (was = 'in')::int) as more, sum((state = 'out')::int - (was = 'out')::int) as gone, bool_or(exits) as "exit", bool_or(enters and was <> 'in') as enter from r group by all)
select j.chat_key, j.floor, (sum(new::int) over w)::bigint as epoch, max(case when new or first then j.floor end) over w as started_at, places, (sum(coalesce(more, 0)) over w)::bigint as present, (sum(coalesce(gone, 0)) over w)::bigint as exited,
 case when reset then 'scene_reset' when jump then 'time_jump' when "exit" then 'explicit_exit' when moved then 'location_change' when enter then 'explicit_entry' end as reason from j left join t using (chat_key, floor) window w as (partition by j.chat_key order by j.floor)""")
def scene_history(spark, sf_dir):
    """The scene of each chat after every floor that tells of it: epoch, places, who is there and who left."""
    s = story(spark, sf_dir)
    return S.history(S.told(s, names(spark, sf_dir)).join(s.select("id", "floor"), "id").select("chat_key", "floor", "kind", "value").distinct())


def _places_sql(cues: str) -> str:
    between, hits = f"regexp_split_to_array(sentence, '{cues}')", f"regexp_extract_all(sentence, '{cues}')"
    return f"list_transform(range(1, len({hits}) + 1), lambda k: length(array_to_string(({between})[1:k], '')) + length(array_to_string(({hits})[1:k - 1], '')))"


def _lone_sql(cond: str, left: str, right: str) -> str:
    return f"when {cond} then regexp_matches(content, '{left}' || name || '{right}')"


HOLDS = f"""case when length(name) > 1 then contains(content, name) {_lone_sql("regexp_matches(name, '^[A-Za-z0-9]$')", '(?:^|[^A-Za-z0-9])', '(?:$|[^A-Za-z0-9])')}
{_lone_sql("regexp_matches(name, '^[一-鿿]$')", f'(?:^|[{S.BESIDE}])', f'(?:$|[{S.BESIDE}]|{S.SPEECH}|{S.AFTER})')} else contains(content, name) end"""


@query(rf"""with {STORIES}, n as (select *, max(floor) over (partition by chat_key) as now from story),
r as (select *, row_number() over (partition by chat_key order by floor desc, id desc) as place from n where floor >= now - 8 qualify place <= 64),
f as (select *, case when kind <> 'message' then null when role = 'user' then '{S.PLAYER}' when regexp_matches(content, '{S.NARRATES}') then '{S.NARRATOR}' end as fixed, coalesce(nullif(regexp_extract(content, '{S.SPEAKER}', 1), ''), nullif({TRIM.format('author')}, '')) as said from r),
k as (select f.*, case when kind = 'message' then coalesce(fixed, n.owner_id, 'name:' || said) end as speaker from f left join names n on n.chat_key = f.chat_key and n.name = f.said),
m as (select k.id, k.chat_key, owner_id, arg_max(name, (length(name), name)) as name, arg_max(confidence, (length(name), name)) as confidence, any_value(content) as content, any_value(speaker) as speaker
 from k join names using (chat_key) where {HOLDS} group by all),
w as (select *, coalesce(speaker = owner_id, false) as me, unnest(regexp_split_to_array(content, '{S.SENTENCE_END}')) as sentence from m),
g as (select *, strpos(sentence, name) - 1 as spot, {_places_sql(S.ABSENCE)} as away, {_places_sql(S.PRESENCE)} as here from w),
b as (select id, chat_key, owner_id, confidence, me, content, bool_or(spot >= 0 and len(list_filter(away, lambda x: abs(x - spot) <= greatest(10, length(name) + 5))) = 0 and len(list_filter(here, lambda x: abs(x - spot) <= greatest(8, length(name) + 4))) > 0) as near from g group by all),
e as (select id, chat_key, speaker as owner_id, 'speaker' as role, 0.96::double as confidence from k where speaker <> '{S.NARRATOR}' union all select id, chat_key, speaker, 'present', 0.96 from k where speaker <> '{S.NARRATOR}'
 union all select id, chat_key, speaker, 'narrator', 0.96 from k where speaker = '{S.NARRATOR}' union all select id, chat_key, '{S.WORLD}', 'world', 1 from k where kind = 'worldbook' union all select id, chat_key, '{S.NARRATOR}', 'narrator', 1 from k where place = 1
 union all select id, chat_key, owner_id, 'mentioned', confidence from b union all select id, chat_key, owner_id, 'present', greatest(0.7, confidence) from b where near or me union all select id, chat_key, owner_id, 'viewpoint', 0.9 from b where me and regexp_matches(content, '{S.THOUGHT}'))
select chat_key, owner_id, role, max(confidence) as confidence, count(distinct id) as sources, min(id) as first_source from e group by all""")
def active_cast(spark, sf_dir):
    return S.active_cast(story(spark, sf_dir), names(spark, sf_dir))


ITEMS = [(1, "钟楼", 0), (2, "旧港口", 1), (2, "港口", 1), (3, "房间", 2), (4, "哨站", 3), (5, "厅", 4), (6, "la", 5), (7, "der", 6), (8, "and", 7)]


@query(f"""with {STORIES}, items as (select chat_key, item_id, name, (chat_key + item_id) % 5 <> 0 as valid, place from (select distinct chat_key from story), (values {', '.join(f"({i}::bigint, '{n}', {p}::bigint)" for i, n, p in ITEMS)}) v(item_id, name, place)),
h as (select id, item_id, min(strpos(content, name))::bigint as position, min(place) as place from story join items using (chat_key) where valid and length(name) >= 2 and contains(content, name) group by all)
select id, item_id, position, row_number() over (partition by id order by position, place, item_id) as rank from h qualify rank <= 50""")
def named_items(spark, sf_dir):
    """Known items in the order in which a source names them."""
    t = story(spark, sf_dir).select("id", "chat_key", c("content").alias("text"))
    each = F.array(*(F.struct(F.lit(i).cast("long").alias("item_id"), F.lit(n).alias("name"), F.lit(p).cast("long").alias("place")) for i, n, p in ITEMS))
    known = t.select("chat_key").distinct().select("chat_key", F.inline(each)).withColumn("valid", (c("chat_key") + c("item_id")) % 5 != 0)
    return S.named_items(t, known)


@query()
def evidence_spans(spark, sf_dir):
    """Citable spans of all facts' texts; tests hold them against a plain loop."""
    ship(spark)
    return S.evidence_spans(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""with {STORIES}, o as (select chat_key, owner_id, arg_min(name, (-confidence, name)) as label from names group by all),
k as (select id, chat_key, owner_id, content, name from story join names using (chat_key)), h as (select chat_key, owner_id, min(id) as first_source from k where {HOLDS} group by all)
select chat_key, owner_id, label, first_source is not null as referenced, first_source, row_number() over (partition by chat_key order by first_source is not null desc, label, owner_id) as rank from o left join h using (chat_key, owner_id)""")
def reference_directory(spark, sf_dir):
    """Owners that a chat's sources may refer to, those whom they name first."""
    return S.directory(story(spark, sf_dir), names(spark, sf_dir))
