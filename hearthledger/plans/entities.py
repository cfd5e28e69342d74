"""Queries over names, ids, quantities, titles and shortened memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.functions import memory as M
from hearthledger.operators import entities as E
from hearthledger.operators.retrieval import spread
from hearthledger.plans.catalogue import EFFECTIVE, c, query, r6, read, strength
from hearthledger.sources.adapters import FACTS, pick, view, view_sql

URI = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def fnv_sql(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({text}, ''), lambda x: unicode(x)::bigint)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)"


def uuid_sql(text: str, source: str, keep: str) -> str:
    """Rows of `source` with `uuid` over the four lanes of `text`; NUL is chr(0)."""
    lanes = ", ".join(f"printf('%08x', {fnv_sql(f'{text} || chr(0) || {v}')})" for v in range(4))
    return f"u as (select {keep}, concat({lanes}) as h from {source}), w as (select *, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', printf('%04x', ((('0x' || h[17:20])::bigint & 16383) | 32768)), '-', h[21:32]) as uuid from u)"


@query(f"{FACTS} select id, concat('graph-node:', {URI.format('chat_key')}, ':', {URI.format(FLAT.format('subject_key'))}) as node_id, concat('graph-edge:', id) as edge_id from (select id, chat_key || ' (x)' as chat_key, concat('  ', subject_key, '  é~!*', id % 3, ' ') as subject_key from facts where chat_key is not null)")
def graph_ids(spark, sf_dir):
    f = view(spark, sf_dir, "facts").where("chat_key is not null").selectExpr("id", "chat_key || ' (x)' as chat_key", "concat('  ', subject_key, '  é~!*', id % 3, ' ') as subject_key")
    return f.select("id", E.graph_node_id(c("chat_key"), c("subject_key")).alias("node_id"), F.concat(F.lit("graph-edge:"), c("id")).alias("edge_id"))


@query(f"with {uuid_sql('''('ws' || chr(0) || lower(trim(c_name)))''', 'customer', 'c_custkey')} select c_custkey, concat('owner:actor:', uuid) as owner_id from w")
def actor_owner_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", E.actor_owner_id("ws", c("c_name")).alias("owner_id"))


PLACE = f"('ws' || chr(0) || 'location' || chr(0) || lower({FLAT.format('n_name')}))"


@query(f"with {uuid_sql(PLACE, 'nation', 'n_nationkey')} select n_nationkey, concat('location:', uuid) as location_id from w")
def location_entity_ids(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", E.location_id("ws", c("n_name")).alias("location_id"))


@query(f"{FACTS} select id, concat('evidence:', id, ':', lower(to_base({fnv_sql('''chat_key || chr(10) || content''')}::bigint, 36))) as evidence_id from facts where content is not null and content <> '' and chat_key is not null")
def evidence_ids(spark, sf_dir):
    f = view(spark, sf_dir, "facts").where("content is not null and content <> '' and chat_key is not null")
    return f.select("id", E.evidence_id(c("id"), c("chat_key"), c("content")).alias("evidence_id"))


WRITTEN = ["水 约29天份", "绷带（22个）", "罐头 x15", "电池×10包", "大米 2公斤", "旧弓（已丢弃）", "种子（已播种，约120株）", "药水 400毫升", "子弹若干", "绳子", "核心 3.5 kg", "水（可维持3天）", "Rope X2", "盐 近 5 千克（剩余）"]
# Half of the items as above, half by the part's own name and size.
MADE = "concat(p_name, case p_partkey % 5 when 0 then concat(' x', p_size) when 1 then concat('（', p_size, '个）') when 2 then concat('×', p_size, '包') when 3 then concat(' ', p_size, ' kg') else '若干' end)"
SAID = f"case when p_partkey % 2 = 0 then {pick('cast(floor(p_partkey / 2) as bigint)', WRITTEN)} else {MADE} end"
STOCK = f"stock as (select p_partkey as id, {SAID} as said from part)"


def stock(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{SAID} as said")


def _name_sql() -> str:
    out = "said"
    for end in E.ENDINGS:
        out = f"regexp_replace({out}, '{end}', '', 'i')"
    return f"lower({FLAT.format(out)})"


SHORT_SQL = "case u " + " ".join(f"when '{k}' then '{v}'" for k, v in E.SHORT.items()) + " else u end"


@query(f"""with {STOCK}, a as (select *, case when regexp_matches(regexp_extract(said, '^[^（(]*'), '\\d') then regexp_extract(said, '^[^（(]*') else said end as s from stock),
b as (select *, regexp_extract(s, '{E.MEASURE}', 2, 'i') <> '' as measured from a),
d as (select *, case when measured then regexp_extract(s, '{E.MEASURE}', 2, 'i') else regexp_extract(s, '{E.TIMES}', 2, 'i') end as x, case when measured then regexp_extract(s, '{E.MEASURE}', 1, 'i') else regexp_extract(s, '{E.TIMES}', 1, 'i') end as raw,
 lower(case when measured then regexp_extract(s, '{E.MEASURE}', 3, 'i') else '个' end) as u from b),
e as (select *, not regexp_matches(said, '{E.SOME}') and x <> '' as known from d), g as (select *, case when known then {SHORT_SQL} else '' end as unit from e)
select id, {_name_sql()} as name, case when known then x::double end as amount, unit, case when not known then 'unknown' when regexp_matches(raw, '{E.ABOUT}') then 'approximate' else 'exact' end as precision,
case when known and (regexp_matches(said, '{E.LASTS}') or unit = '天份') then 'coverage_days' else 'quantity' end as measure, case when regexp_matches(said, '{E.GONE}') then 'remove' else 'set' end as operation from g""")
def inventory_quantities(spark, sf_dir):
    """Names, amounts and units of items as a snapshot writes them."""
    s = stock(spark, sf_dir)
    return s.select("id", E.item_name(c("said")).alias("name"), *(v.alias(k) for k, v in E.quantity(c("said")).items()))


SNAPSHOT = "【当前物资快照】\\n食物：大米 2公斤、罐头 x15\\n药品: 绷带（22个），药水 400毫升\\n备注：无\\n【其他】\\n武器：弓 1把"
LABELS = {"武器": "weapon", "药品": "medicine", "食物": "food", "防具": "armor", "特殊道具": "special", "材料": "material"}  # fixed values


def _snapshot_sql() -> str:
    text = "'" + SNAPSHOT.replace("\\n", "' || chr(10) || '") + "'"
    label = "case k " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " end"
    return f"""with s as (select p_partkey as id, string_split({text} || chr(10) || '材料：' || p_name || ' ' || p_size || '块', chr(10)) as ls from part),
l as (select id, unnest(ls) as line, generate_subscripts(ls, 1) as n, list_position(ls, '【当前物资快照】') as head from s),
e as (select *, min(case when n > head and regexp_matches(line, '^【.+】$') then n end) over (partition by id) as stop from l),
r as (select id, n, trim(regexp_extract(line, '^([^：:]{{1,20}})[：:]\\s*(.+)$', 1)) as k, regexp_extract(line, '^([^：:]{{1,20}})[：:]\\s*(.+)$', 2) as rest from e where n > head and (stop is null or n < stop)),
i as (select id, {label} as category, unnest(string_split_regex(rest, '[、，,；;]')) as item from r) select id, category, trim(item) as item from i where category is not null and trim(item) <> ''"""


@query(_snapshot_sql())
def inventory_snapshots(spark, sf_dir):
    """Items of the inventory section of a source, up to the next section, by category."""
    text = SNAPSHOT.replace("\\n", "\n")
    s = read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.concat(F.lit(text + "\n材料："), "p_name", F.lit(" "), "p_size", F.lit("块")).alias("content"))
    # The section: what lies between its head and the next line that is all in brackets.
    body = F.regexp_extract("content", r"(?s)【当前物资快照】\n(.*?)(?:\n【[^\n]+】(?:\n|$)|$)", 1)
    line = s.select("id", F.explode(F.split(body, "\n")).alias("line")).select("id", F.trim(F.regexp_extract("line", r"^([^：:]{1,20})[：:]\s*(.+)$", 1)).alias("k"), F.regexp_extract("line", r"^([^：:]{1,20})[：:]\s*(.+)$", 2).alias("rest"))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), c("k"))
    return line.select("id", kind.alias("category"), F.explode(F.split("rest", "[、，,；;]")).alias("item")).where("category is not null and trim(item) <> ''").select("id", "category", F.trim("item").alias("item"))


EXCERPTS = ["他获得了水", "消耗两瓶", "丢弃旧弓", "什么也没有"]
SUPPORT = f"select p_partkey as id, {pick('p_partkey', ['increase', 'decrease', 'remove', 'set', 'increase'])} as operation, concat(p_name, '：', {pick('p_partkey', EXCERPTS)}) as excerpt from part"


@query(f"with s as ({SUPPORT}) select id, operation, case operation " + " ".join(f"when '{k}' then regexp_matches(excerpt, '{v}')" for k, v in E.DIRECTIONS.items()) + " else true end as supported from s")
def inventory_operation_support(spark, sf_dir):
    s = read(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{pick('p_partkey', ['increase', 'decrease', 'remove', 'set', 'increase'])} as operation", f"concat(p_name, '：', {pick('p_partkey', EXCERPTS)}) as excerpt")
    return s.select("id", "operation", E.operation_supported(c("operation"), c("excerpt")).alias("supported"))


GIST_SQL = "case when w = '' then '一段相关记忆' else concat(s[1:case when length(s) <= 3 then greatest(1, length(s) - 1) when length(s) > most then greatest(2, most - 1) else greatest(2, length(s) - 1) end], '…') end"


@query(f"""{FACTS}, a as (select id, content, subject_key, predicate_key, cast(id * 7 % 101 as double) as strength, {FLAT.format('content')} as w from facts where content is not null),
b as (select *, trim(string_split_regex(w, '[。！？!?；;]')[1]) as f from a), d as (select *, case when f = '' then w else f end as s from b),
e as (select *, least(72, greatest(3, ceil(length(s) * 0.72)::bigint)) as most from d)
select id, case when strength <= 0 then null when strength >= 85 then md5(content) when strength >= 45 then {GIST_SQL} when strength >= 25 then concat('隐约记得「', subject_key, '」与「', predicate_key, '」有关，细节不清。') else concat('对「', subject_key, '」有一段模糊印象。') end as packet from e""")
def recall_packets(spark, sf_dir):
    """What is left of each fact at its strength; whole texts as digests."""
    f = spread(view(spark, sf_dir, "facts").where("content is not null")).withColumn("strength", F.expr("cast(id * 7 % 101 as double)"))
    return f.select("id", E.packet(c("content"), c("subject_key"), c("predicate_key"), c("strength")).alias("p"), "strength", "content").select("id", F.when(c("strength") >= 85, F.md5("content")).otherwise(c("p")).alias("packet"))


@query(f"{view_sql('traces')} select id, printf('%08x', {fnv_sql('''owner_id || chr(0) || fact_id || chr(0) || rehearsals || chr(0) || 'default' ''')}) as seed from traces")
def recall_seeds(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    return t.select("id", F.lower(F.lpad(F.hex(M.fnv1a(F.concat_ws("\0", c("owner_id"), c("fact_id").cast("string"), c("rehearsals").cast("string"), F.lit("default")))), 8, "0")).alias("seed"))


@query(f"""{view_sql('scenes')}, e as (select id, case when id % 11 = 0 then null else start_floor end as a, end_floor as b, case when id % 5 = 0 then '' when id % 5 = 1 then '他们抵达了旧城，然后休息' when id % 5 = 2 then '短，长长长长长长长长长长长长长长长长长长长长长长长长长长长长长' else concat('event ', id) end as summary from scenes),
r as (select *, case when coalesce(a, b) is null then '楼层未知' when a is null or b is null or a = b then concat('第 ', coalesce(a, b), ' 层') else concat('第 ', a, '–', b, ' 层') end as range, length(regexp_extract(summary, '^[^，。；]*')) as mark from e)
select id, range, case when summary = '' then concat(range, '事件') when mark < length(summary) and mark > 5 then concat(summary[1:mark], '…') when length(summary) > 26 then concat(summary[1:26], '…') else summary end as title from r""")
def event_titles(spark, sf_dir):
    e = view(spark, sf_dir, "scenes").selectExpr("id", "case when id % 11 = 0 then null else start_floor end as a", "end_floor as b", "case when id % 5 = 0 then '' when id % 5 = 1 then '他们抵达了旧城，然后休息' when id % 5 = 2 then '短，长长长长长长长长长长长长长长长长长长长长长长长长长长长长长' else concat('event ', id) end as summary")
    return e.select("id", E.floor_range(c("a"), c("b")).alias("range"), E.event_title(c("summary"), c("a"), c("b")).alias("title"))


@query(f"{FACTS} select id, md5(concat_ws(chr(10), '类型：' || kind, '主体：' || subject_key, '谓词：' || predicate_key, '对象：' || object_key, '事实：' || content)) as digest from facts")
def embedding_texts(spark, sf_dir):
    """Digest of the text that stands for a fact when it is embedded."""
    return view(spark, sf_dir, "facts").select("id", F.md5(E.embedding_text(*(c(n) for n in ("kind", "subject_key", "predicate_key", "object_key", "content")))).alias("digest"))


@query(f"""{view_sql('traces')}, t as (select *, {pick('scene_id', ['message', 'worldbook', 'state', 'message', 'host_card'])} as source from traces) select id, case when source in ('worldbook', 'host_card') then 'worldbook' when source = 'state' then 'state'
when privacy in ('private', 'secret') and id % 2 = 0 then 'private_thought' when knowledge_mode in ('self_reported', 'heard') then 'public_speech' when knowledge_mode in ('believed', 'suspected') then 'rumor' when knowledge_mode = 'inferred' then 'inference'
when knowledge_mode = 'experienced' and id % 3 <> 0 then 'state' else 'narration' end as channel from t""")
def observation_channels(spark, sf_dir):
    t = view(spark, sf_dir, "traces").withColumn("source", F.expr(pick("scene_id", ["message", "worldbook", "state", "message", "host_card"])))
    return t.select("id", E.channel(c("source"), c("knowledge_mode"), c("privacy"), c("id") % 2 == 0, c("id") % 3 != 0).alias("channel"))


@query(f"{view_sql('repairs')} select id, case when id % 17 = 0 then 'duplicate_noop' when status = 'quarantined' and id % 3 <> 0 then 'unsupported_evidence' when source_ref in ('message:floor-0', 'message:floor-7') then 'unsupported_evidence' else 'ai_required' end as classification from repairs")
def repair_classification(spark, sf_dir):
    """Repeats first, then what no source can support, else what a model must mend; known sources are joined."""
    r = view(spark, sf_dir, "repairs")
    known = r.select("source_ref").distinct().where("source_ref not in ('message:floor-0', 'message:floor-7')").withColumn("known", F.lit(True))
    r = r.join(known, "source_ref", "left")
    out = F.when(c("id") % 17 == 0, "duplicate_noop").when((c("status") == "quarantined") & (c("id") % 3 != 0), "unsupported_evidence").when(c("known").isNull(), "unsupported_evidence").otherwise("ai_required")
    return r.select("id", out.alias("classification"))


@query(f"{FACTS}, n as (select chat_key, max(updated_at) as newest from facts group by chat_key) select id, valid_from is not null and valid_from < newest as past, coalesce(valid_from, updated_at) as observed_at from facts left join n on n.chat_key is not distinct from facts.chat_key")
def temporal_past_events(spark, sf_dir):
    """Whether a fact holds from before its chat's newest moment."""
    f = view(spark, sf_dir, "facts")
    n = f.groupBy(c("chat_key").alias("chat")).agg(F.max("updated_at").alias("newest"))
    j = f.join(n, f["chat_key"].eqNullSafe(n["chat"]))
    return j.select("id", (c("valid_from").isNotNull() & F.coalesce(c("valid_from") < c("newest"), F.lit(False))).alias("past"), F.coalesce("valid_from", "updated_at").alias("observed_at"))


@query(f"""{view_sql('traces')} select id, case when belief >= 0.85 or id % 7 = 0 then rehearsals + 1 else rehearsals end as rehearsals, case when belief >= 0.85 or id % 7 = 0 then least(100.0, strength + 2) else strength end as strength, round({EFFECTIVE}, 6) as before
from traces""")
def exposure_updates(spark, sf_dir):
    """Traces that were used: rehearsed where belief is high or the recall was explicit."""
    t = view(spark, sf_dir, "traces")
    ok = (c("belief") >= 0.85) | (c("id") % 7 == 0)
    return t.select("id", F.when(ok, c("rehearsals") + 1).otherwise(c("rehearsals")).alias("rehearsals"), F.when(ok, F.least(F.lit(100.0), c("strength") + 2)).otherwise(c("strength")).alias("strength"), r6(strength()).alias("before"))
