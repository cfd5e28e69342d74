"""Queries over registries of names."""

from __future__ import annotations

from hearthledger.operators import registries as R
from hearthledger.plans.catalogue import query, read
from hearthledger.sources.adapters import pick

MOMENTS = [150, 700, 2_000, 5_000, 9_000, 50_000]  # versions at which a registry is asked
EDITS = [
    "user_id % 12 as scope",
    "event_id as version",
    f"{pick('(event_id * 5 % 13)', ['discover', 'merge', 'discover', 'correct', 'undo', 'discover', 'merge', 'confirm', 'discover', 'split', 'undo', 'correct', 'merge'])} as action",
    "concat('a', event_id * 7 % 31) as owner_id",
    "concat(case when event_id % 5 = 0 then ' N' else 'n' end, event_id * 11 % 47)  as alias",
    f"case when {pick('(event_id * 5 % 13)', ['', '', '', '', 'u', '', '', '', '', '', 'u', '', ''])} = 'u' then concat('', event_id - event_id % 12 - 12) when event_id % 17 = 3 then null else concat('a', event_id * 3 % 29) end as target",
]
def replay_sql(table: str, edits: list[str], moments: list[int]) -> str:
    return f"""with recursive ed as (select {', '.join(edits)} from {table}), mo as (select unnest({moments})::bigint as moment),
un as (select scope, target::bigint as version, min(version) as gone from ed where action = 'undo' and target is not null group by all),
li as materialized (select ed.* exclude (alias), nullif(lower(trim(alias)), '') as alias, moment from ed left join un using (scope, version), mo where action <> 'undo' and version <= moment and (gone is null or gone > moment)),
na as (select scope, moment, alias, arg_max(case when action = 'correct' then target else owner_id end, version) as owner_id from li where alias is not null and (action = 'discover' or (action = 'correct' and target is not null)) group by all),
pa as materialized (select scope, moment, owner_id, arg_max(case when action = 'merge' then target else '' end, version) as parent from li where action = 'split' or (action = 'merge' and target is not null and target <> owner_id) group by all),
su as (select distinct scope, moment, owner_id from li where action = 'confirm'),
walk as (select scope, moment, owner_id, [owner_id] as path, owner_id as here, false as circle from na union select w.scope, w.moment, w.owner_id, path || [parent], parent, list_contains(path, parent) from walk w join pa p on p.scope = w.scope and p.moment = w.moment and p.owner_id = w.here where parent <> '' and not circle),
ro as (select scope, moment, owner_id, arg_max(case when circle then list_min(path[list_position(path, here):]) else here end, len(path)) as root from walk group by all)
select na.scope, na.moment, alias, na.owner_id, root, (s1.owner_id is not null or s2.owner_id is not null) as confirmed from na join ro using (scope, moment, owner_id)
 left join su s1 on s1.scope = na.scope and s1.moment = na.moment and s1.owner_id = na.owner_id left join su s2 on s2.scope = na.scope and s2.moment = na.moment and s2.owner_id = root"""


@query(replay_sql("events", EDITS, MOMENTS))
def alias_history(spark, sf_dir):
    """Whose name each alias is at stated moments of a log of edits: names found, corrected, merged, split, undone."""
    return R.replayed(read(spark, sf_dir, "events").selectExpr(*EDITS), MOMENTS)


PLACES = [
    "o_custkey % 9 as scope",
    "o_orderkey as version",
    f"{pick('(o_orderkey * 3 % 11)', ['discover', 'discover', 'merge', 'correct', 'discover', 'undo', 'split', 'discover', 'merge', 'confirm', 'discover'])} as action",
    "concat('l', o_orderkey * 5 % 23) as owner_id",
    "concat(case when o_orderkey % 4 = 0 then ' Hall ' else 'hall ' end, o_custkey % 37) as alias",
    f"case when {pick('(o_orderkey * 3 % 11)', ['', '', '', '', '', 'u', '', '', '', '', ''])} = 'u' then concat('', o_orderkey - 20) else concat('l', o_orderkey * 7 % 19) end as target",
]
SEEN = [400, 3_000, 9_000, 200_000]


@query(replay_sql("orders", PLACES, SEEN))
def location_history(spark, sf_dir):
    """Which place each name of one is at stated moments: places share the replay of edits with people."""
    return R.replayed(read(spark, sf_dir, "orders").selectExpr(*PLACES), SEEN)


# Scenes are conversations: persons are proposed by words of their turns, and turns end with a name given now and then.
WORD = "regexp_extract(coalesce(text, ''), '[A-Za-z]{4,}', 0)"
SPOKEN = "concat(coalesce(text, ''), case when (conv_id + turn) % 3 = 1 then concat('。我叫', regexp_extract(coalesce(text, ''), '^[A-Za-z]{3,}', 0), 'x。') when (conv_id + turn) % 7 = 2 then concat('。名叫“', regexp_extract(coalesce(text, ''), '[A-Za-z]{4,}', 0), '”。') else '' end)"
PROPOSED = "(conv_id + turn) % 4 = 0 or turn = 5"


@query(f"""with p as (select distinct conv_id as scope, {WORD} as name from conversations where {PROPOSED}), s as (select conv_id as scope, turn as version, {SPOKEN} as content from conversations),
m as (select scope, min(version) as version, 0 as kind, concat('provisional:', scope, ':', md5(lower(trim(name)))) as owner_id, name from s join p using (scope) where name <> '' and contains(content, name) group by scope, name),
i as (select scope, version, 1 as kind, trim(regexp_extract(content, '{R.INTRODUCES}', 1)) as name from s), g as (select scope, version, kind, concat('actor:', scope, ':', md5(lower(name))) as owner_id, name from i where name <> ''),
w as (select *, lag(kind) over b as before, lag(owner_id) over b as waiting, lag(name) over b as called from (select * from m union all select * from g) window b as (partition by scope order by version, kind, owner_id)),
l as (select *, bool_or(coalesce(kind = 0 and before = 0, false)) over (partition by scope order by version, kind, owner_id) as lost from w), k as (select *, lower(trim(called)) = lower(trim(name)) as own from l where kind = 1 and before = 0 and not lost)
select scope, version * 3 as version, 'discover' as action, owner_id, name as alias, null::varchar as target from l where kind = 0 union all select scope, version * 3, 'discover', owner_id, name, null from k where not own
union all select scope, version * 3 + 1, 'confirm', case when own then waiting else owner_id end, null, null from k union all select scope, version * 3 + 2, 'merge', waiting, null, owner_id from k where not own""")
def provisional_actors(spark, sf_dir):
    """Edits of proposed persons: found in texts, and known once one gives a name while only one waits."""
    t = read(spark, sf_dir, "conversations")
    proposals = t.where(PROPOSED).selectExpr("conv_id as scope", f"{WORD} as name", "cast(array() as array<string>) as aliases").distinct()
    return R.provisional_edits(proposals, t.selectExpr("conv_id as scope", "turn as version", f"{SPOKEN} as content"))


HELD = "select o_custkey % 100 as chat_key, case o_orderkey % 3 when 0 then 'actor' when 1 then 'location' else 'object' end as kind, o_orderkey as id, {names} as names, o_orderkey * 37 % 1009 as place from orders"
NAMES = "concat(substring('the of and in be hat eron thing', o_orderkey % 23 + 1, 4), '')", "concat('q', o_orderkey % 50)"


@query(f"""with known as ({HELD.format(names=f"[{', '.join(NAMES)}]")}), n as (select chat_key, kind, id, place, unnest(list_distinct(names)) as name from known),
h as (select n.chat_key, kind, id, min(place) as place from n join conversations b on b.conv_id = n.chat_key where name <> '' and contains(lower(coalesce(text, '')), lower(name)) group by all)
select chat_key, kind, id, concat(upper(kind[1]), case when rank < 10 then '0' else '' end, rank) as reference from (select *, row_number() over (partition by chat_key, kind order by place, id) as rank from h) where rank <= 50""")
def context_prefetch(spark, sf_dir):
    """What the texts of a chat name of what is known of it, as numbered references."""
    known = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 100 as chat_key", "case o_orderkey % 3 when 0 then 'actor' when 1 then 'location' else 'object' end as kind", "o_orderkey as id", f"array({', '.join(NAMES)}) as names", "o_orderkey * 37 % 1009 as place"
    )
    return R.prefetched(read(spark, sf_dir, "conversations").selectExpr("conv_id as chat_key", "text as content"), known)
