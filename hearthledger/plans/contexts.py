"""Queries over contexts within a budget and over the lineage of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger.operators import budgets as B
from hearthledger.operators import lineage as L
from hearthledger.plans.catalogue import LEXICAL_SQL, blended, c, long, query, read
from hearthledger.sources.adapters import pick, view, view_sql

BUDGET, POOL, ASKED = 16_000, 120, 700
SIZE = "length(coalesce(content, ''))"


@query(f"""{LEXICAL_SQL}, p as (select query_id, b.id, row_number() over (partition by query_id order by blend desc, b.id) as turn, length(coalesce(content, '')) as size from b join facts using (id) qualify turn <= {POOL}),
a as (select query_id, list({{'id': id, 'used': size}} order by turn) as rows_ from p group by query_id),
k as (select query_id, list_reduce(rows_, lambda s, r: case when coalesce(s[-1].used, 0) + r.used <= {BUDGET} then list_append(s, {{'id': r.id, 'used': coalesce(s[-1].used, 0) + r.used}}) else s end, []::struct(id bigint, used bigint)[]) as taken from a)
select query_id, t.id as id, t.used as used from (select query_id, unnest(taken) as t from k)""")
def context_within_budget(spark, sf_dir):
    """Facts that a question's context holds: by score, as long as they fit; one that is too long is passed over."""
    rows = blended(spark, sf_dir, size=F.expr(SIZE)).withColumn("order", -c("blend"))
    return B.passing(rows, ["query_id"], ["order"], "id", "size", BUDGET, POOL)


@query(f"""{LEXICAL_SQL}, p as (select query_id, b.id, blend, length(coalesce(content, '')) as size from b join facts using (id)), r as (select query_id, id, sum(size) over (partition by query_id order by blend desc, id rows unbounded preceding)::bigint as used from p)
select * from r where used <= {BUDGET}""")
def context_up_to_budget(spark, sf_dir):
    """The same, ended by the first fact that doesn't fit."""
    rows = blended(spark, sf_dir, size=F.expr(SIZE)).select("query_id", "id", (-c("blend")).alias("order"), "size")
    return B.stopping(B.near(rows, ["query_id"], ["order", "id"], "size", BUDGET), ["query_id"], [F.asc("order"), F.asc("id")], "size", BUDGET).select("query_id", "id", "used")


@query(f"{view_sql('blocks')}, h as (select chat_key, string_agg(content, chr(10) order by floor) as text from blocks group by chat_key) select chat_key, right(text, {ASKED}) as text from h")
def context_question(spark, sf_dir):
    """What is asked of memory before a chat goes on: the end of its sources."""
    return B.last_text(view(spark, sf_dir, "blocks"), ["chat_key"], ["floor"], "content", ASKED)


# Links of an audit: attempts follow attempts (some in circles), attempts cite sources, sources are decided upon, decisions make facts.
HOPS = {
    "retry": ("concat('c:', event_id)", "concat('c:', case when event_id % 50 = 49 then event_id - 4 else event_id + 1 end)", "event_id % 10 in (5, 6, 9)"),
    "cites": ("concat('c:', event_id)", "concat('e:', event_id % 50 * 3)", "event_id % 4 <> 3"),
    "also": ("concat('c:', event_id)", "concat('e:', event_id % 31)", "event_id % 9 = 4"),
    "decides": ("concat('e:', event_id)", f"concat('d:', {pick('event_id % 3', ['accept', 'merge', 'reject'])}, event_id % 40)", "event_id < 200 and event_id % 5 <> 2"),
    "makes": (f"concat('d:', {pick('event_id % 3', ['accept', 'merge', 'reject'])}, event_id % 40)", "concat('f:', event_id % 60)", "event_id < 400 and event_id % 3 <> 2"),
}
LINKS = " union all ".join(f"select {a} as source, {b} as target from events where {cond}" for a, b, cond in HOPS.values())
STAGES = {"c:": "candidate", "e:": "evidence", "d:": "decision", "f:": "fact"}
WALK = f"""with recursive k as materialized (select distinct source, target from ({LINKS})), s as (select concat('c:', event_id) as node from events where event_id % 10 in (3, 5)),
w as (select node as start, [node] as path from s union all select start, list_append(path, target) from w join k on k.source = path[-1] where not list_contains(path, target)),
x as (select start, path, exists (select 1 from k where k.source = path[-1]) as closed from w where not exists (select 1 from k where k.source = path[-1] and not list_contains(path, k.target)))"""


def walked(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    links = None
    for source, target, cond in HOPS.values():
        one = e.where(cond).selectExpr(f"{source} as source", f"{target} as target")
        links = one if links is None else links.unionByName(one)
    return L.chains(links, e.where("event_id % 10 in (3, 5)").selectExpr("concat('c:', event_id) as node"))


@query(f"{WALK} select start, array_to_string(path, '>') as path, closed from x")
def candidate_lineage(spark, sf_dir):
    """Every chain from a candidate over evidence and decisions to facts."""
    return walked(spark, sf_dir).select("start", F.array_join("path", ">").alias("path"), "closed")


@query(f"{WALK}, r as (select start, count(*) as chains, max(case when len(list_filter(path, lambda n: starts_with(n, 'f:'))) > 0 then 4 when len(list_filter(path, lambda n: starts_with(n, 'd:'))) > 0 then 3 when len(list_filter(path, lambda n: starts_with(n, 'e:'))) > 0 then 2 else 1 end) as k from x group by start) select start, ['candidate', 'evidence', 'decision', 'fact'][k] as stage, chains from r")
def candidate_stages(spark, sf_dir):
    """How far each candidate came."""
    return L.last_stage(walked(spark, sf_dir), STAGES)
