"""Library views, audits and small folds as queries; registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthledger.operators import retrieval
from hearthledger.plans.catalogue import EFFECTIVE, ORACLE, c, lexical, long, query, r6, read, strength
from hearthledger.sources.adapters import FACTS, facts, view, view_sql

ROLES = "viewpoint speaker present mentioned world narrator".split()  # fixed values: the first that holds is primary


@query(f"{FACTS} select id, chat_key, lag(id) over w as newer, lead(id) over w as older from facts window w as (partition by chat_key order by updated_at desc, id)")
def fact_neighbours(spark, sf_dir):
    w = Window.partitionBy("chat_key").orderBy(F.desc("updated_at"), "id")
    return view(spark, sf_dir, "facts").select("id", "chat_key", F.lag("id").over(w).alias("newer"), F.lead("id").over(w).alias("older"))


@query(f"{FACTS} select chat_key, subject_key, predicate_key, id, lag(id) over w as supersedes, lead(id) over w as superseded_by from facts window w as (partition by chat_key, subject_key, predicate_key order by updated_at, id)")
def supersede_chain(spark, sf_dir):
    w = Window.partitionBy("chat_key", "subject_key", "predicate_key").orderBy("updated_at", "id")
    return view(spark, sf_dir, "facts").select("chat_key", "subject_key", "predicate_key", "id", F.lag("id").over(w).alias("supersedes"), F.lead("id").over(w).alias("superseded_by"))


@query(f"{view_sql('traces')} select id, owner_id, round({EFFECTIVE}, 6) as effective from traces where privacy = 'public' and knowledge_mode in ('asserted', 'experienced') and round({EFFECTIVE}, 6) >= 25")
def visible_traces(spark, sf_dir):
    t = view(spark, sf_dir, "traces").where("privacy = 'public' and knowledge_mode in ('asserted', 'experienced')")
    return t.select("id", "owner_id", r6(strength()).alias("effective")).where("effective >= 25")


@query(f"{view_sql('traces')} select id, clarity > 50 and (id % 5 = 0 or rehearsals = 0 or belief >= 0.85) as allowed from traces")
def rehearsal_allowed(spark, sf_dir):
    used, explicit, new = c("clarity") > 50, c("id") % 5 == 0, c("rehearsals") == 0
    return view(spark, sf_dir, "traces").select("id", (used & (explicit | new | (c("belief") >= 0.85))).alias("allowed"))


@query(f"{view_sql('traces')} select owner_id, count(*) as votes from traces where privacy = 'public' group by owner_id order by votes desc, owner_id limit 2")
def fallback_owners(spark, sf_dir):
    return view(spark, sf_dir, "traces").where("privacy = 'public'").groupBy("owner_id").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "owner_id").limit(2)


@query(f"{view_sql('usage')} select model, count(*) filter (prompt is not null and completion is not null) as complete, count(*) filter (prompt is null or completion is null) as missing from usage group by model")
def usage_completeness(spark, sf_dir):
    whole = c("prompt").isNotNull() & c("completion").isNotNull()
    return view(spark, sf_dir, "usage").groupBy("model").agg(F.count(F.when(whole, 1)).alias("complete"), F.count(F.when(~whole, 1)).alias("missing"))


@query(f"{view_sql('usage')}, l as (select id, moment, prompt + completion as total from usage order by moment desc, id desc limit 30) select id, total, round(total / max(total) over (), 6) as scaled from l")
def usage_trend(spark, sf_dir):
    last = view(spark, sf_dir, "usage").orderBy(F.desc("moment"), F.desc("id")).limit(30).select("id", (c("prompt") + c("completion")).alias("total"))
    most = last.agg(F.max("total").alias("most"))
    return last.join(F.broadcast(most), F.lit(True)).select("id", "total", r6(c("total") / c("most")).alias("scaled"))  # thirty rows


@query(f"{view_sql('usage')} select chat_key, arg_max(id, (moment, id)) as last_id, max(moment)::varchar is not null as dated from usage group by chat_key")
def latest_call(spark, sf_dir):
    return view(spark, sf_dir, "usage").groupBy("chat_key").agg(F.max_by("id", F.struct("moment", "id")).alias("last_id"), F.max("moment").isNotNull().alias("dated"))


@query("select 'documents' as name, count(*) as n, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes from documents union all select 'conversations', count(*), sum(octet_length(encode(coalesce(text, ''))))::bigint from conversations union all select 'benchmark', count(*), sum(octet_length(encode(coalesce(text, ''))))::bigint from benchmark")
def collection_sizes(spark, sf_dir):
    out = None
    for name in ("documents", "conversations", "benchmark"):
        one = read(spark, sf_dir, name).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).select(F.lit(name).alias("name"), "n", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


@query("select greatest((select max(doc_id) from documents), (select max(event_id) from events), (select max(o_orderkey) from orders)) as revision")
def data_revision(spark, sf_dir):
    cols = (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey"))
    one = [read(spark, sf_dir, t).agg(F.max(k).alias("revision")) for t, k in cols]
    return one[0].unionByName(one[1]).unionByName(one[2]).agg(F.max("revision").alias("revision"))


@query(ORACLE["recall_bm25"].replace("select query_id, id, round(score, 6) as score, rank from r where rank <= 12", "select query_id, id, round(least(1.0, score / 40) * (0.85 + 0.15 * least(1.0, greatest(1.0 / rank, 0.1))), 6)::double as rerank from r where rank <= 12"))
def rerank_score(spark, sf_dir):
    near = F.least(F.lit(1.0), F.greatest(1.0 / c("rank"), F.lit(0.1)))
    ranked = retrieval.top(lexical(spark, sf_dir, 12), ["query_id"], [F.desc(r6(c("score"))), F.asc("id")], 12)
    return ranked.select("query_id", "id", r6(F.least(F.lit(1.0), c("score") / 40) * (0.85 + 0.15 * near)).alias("rerank"))


@query(f"{view_sql('repairs')}, r as (select *, row_number() over (partition by collection, item order by attempts desc, id desc) as k from repairs) select id, collection, item, case when k = 1 then status else 'superseded_attempt' end as status from r")
def superseded_attempts(spark, sf_dir):
    last = F.row_number().over(Window.partitionBy("collection", "item").orderBy(F.desc("attempts"), F.desc("id"))) == 1
    return view(spark, sf_dir, "repairs").select("id", "collection", "item", F.when(last, c("status")).otherwise("superseded_attempt").alias("status"))


@query(f"""{view_sql('blocks')}, f as (select chat_key, floor, sum(length(content)) as chars from blocks group by all), p as (select *, sum(chars) over (partition by chat_key order by floor desc rows unbounded preceding) as reach from f)
select chat_key, floor, reach::bigint as reach from p where reach <= 1200""")
def context_budget(spark, sf_dir):
    f = view(spark, sf_dir, "blocks").groupBy("chat_key", "floor").agg(F.sum(F.length("content")).alias("chars"))
    reach = F.sum("chars").over(Window.partitionBy("chat_key").orderBy(F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("reach", reach).where("reach <= 1200").select("chat_key", "floor", "reach")


@query(f"""{view_sql('blocks')}, f as (select chat_key, floor, row_number() over (partition by chat_key order by floor) - 1 as k from (select distinct chat_key, floor from blocks))
select chat_key, k // 3 as batch, floor, false as context from f union all select chat_key, k // 3 + 1, floor, true from f where k % 3 = 2 and k + 1 < (select max(k) + 1 from f g where g.chat_key = f.chat_key)""")
def batch_overlap(spark, sf_dir):
    w = Window.partitionBy("chat_key").orderBy("floor")
    f = view(spark, sf_dir, "blocks").select("chat_key", "floor").distinct().withColumn("k", F.row_number().over(w) - 1)
    f = f.withColumn("after", F.lead("floor").over(w))
    own = f.select("chat_key", long(F.floor(c("k") / 3)).alias("batch"), "floor", F.lit(False).alias("context"))
    before = f.where("k % 3 = 2 and after is not null").select("chat_key", long(F.floor(c("k") / 3) + 1).alias("batch"), "floor", F.lit(True).alias("context"))
    return own.unionByName(before)


@query(f"{view_sql('repairs')} select job_id, min(regexp_extract(source_ref, 'floor-([0-9]+)', 1)::bigint) as first_floor, count(distinct source_ref) as sources from repairs group by job_id")
def source_floors(spark, sf_dir):
    return view(spark, sf_dir, "repairs").groupBy("job_id").agg(F.min(long(F.regexp_extract("source_ref", r"floor-([0-9]+)", 1))).alias("first_floor"), F.countDistinct("source_ref").alias("sources"))


@query(f"{view_sql('traces')} select scene_id, owner_id, max(belief) as confidence, count(distinct privacy) as channels, count(*) as sources from traces group by scene_id, owner_id")
def scene_owner_confidence(spark, sf_dir):
    return view(spark, sf_dir, "traces").groupBy("scene_id", "owner_id").agg(F.max("belief").alias("confidence"), F.countDistinct("privacy").alias("channels"), F.count("*").alias("sources"))


ROLE_SQL = "case min(id % 6) " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(ROLES)) + " end"


@query(f"{view_sql('traces')} select scene_id, owner_id, {ROLE_SQL} as role from traces group by scene_id, owner_id")
def primary_scene_role(spark, sf_dir):
    least = (F.min(c("id") % 6) + 1).cast("int")
    return view(spark, sf_dir, "traces").groupBy("scene_id", "owner_id").agg(F.element_at(F.array(*(F.lit(r) for r in ROLES)), least).alias("role"))


@query(f"{view_sql('traces')} select owner_id, fact_id, max(strength) as strength, max(clarity) as clarity, max(belief) as belief, max(salience) as salience, min(learned_at) as learned_at, count(*) - 1 + max(rehearsals) as rehearsals from traces group by owner_id, fact_id")
def trace_merge(spark, sf_dir):
    best = [F.max(x).alias(x) for x in ("strength", "clarity", "belief", "salience")]
    return view(spark, sf_dir, "traces").groupBy("owner_id", "fact_id").agg(*best, F.min("learned_at").alias("learned_at"), (F.count("*") - 1 + F.max("rehearsals")).alias("rehearsals"))


@query(f"{view_sql('traces')} select scene_id, count(*) as candidates, count(distinct fact_id) as distinct_facts, count(*) - count(distinct fact_id) as duplicates from traces group by scene_id")
def recall_diagnostics(spark, sf_dir):
    return view(spark, sf_dir, "traces").groupBy("scene_id").agg(F.count("*").alias("candidates"), F.countDistinct("fact_id").alias("distinct_facts"), (F.count("*") - F.countDistinct("fact_id")).alias("duplicates"))


SECRET = "(password|passwd|api[_-]?key|secret|token|bearer)"


@query(f"select doc_id, regexp_matches(lower(coalesce(text, '')), '{SECRET}') as sensitive from documents")
def sensitive_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_like(F.lower(F.coalesce("text", F.lit(""))), F.lit(SECRET)).alias("sensitive"))


@query(f"""{FACTS}, n as (select id, evidence, len(regexp_extract_all(coalesce(content, ''), '[0-9]+')) as numbers, len(list_distinct(regexp_extract_all(coalesce(content, ''), '[0-9]+'))) as different from facts)
select id, numbers, different, numbers = 0 or evidence as supported from n""")
def numeric_support(spark, sf_dir):
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("[0-9]+"), F.lit(0))
    n = facts(spark, sf_dir).select("id", "evidence", long(F.size(found)).alias("numbers"), long(F.size(F.array_distinct(found))).alias("different"))
    return n.select("id", "numbers", "different", ((c("numbers") == 0) | c("evidence")).alias("supported"))


@query(f"{FACTS} select chat_key, count(*) as facts, count(*) filter (evidence) as backed, (100 * count(*) filter (evidence) / count(*))::double as coverage from facts group by chat_key")
def evidence_coverage(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("chat_key").agg(F.count("*").alias("facts"), F.count(F.when(c("evidence"), 1)).alias("backed"))
    return g.select("chat_key", "facts", "backed", (100 * c("backed") / c("facts")).alias("coverage"))
