"""Reading a query: facets, requested kinds, intent, time, parts, segments, named terms and the owners that it concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What tells of each facet in a query.
CUES = {
    "time": "之前|曾经|当时|历史|最早|最初|起初|后来|先后|过去|未来|明天|昨天|多久|何时|什么时候",
    "current": "当前|现在|目前|最新|最后|还剩|剩余|现有|最终|此刻|这里",
    "timeline": "变化|经过|一路|时间线|先.*后|从.*到",
    "relationship": "关系|朋友|敌人|同伴|喜欢|讨厌|信任|认识|属于|父母|兄弟|恋人",
    "event": "发生|事件|经历|做过|说过|见过|战斗|离开|抵达|死亡|承诺|答应",
    "state": "状态|位置|地点|数量|多少|拥有|持有|健康|伤|计划|目标|是否还在",
    "capability": "能力|能够|能否|能做什么|可以做什么|可以怎样|如何感知|怎样感知|感知范围|协助侦察|侦察能力|功能|作用",
    "identity": "是谁|是什么人|身份|叫什么|哪位",
    "directive": "指挥|指令|命令|下令|安排|分工|应对|调度|接下来|下一步|行动",
    "knowledge": "知道|知不知道|是否知道|记得|回忆|听说|认为|经历过|见过",
    "causal": "为什么|原因|导致|因此|因果|怎么会|缘由|知不知道|是否知道",
    "world": "世界|规则|设定|世界观",
    "narrator": "旁白|叙事|镜头|读者",
    "definition": "是什么|是什麼|何谓|何謂|定义|定義|含义|含義|原理|机制|機制|指什么|指什麼",
    "impact": "影响|影响了|区别|差异|危害|危险|价值|用途|利用|利弊|优缺点",
    "protection": "防护|安全措施|生存原则|物理隔离|防化服|防毒面具|暴露|污染|晶化",
}
NEXT_PART = "是否|为什么|现在|当前|知不知道|还在"  # fixed values: a comma before such words parts a query
PARTS, SEGMENTS = 8, 12
FIXED_OWNERS = ["owner:world", "owner:narrator"]


def flags(query: Column) -> dict[str, Column]:
    """Whether a query has each cue; null has none."""
    return {name: F.coalesce(F.regexp_like(query, F.lit(cue)), F.lit(False)) for name, cue in CUES.items()}


def requested_kinds(has: dict[str, Column]) -> Column:
    """Kinds of facts that a query asks for, comma-joined, each once, in their fixed order."""
    on = lambda cond, *kinds: F.when(cond, F.array(*(F.lit(k) for k in kinds))).otherwise(F.array().cast("array<string>"))
    world = has["world"] | has["definition"] | has["protection"]
    parts = [
        on(has["identity"], "identity"), on(has["relationship"], "relationship"), on(has["event"], "event"), on(has["directive"], "event", "commitment", "goal"),
        on(has["capability"], "capability"), on(has["state"], "state", "location", "goal"), on(world, "world_rule"),
    ]
    return F.array_join(F.array_distinct(F.concat(*parts)), ",")


def intent_kind(has: dict[str, Column], named: Column) -> Column:
    """The first rule that holds; `named` is the number of owners that the query names."""
    some = named > 0
    about = has["identity"] | has["state"] | has["capability"] | has["causal"] | has["impact"]
    out = F.when(has["relationship"] & some, "relationship").when(has["knowledge"] & some, "actor_knowledge").when(about & some, "actor_entity")
    out = out.when(has["protection"] & ~some, "world_knowledge").when(has["directive"], "scene_action").when(has["timeline"] | has["time"], "timeline")
    return out.when(has["world"] | has["definition"] | has["impact"], "world_knowledge").otherwise("general")


def sub_queries(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, query): up to PARTS parts of each query; a query without parts is its own."""
    cut = F.split(F.trim(text), rf"[？?；;\n]|[，,](?=[^，,]{{2,}}(?:{NEXT_PART}))")
    parts = F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(text)))
    return queries.where(F.trim(text) != "").select(key, F.posexplode(F.slice(parts, 1, PARTS)).alias("part", "query")).withColumn("part", F.col("part").cast("long") + 1)


def segments_of(text: Column) -> Column:
    """Array of a query's pieces between marks and conjunctions, without words of asking, of two characters or more, in order."""
    cut = F.split(text, r"[、，,；;|/]|\s+[aA][nN][dD]\s+|和|及|与")
    some = F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(x, "请问|请告诉我|查询|记忆|告诉我", ""))), lambda x: F.length(x) >= 2)
    return F.slice(some, 1, SEGMENTS)


def segments(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, segment): the pieces of ``segments_of``."""
    return queries.select(key, F.explode(segments_of(F.col(text))).alias("segment"))


def named_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): names that a query puts in quotes or calls names."""
    low = F.lower(F.col(text))
    quoted = F.regexp_extract_all(low, F.lit(r"[“‘\"']([\p{IsHan}a-z0-9_:-]{2,32})[”’\"']"), F.lit(1))
    called = F.regexp_extract_all(low, F.lit(r"(?:名为|名叫|叫做|称为|代号为|编号为)\s*([\p{IsHan}a-z0-9_:-]{2,32}?)(?:的|[，。？！,!?；;\s]|$)"), F.lit(1))
    return queries.select(key, F.explode(F.array_distinct(F.concat(quoted, called))).alias("term"))


def plan(queries: DataFrame, key: str, text: str, named: str) -> DataFrame:
    """One row per query: time, kinds, intent, actors and complexity; `named` is an array of the owners it names."""
    q = F.col(text)
    has, n = flags(q), F.size(named)
    facets = F.array_join(F.array(*(F.when(h, name) for name, h in {"time": has["time"] | has["timeline"], "relationship": has["relationship"], "event": has["event"], "state": has["state"], "actor": n > 0}.items())), ",")
    breadth = sum((h.cast("int") for h in (has["time"] | has["timeline"], has["relationship"], has["event"], has["state"], n > 0)), F.lit(0))
    temporal = F.when(has["time"] & has["current"], "mixed").when(has["time"], "historical").when(has["current"], "current").otherwise("unspecified")
    parts = sub_queries(queries, key, text).groupBy(key).agg(F.count("*").alias("parts"))
    d = queries.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    multi_hop = has["causal"] & ((F.col("parts") > 1) | (n > 1) | (breadth >= 3))
    complexity = F.when(multi_hop, "multi_hop").when((F.col("parts") > 1) | (breadth >= 3), "multi_topic").otherwise("direct")
    d = d.select(key, F.col(named).alias("named"), "parts", has["timeline"].alias("line"), has["narrator"].alias("tells"), facets.alias("facets"), temporal.alias("temporal"), requested_kinds(has).alias("kinds"), intent_kind(has, n).alias("intent"), complexity.alias("complexity"))
    c = F.col
    mode = F.when(c("line") | (c("temporal") == "mixed"), "timeline").when(c("temporal") == "unspecified", "unknown").otherwise(c("temporal"))
    actor = F.when(c("intent") == "world_knowledge", "world").when(c("tells"), "narrator").when(F.size("named") > 0, "named_actors").otherwise("planned_cast")
    hops = F.when(c("complexity") == "multi_hop", 2).when(c("complexity") == "multi_topic", 1).otherwise(0).cast("long")
    return d.select(key, "parts", "facets", "temporal", mode.alias("time_mode"), "kinds", c("intent").alias("intent_kind"), actor.alias("actor_mode"), "complexity", hops.alias("graph_hops"), ((c("complexity") != "direct") | (mode == "timeline")).alias("verify"))


def owner_scope(intents: DataFrame, key: str) -> DataFrame:
    """(key, owner_id, required): owners whose memories a query may use; intents has intent_kind, named, cast (required owners), likely, viewpoint."""
    c, none = F.col, F.array().cast("array<string>")
    fixed = F.array(*(F.lit(o) for o in FIXED_OWNERS))
    seen, likely = F.when(c("viewpoint").isNotNull(), F.array("viewpoint")).otherwise(none), F.slice("likely", 1, 2)
    pov = F.concat(seen, "cast")
    by = lambda pairs, rest: _when([(c("intent_kind").isin(*kinds), v) for kinds, v in pairs], rest)
    timeline = F.when(F.size("named") > 0, c("named")).otherwise(pov)
    actors = (("actor_knowledge", "relationship"), c("named"))
    owners = by([(("recent_context",), none), (("world_knowledge",), fixed), (("actor_entity",), F.concat(fixed, "named")), actors, (("scene_action",), F.concat(pov, likely)), (("timeline",), timeline)], F.concat(fixed, pov, likely))
    required = by([(("recent_context", "world_knowledge", "actor_entity"), none), actors, (("timeline",), timeline)], pov)
    return intents.select(key, F.explode(F.array_distinct(owners)).alias("owner_id"), required.alias("r")).select(key, "owner_id", F.array_contains("r", c("owner_id")).alias("required"))


def _when(cases: list, rest: Column) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(rest)
