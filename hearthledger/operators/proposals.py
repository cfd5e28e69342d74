"""Structured capture: records of six collections out of JSON responses, their evidence, and the rules that reject them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.cuts import cut
from hearthledger.sources.adapters import KINDS

c = F.col
# Collections of a response, in the order in which they are read, and what a record of each is called.
COLLECTIONS = {"actorCandidates": "actor", "locationCandidates": "location", "itemCandidates": "item", "episodes": "episode", "claims": "claim", "inventoryOperations": "inventory"}
EVERYWHERE = ["world", "narrator", "player"]  # fixed values: references that need no candidate
SHORTEST, LONGEST = 6, 280  # characters of a claim's content; a summary has the former at least


def responses(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of JSON responses.

    ``records`` is (key, type, rank, place, record): one variant a record, from one pass over the texts.  ``rejections`` is
    (key, path, keyword): responses that are no JSON object, or lack one of the six arrays, give no record.
    """
    spark = df.sparkSession
    v = df.select(key, F.try_parse_json(text).alias("v"))
    shape = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get("v", p, "variant")), F.lit(""))
    arrays = [F.startswith(shape(f"$.{name}"), F.lit("ARRAY")) for name in COLLECTIONS]
    whole = arrays[0]
    for a in arrays[1:]:
        whole = whole & a
    keyword = F.when(c("v").isNull() | ~F.startswith(shape("$"), F.lit("OBJECT")), "type").when(~whole, "required")
    v = v.withColumn("keyword", keyword)
    kind = "case c.key " + " ".join(f"when '{k}' then '{t}'" for k, t in COLLECTIONS.items()) + " end"
    rank = "case c.key " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(COLLECTIONS)) + " end"
    names = ", ".join(f"'{k}'" for k in COLLECTIONS)
    records = spark.sql(
        f"select d.{key}, {kind} as type, {rank} as rank, r.pos as place, r.value as record from {{d}} d, lateral variant_explode(d.v) c, lateral variant_explode(c.value) r where c.key in ({names})",
        d=v.where("keyword is null").select(key, "v"),
    )
    return records, v.where("keyword is not null").select(key, F.lit("$").alias("path"), "keyword")


def fields(records: DataFrame, key: str) -> DataFrame:
    """Records with their fields as columns; empty optional texts are null, amounts are kept where an operation states one."""
    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    some = lambda name: F.nullif(get(name), F.lit(""))
    many = lambda name: F.coalesce(get(name, "array<string>"), F.array().cast("array<string>"))
    episode, stock = c("type") == "episode", c("type") == "inventory"
    states = ~((get("operation") == "remove") | (get("precision") == "unknown"))
    return records.select(
        key, "type", "rank", "place",
        get("localId").alias("local_id"), F.coalesce(get("displayName"), F.lit("")).alias("name"), many("aliases").alias("aliases"), get("confidence", "double").alias("confidence"),
        F.when(episode, many("evidenceSpanIds")).otherwise(F.array(get("evidenceSpanId"))).alias("spans"),
        some("kind").alias("kind"), F.coalesce(get("predicateKey"), F.lit("")).alias("predicate_key"), F.when(episode, get("summary")).otherwise(get("content")).alias("content"),
        F.when(episode, F.array_distinct(F.concat(many("participantRefs"), many("presentRefs"), many("mentionedRefs"))))
        .otherwise(F.filter(F.array(some("subjectRef"), some("objectRef"), F.when(stock, some("itemRef"))), lambda x: x.isNotNull())).alias("refs"),
        F.when(stock & states, get("amount", "double")).alias("amount"), some("operation").alias("operation"), some("episodeLocalId").alias("episode_ref"),
    )


def with_evidence(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """`rows` with `sources` and `excerpts` of their spans, and `unknown`: how many spans aren't among `spans` (key, span_id, source_ref, text).  One equi-join on the span."""
    own, rows = [key, "type", "place"], cut(rows)  # read twice below; responses are parsed once
    asked = rows.select(*own, F.posexplode("spans").alias("at", "span_id"))
    held = spans.select(key, "span_id", "source_ref", c("text").alias("excerpt"), F.lit(True).alias("known"))
    met = asked.join(held, [key, "span_id"], "left").groupBy(*own).agg(
        F.array_sort(F.collect_list(F.when(c("known"), F.struct("at", "source_ref", "excerpt")))).alias("met"), F.count(F.when(c("known").isNull(), 1)).alias("unknown")
    )
    out = rows.join(met, own, "left").withColumn("unknown", F.coalesce("unknown", F.lit(0).cast("long")))
    return out.withColumns({"sources": F.coalesce(F.array_distinct("met.source_ref"), F.array().cast("array<string>")), "excerpts": F.coalesce(c("met.excerpt"), F.array().cast("array<string>"))}).drop("met")


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for broken, code in rules:
        out = out.when(broken, code)
    return out


def validated(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """`rows` with `reason`: the first rule that rejects a record, null for those that are accepted.

    `sources` is (key, source_ref, content, writable).  Order of rules: unknown spans; missing ids, names or texts; a local id that an accepted record
    of the same space had before (people, places and items share one, episodes and claims have their own); sources that are unknown
    or not writable; excerpts that aren't in their source word for word (items: that don't hold the item's name); kinds, confidence and
    lengths; references to nothing that was accepted or is known everywhere, and references whose name no source of the record holds.
    References depend on accepted people, places and items only, so two passes settle all records.
    """
    own, rows = [key, "type", "place"], cut(rows)
    entity = c("type").isin("actor", "location", "item")
    # One source a record, but for episodes: all their sources must exist, and one be writable.
    each = rows.select(*own, F.explode(F.arrays_zip("sources", "excerpts")).alias("e")).select(*own, "e.sources", "e.excerpts").withColumnsRenamed({"sources": "source_ref", "excerpts": "excerpt"})
    met = each.join(sources.select(key, "source_ref", "content", "writable"), [key, "source_ref"], "left")
    seen = met.groupBy(*own).agg(
        F.count(F.when(c("content").isNull() & c("source_ref").isNotNull(), 1)).alias("lost"), F.max(F.coalesce("writable", F.lit(False))).alias("writable"),
        F.min(F.coalesce(F.contains("content", "excerpt"), F.lit(True))).alias("verbatim"), F.concat_ws("\n", F.collect_list(F.when(c("source_ref").isNotNull(), c("content")))).alias("held"),
    )
    rows = rows.join(seen, own, "left")
    named = F.exists("excerpts", lambda e: F.contains(e, c("name")))
    blank = c("local_id").isNull() | (c("local_id") == "") | (entity & (F.trim("name") == ""))
    claim, episode = c("type") == "claim", c("type") == "episode"
    base = _first(
        (c("unknown") > 0, "schema_validation_failed"),
        (blank, "invalid_shape"),
        ((F.size("sources") == 0) | (F.coalesce("lost", F.lit(0)) > 0) | ~F.coalesce("writable", F.lit(False)), "invalid_reference"),
        (episode & (F.length(F.coalesce("content", F.lit(""))) < SHORTEST), "invalid_shape"),
        (~episode & ~F.coalesce("verbatim", F.lit(False)), "excerpt_mismatch"),
        ((c("type") == "item") & ~named, "excerpt_mismatch"),
        (claim & ~F.coalesce(c("kind").isin(KINDS), F.lit(False)), "invalid_enum"),
        (~episode & ~F.coalesce(c("confidence").between(0, 1), F.lit(False)), "invalid_confidence"),
        (claim & (~F.coalesce(F.length("content").between(SHORTEST, LONGEST), F.lit(False)) | (F.trim("predicate_key") == "")), "invalid_shape"),
    )
    space = F.when(entity, "entity").otherwise(c("type"))
    rows = rows.withColumn("base", base).withColumn("at", F.struct("rank", "place")).withColumn("space", space)
    first = F.min(F.when(c("base").isNull(), c("at"))).over(Window.partitionBy(key, "space", "local_id"))
    again = ~blank & (c("unknown") == 0) & F.coalesce(first < c("at"), F.lit(False))
    rows = cut(rows.withColumn("base", F.when(again, "duplicate_proposal").otherwise(c("base"))))
    taken = rows.where(entity & c("base").isNull()).select(key, c("local_id").alias("ref"), c("name").alias("ref_name"), c("aliases").alias("ref_aliases"))
    refs = rows.where(c("base").isNull() & ~entity).select(*own, "held", F.explode("refs").alias("ref")).where(~c("ref").isin(EVERYWHERE)).join(taken, [key, "ref"], "left")
    said = F.exists(F.concat(F.array("ref_name"), "ref_aliases"), lambda n: (n != "") & F.contains(c("held"), n))
    bad = refs.groupBy(*own).agg(F.max(c("ref_name").isNull()).alias("absent"), F.max(~F.coalesce(said, F.lit(True))).alias("unsaid"))
    late = F.when(c("absent"), "invalid_reference").when(c("unsaid"), "entity_ref_unsupported")
    return rows.join(bad, own, "left").withColumn("reason", F.coalesce("base", late)).drop("base", "at", "space", "held", "lost", "writable", "verbatim", "absent", "unsaid")


def materialized(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(facts, observations) of accepted claims in `rows` (``validated``).

    ``facts`` is (key, fact_id, kind, predicate_key, content, source_ref, excerpt, confidence, episode): one a claim, `episode` the place of the accepted episode
    that it names.  ``observations`` is (key, fact_id, owner_ref): whoever a fact is about or who takes part in its episode, if accepted as a person or known
    everywhere, once each.
    """
    ok = cut(rows.where("reason is null"))
    episodes = ok.where("type = 'episode'").select(key, c("local_id").alias("episode_ref"), c("place").cast("long").alias("episode"), c("refs").alias("episode_refs"))
    claims = ok.where("type = 'claim'").drop("episode", "episode_refs").join(episodes, [key, "episode_ref"], "left").withColumn("source_ref", F.get("sources", F.lit(0)))
    identity = F.concat_ws("|", c(key).cast("string"), c("place").cast("string"), "kind", "predicate_key", "content", "source_ref")
    claims = claims.withColumn("fact_id", F.concat(F.lit("fact:"), F.md5(identity.cast("binary"))))
    facts = claims.select(key, "fact_id", "kind", "predicate_key", "content", "source_ref", F.get("excerpts", F.lit(0)).alias("excerpt"), "confidence", "episode")
    refs = F.array_distinct(F.concat("refs", F.coalesce("episode_refs", F.array().cast("array<string>"))))
    asked = claims.select(key, "fact_id", F.explode(refs).alias("owner_ref"))
    people = ok.where("type = 'actor'").select(key, c("local_id").alias("owner_ref"), F.lit(True).alias("person"))
    known = asked.join(people, [key, "owner_ref"], "left").where(c("person") | c("owner_ref").isin(EVERYWHERE))
    return facts, known.select(key, "fact_id", "owner_ref")
