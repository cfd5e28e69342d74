"""Registries of names: whose name an alias is at any moment, by replaying a log of edits as joins.

An edit is (scope, version, action, owner_id, alias, target): versions are unique in a scope.

- ``discover``: `alias` is a name of `owner_id`; ``correct``: `alias` is a name of `target` from now on.  The last of these decides.
- ``merge``: `owner_id` is `target` from now on; ``split``: it is itself again.  The last of these decides.  Merges chain; where they
  go in a circle, the smallest owner of the circle stands for all of it.
- ``confirm``: `owner_id` is confirmed.  An alias is confirmed if its own owner or the one that stands for it is.
- ``undo``: the edit whose version `target` names no longer counts, as if it had not been made; undoing an undo has no effect.

Edits without scope, version or owner (``undo``: without target) are left out.  Names are compared trimmed, in lower case.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthledger.cuts import cut, dropped

c = F.col


def _live(edits: DataFrame, moments: list[int]) -> tuple[DataFrame, DataFrame]:
    """(standing, passing): edits with the first moment that sees them; of undone ones, a row for each moment before the undoing."""
    at = F.array(*(F.lit(m).cast("long") for m in moments))
    first = lambda v: F.array_min(F.filter(at, lambda m: m >= v))
    undone = edits.where("action = 'undo' and target is not null").groupBy("scope", c("target").cast("long").alias("version")).agg(F.min("version").alias("gone"))
    rows = edits.where("action <> 'undo' and scope is not null and version is not null and owner_id is not null").join(undone, ["scope", "version"], "left")
    standing = rows.where("gone is null").withColumn("moment", first(c("version"))).where("moment is not null").drop("gone")
    passing = rows.where("gone is not null").withColumn("moment", F.explode(F.filter(at, lambda m: (m >= c("version")) & (m < c("gone"))))).drop("gone")
    return standing, passing


def _latest(standing: DataFrame, passing: DataFrame, key: list[str], value: str, moments: list[int]) -> DataFrame:
    """(*key, moment, value): what the last edit of a key says at each moment from its first edit on.

    Edits come down to one a key and moment before moments follow each other, so that a window holds no more rows than there are moments.
    """
    last = lambda d: d.groupBy(*key, "moment").agg(F.max(F.struct("version", value)).alias("last"))
    grid = standing.select(*key).unionByName(passing.select(*key)).distinct().withColumn("moment", F.explode(F.array(*(F.lit(m).cast("long") for m in moments))))
    so_far = Window.partitionBy(*key).orderBy("moment").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(last(standing).withColumnRenamed("last", "kept"), [*key, "moment"], "left").withColumn("kept", F.max("kept").over(so_far))
    rows = rows.join(last(passing).withColumnRenamed("last", "held"), [*key, "moment"], "left").withColumn("best", F.greatest("kept", "held"))
    return rows.where("best is not null").select(*key, "moment", c(f"best.{value}").alias(value))


def roots(parents: DataFrame) -> DataFrame:
    """(scope, moment, owner_id, root) of (scope, moment, owner_id, parent): whom each merged owner ends at.

    Ways double in each round, so that a chain of n merges takes log2(n) joins; the smallest owner on each way is carried along, which names circles.
    """
    key = ["scope", "moment"]
    most = parents.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    way = cut(parents.select(*key, "owner_id", c("parent").alias("far"), F.least("owner_id", "parent").alias("least")))
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        on = way.select(*key, c("owner_id").alias("far"), c("far").alias("next"), c("least").alias("low"))
        longer = cut(way.join(on, [*key, "far"], "left").select(*key, "owner_id", F.coalesce("next", "far").alias("far"), F.least("least", F.coalesce("low", "least")).alias("least")))
        dropped(way)
        way = longer
    # Whoever still has a way on where a way ends lies in a circle: a walk from there goes around it.
    circle = way.select(*key, c("owner_id").alias("far"), c("least").alias("round"))
    return way.join(circle, [*key, "far"], "left").select(*key, "owner_id", F.coalesce("round", "far").alias("root"))


def replayed(edits: DataFrame, moments: list[int]) -> DataFrame:
    """(scope, moment, alias, owner_id, root, confirmed): each alias at each moment of a stated list, from its first edit on."""
    moments = sorted(set(moments))
    edits = edits.withColumn("alias", F.nullif(F.lower(F.trim("alias")), F.lit("")))
    standing, passing = map(cut, _live(edits, moments))
    named = lambda d: d.where("(action = 'discover' or (action = 'correct' and target is not null)) and alias is not null").withColumn("whose", F.when(c("action") == "correct", c("target")).otherwise(c("owner_id")))
    linked = lambda d: d.where("(action = 'merge' and target is not null and target <> owner_id) or action = 'split'").withColumn("parent", F.when(c("action") == "merge", c("target")))
    sure = lambda d: d.where("action = 'confirm'").withColumn("sure", F.lit(True))
    names = _latest(named(standing), named(passing), ["scope", "alias"], "whose", moments).withColumnRenamed("whose", "owner_id")
    merges = _latest(linked(standing), linked(passing), ["scope", "owner_id"], "parent", moments).where("parent is not null")
    confirmed = _latest(sure(standing), sure(passing), ["scope", "owner_id"], "sure", moments)
    ends = roots(merges)
    out = names.join(ends, ["scope", "moment", "owner_id"], "left").withColumn("root", F.coalesce("root", "owner_id"))
    out = out.join(confirmed, ["scope", "moment", "owner_id"], "left").join(confirmed.select("scope", "moment", c("owner_id").alias("root"), c("sure").alias("root_sure")), ["scope", "moment", "root"], "left")
    return out.select("scope", "moment", "alias", "owner_id", "root", F.coalesce("sure", "root_sure", F.lit(False)).alias("confirmed"))


INTRODUCES = r"(?:我叫|我的名字是|名叫|自称)[“「『]?([一-鿿A-Za-z][一-鿿A-Za-z0-9·_-]{1,31})[”」』]?"  # fixed values: how one gives one's name


def provisional_edits(proposals: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits (scope, version, action, owner_id, alias, target) that proposed persons of a scene make once texts use them, for ``replayed``.

    `proposals` is (scope, name, aliases), `sources` is (scope, version, content).  A proposal is discovered, as a provisional owner, in the first source that
    holds its name or an alias.  Where a source gives a name by itself (``INTRODUCES``) while exactly one provisional owner of the scene waits, that one is
    it: merged into the owner of that name, who is confirmed, or only confirmed where the name is its own.  A second one that begins to wait before the first
    is known ends this for the scene, since nobody can tell which is meant.  Of one source, discoveries come first, by owner.  Versions are three times the source's, so that a
    merge comes after the discovery of its target.
    """
    owner = lambda prefix, name: F.concat(F.lit(prefix), c("scope").cast("string"), F.lit(":"), F.md5(F.lower(F.trim(name)).cast("binary")))
    bare = F.regexp_replace("name", "[的一名个穿着身]", "")  # fixed values: words of description, without which a name may stand
    said = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.length(bare) >= 2, F.array(bare)).otherwise(F.array().cast("array<string>")))
    known = proposals.where("name <> ''").select("scope", "name", F.explode(F.array_distinct(said)).alias("said")).where("said <> ''")
    met = sources.join(known, "scope").where(F.contains("content", "said")).groupBy("scope", "name").agg(F.min("version").alias("version"))
    met = met.select("scope", "version", F.lit(0).alias("kind"), owner("provisional:", c("name")).alias("owner_id"), "name")
    given = sources.select("scope", "version", F.trim(F.regexp_extract("content", INTRODUCES, 1)).alias("name")).where("name <> ''")
    given = given.select("scope", "version", F.lit(1).alias("kind"), owner("actor:", c("name")).alias("owner_id"), "name")
    by = Window.partitionBy("scope").orderBy("version", "kind", "owner_id")
    seen = met.unionByName(given).withColumn("before", F.lag("kind").over(by)).withColumns({"waiting": F.lag("owner_id").over(by), "called": F.lag("name").over(by)})
    seen = seen.withColumn("lost", F.max(F.coalesce((c("kind") == 0) & (c("before") == 0), F.lit(False))).over(by))
    found = seen.where("kind = 0").select("scope", (c("version") * 3).alias("version"), F.lit("discover").alias("action"), "owner_id", c("name").alias("alias"), F.lit(None).cast("string").alias("target"))
    knows = seen.where("kind = 1 and before = 0 and not lost")
    own = F.lower(F.trim("called")) == F.lower(F.trim("name"))
    edit = lambda n, action, of, alias, target: F.struct((c("version") * 3 + n).alias("version"), F.lit(action).alias("action"), of.alias("owner_id"), alias.cast("string").alias("alias"), target.cast("string").alias("target"))
    none = F.lit(None)
    other = F.array(edit(0, "discover", c("owner_id"), c("name"), none), edit(1, "confirm", c("owner_id"), none, none), edit(2, "merge", c("waiting"), none, c("owner_id")))
    same = F.array(edit(1, "confirm", c("waiting"), none, none))
    return found.unionByName(knows.select("scope", F.inline(F.when(own, same).otherwise(other))))


def prefetched(sources: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """(chat_key, kind, id, reference): what a chat's texts name of what is known, numbered within its kind, `most` at most.

    `known` is (chat_key, kind, id, names, place): a record is named if a text holds one of its names (none is empty), and comes by `place`, then id.
    References are the kind's first letter in upper case and a number of two digits or more.
    """
    names = known.select("chat_key", "kind", "id", "place", F.explode(F.array_distinct("names")).alias("name")).where("name <> ''")
    met = names.join(sources.select("chat_key", F.coalesce("content", F.lit("")).alias("content")), "chat_key").where(F.contains(F.lower("content"), F.lower("name")))
    once = met.groupBy("chat_key", "kind", "id").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("chat_key", "kind").orderBy("place", "id"))
    once = once.withColumn("rank", rank).where(c("rank") <= most)
    number = F.when(c("rank") < 10, F.concat(F.lit("0"), c("rank").cast("string"))).otherwise(c("rank").cast("string"))
    return once.select("chat_key", "kind", "id", F.concat(F.upper(F.substring("kind", 1, 1)), number).alias("reference"))
