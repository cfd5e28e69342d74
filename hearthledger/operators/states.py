"""Variable states of chats: JSON patches folded in order, and the leaves of JSON values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
OPERATIONS = ["add", "replace", "remove"]  # fixed values
LEAVES = "array<struct<path: array<string>, value: string>>"
PATCH = "array<struct<op: string, path: string, value: variant>>"


def _leaves_of(texts: pd.Series) -> pd.Series:
    """Scalars inside JSON texts with the keys and places that lead to them; containers without any are leaves of their own."""
    import json

    def walk(text: str | None) -> Iterator[dict]:
        try:
            todo = [] if text is None else [([], json.loads(text))]
        except ValueError:
            todo = []
        while todo:
            path, value = todo.pop()
            inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
            if inner:
                todo.extend(([*path, str(k)], v) for k, v in reversed(inner))
            else:
                yield {"path": path, "value": value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))}

    return texts.map(lambda t: list(walk(t)))


def leaves(text: Column) -> Column:
    """Array of (path, value) of a JSON text, at any depth; empty where the text is null or no JSON.

    Depth isn't known to a plan, so one Arrow function walks each value; the usual state has a few dozen leaves.
    """
    return F.pandas_udf(_leaves_of, LEAVES)(text)


def operations(messages: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """(key, *order, place, op, path, value): operations that patches hold, in order; `path` as keys, `value` as JSON text.

    A patch is a JSON array of {op, path, value}.  Other JSON, broken texts, unknown operations and paths that don't begin with a
    slash are left out; ~1 and ~0 in a key stand for / and ~.
    """
    parsed = messages.select(key, *order, F.posexplode(F.from_json(text, PATCH)).alias("place", "o"))
    keys = F.transform(F.filter(F.split("o.path", "/"), lambda x: x != ""), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    some = parsed.select(key, *order, "place", F.lower("o.op").alias("op"), keys.alias("path"), F.to_json("o.value").alias("value"), F.startswith("o.path", F.lit("/")).alias("rooted"))
    return some.where(c("op").isin(OPERATIONS) & c("rooted") & (F.size("path") > 0)).drop("rooted")


def folded(ops: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, path, value): the leaves of each chat's state after all its operations, in order of `order` and place.

    An operation replaces whatever lies at its path or below, and makes way for itself where a scalar stood above.  So a
    leaf stands if no later operation has its path or one above it, and no later one sets anything below it.  Both are the
    last operation of a path, one row a (chat, path), met by an equi-join on the leaf's paths: no task folds a whole chat.
    """
    at = F.struct(*order, "place")
    ops = ops.select(key, "op", "path", "value", at.alias("at"))
    sets = ops.where("op <> 'remove'")
    rows = sets.select(key, "at", "path", F.explode(leaves(c("value"))).alias("leaf")).select(key, "at", F.concat("path", "leaf.path").alias("path"), "leaf.value")
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.slice(p, 1, n))
    last = ops.groupBy(key, c("path").alias("prefix")).agg(F.max("at").alias("last"))
    under = sets.select(key, "at", F.explode(F.slice(above("path"), 1, F.size("path") - 1)).alias("path")).groupBy(key, "path").agg(F.max("at").alias("inside"))
    # A leaf is as deep as the operation that set it, or deeper: paths above it count once each.
    met = rows.withColumn("prefix", F.explode(above("path"))).join(last, [key, "prefix"], "left").groupBy(key, "path", "at", "value").agg(F.max("last").alias("last"))
    stands = met.where(c("last") <= c("at")).join(under, [key, "path"], "left").where(c("inside").isNull() | (c("inside") < c("at")))
    return stands.select(key, "path", "value")


def canonical(text: Column) -> Column:
    """A JSON text in one form: keys in order, without white space; null where it is null or no JSON.  Equal values have equal forms, whatever the order of their keys."""
    return F.to_json(F.try_parse_json(text))


def revisions(states: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, same, revision): whether a state says what the one before it in its chat says, and how many different ones came so far.

    The first state is revision 1; a text that is no JSON is a state of its own kind, the same as another such one.
    """
    by = Window.partitionBy(key).orderBy(order)
    rows = states.select(key, order, canonical(c(text)).alias("form")).withColumns({"before": F.lag("form").over(by), "first": F.row_number().over(by) == 1})
    same = ~c("first") & c("form").eqNullSafe(c("before"))
    return rows.withColumn("same", same).select(key, order, "same", F.sum((~same).cast("long")).over(by).alias("revision"))
