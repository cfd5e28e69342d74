"""Prefix trie of conversations: every distinct sequence of first turns is a node.

1. Turns are sorted by conversation and place in one range-partitioned sort; a conversation that lies over several partitions gets the
   counts of the earlier ones added (fewer rows than partitions, hence broadcast).  Texts stay behind here: two
   64-bit hashes and the number of bytes stand for a turn.
2. A node's key is its depth and, twice, the exclusive or of its turns' hashes with their depths, a running aggregate along each
   conversation (in blocks of ``BLOCK`` turns, whose totals are summed up apart, so that no task sorts a whole long conversation).
3. Partitions combine their own nodes first.  Tables are then merged ``WIDTHS[0]`` to one and so on, each level keyed by the node's hash
   and a slot: members are added, smallest members kept, lists of ended conversations joined.  Lists are cut into ranges of
   ``IDS`` ids, so that a row holds so many at most, however many conversations end at a node.
4. Every conversation owns the nodes of which it is the smallest member: the end of its path.  What a node's subtree
   sums up is its own path's part below it, rolled up from the end to the top, and the whole of all other owners' paths that pass it;
   the latter are again merged by key.  This takes as many jobs for a trie of thousands of levels as for one of three.

Defined cases: rows with null conv_id are dropped; null role and text are empty; a null turn comes first; turns of equal number
are ordered by role, then text; repeated rows are turns of their own; an empty table gives an empty table (no root);
extra columns are ignored.  Different turns share a key with probability 2**-128 a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAMILY, HEADS = 5, 9  # of ``rebuilt``
BLOCK = 4096
IDS = 1 << 16
WIDTHS = (16, 1)
NODE = ["depth", "k1", "k2"]


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position from 1, t1, t2, bytes) of every turn."""
    d = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    d = d.where("conv_id is not null").orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    # The separators tell (ab, c) from (a, bc).
    d = d.select("conv_id", F.xxhash64("role", F.lit(0), "text").alias("t1"), F.xxhash64(F.lit(1), "text", F.lit(2), "role").alias("t2"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    d = written(d, "turns").withColumn("part", F.shiftright("at", 33))
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = d.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(so_far)).where("before > 0").drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    d = d.withColumn("place", place).join(F.broadcast(earlier), ["conv_id", "part"], "left")
    return d.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("position"), "t1", "t2", "bytes")


def rebuilt(lines: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths): conversations whose first h turns come from the first one of their family, h by a checksum of the id.

    ``steps`` is (conv_id, depth, t1, t2, bytes, ends), ``lengths`` is (conv_id, length), turnless conversations included.
    """
    sizes = lines.groupBy("conv_id").agg(F.count("*").alias("turns"))
    own = sizes.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head"))
    own = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("there")), "base", "left")
    own = own.withColumn("taken", F.least("head", F.coalesce("there", F.lit(0)).cast("long"))).withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0)))
    own = written(own.select("conv_id", "base", "head", "taken", "length"), "rebuilt")
    step = lambda depth: [depth.alias("depth"), "t1", "t2", "bytes", (depth == F.col("length")).alias("ends")]
    first = lines.where(F.col("position") < heads).withColumnRenamed("conv_id", "base").join(own, "base").where(F.col("position") <= F.col("taken"))
    rest = lines.join(own, "conv_id").where(F.col("position") > F.col("head"))
    steps = first.select("conv_id", *step(F.col("position"))).unionByName(rest.select("conv_id", *step(F.col("position") - F.col("head") + F.col("taken"))))
    return steps, own.select("conv_id", "length")


def as_spoken(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) of conversations as they are."""
    lengths = lines.groupBy("conv_id").agg(F.count("*").alias("length"))
    steps = lines.join(lengths, "conv_id").select("conv_id", F.col("position").alias("depth"), "t1", "t2", "bytes", (F.col("position") == F.col("length")).alias("ends"))
    return steps, lengths


def running(df: DataFrame, columns: dict[str, str], fold: Callable[[str], Column], both: Callable[[Column, Column], Column], down: bool = False) -> DataFrame:
    """Adds to each row the fold of `columns` over its conversation's rows up to its depth (`down`: from it on)."""
    block = F.floor((F.col("depth") - 1) / F.lit(BLOCK))
    df = df.withColumn("block", -block if down else block)
    order = F.desc("depth") if down else F.asc("depth")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("conv_id", "block").agg(*(fold(c).alias(c) for c in columns))
    totals = totals.select("conv_id", "block", *(fold(c).over(before).alias(f"{new}_before") for c, new in columns.items())).where(F.col(f"{next(iter(columns.values()))}_before").isNotNull())
    inside = Window.partitionBy("conv_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({new: fold(c).over(inside) for c, new in columns.items()}).join(totals, ["conv_id", "block"], "left")
    return df.withColumns({new: both(F.col(new), F.coalesce(f"{new}_before", F.lit(0))) for new in columns.values()}).drop("block", *(f"{new}_before" for new in columns.values()))


def merged(tables: DataFrame, keys: list[str], folds: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Merges rows of a key level by level: a level adds up all that share key and slot, and the next has fewer slots."""
    tables = tables.withColumn("slot", F.pmod(F.xxhash64("conv_id"), F.lit(WIDTHS[0])).cast("int"))
    for width in WIDTHS:
        tables = tables.groupBy(*keys, (F.col("slot") % width).alias("slot")).agg(*(f(c).alias(c) for c, f in folds.items()))
    return tables.drop("slot")


def paths(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, ends): every node that a conversation passes, the root included, with its parent's key."""
    d = steps.withColumn("z1", F.xxhash64("depth", "t1", "t2")).withColumn("z2", F.xxhash64("t2", "depth", F.lit(3), "t1"))
    d = running(d, {"z1": "k1", "z2": "k2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    d = d.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "bytes", "ends")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return d.unionByName(root)


def trie(steps: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends).

    ``nodes``: depth, k1, k2 (a node's key), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves and saved (the last two
    of the whole subtree).  ``ends``: depth, k1, k2, block, ids: the conversations that end at a node, ascending, IDS ids' range a block.
    """
    passed = written(paths(steps, lengths), "paths")
    nodes = merged(passed.withColumn("n_convs", F.lit(1).cast("long")), NODE, {"conv_id": F.min, "p1": F.min, "p2": F.min, "bytes": F.max, "n_convs": F.sum})
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("worth", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = written(running(nodes, {"worth": "below", "leaf": "leaves"}, F.sum, lambda a, b: a + b, down=True), "rolled")
    owners = nodes.groupBy("conv_id").agg(F.sum("worth").alias("saved"), F.sum("leaf").alias("n_leaves"), F.min("depth").alias("top"))
    others = passed.select("conv_id", *NODE).join(owners, "conv_id").where("depth < top")
    others = merged(others, NODE, {"saved": F.sum, "n_leaves": F.sum})
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(others, NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    whole = whole.select(
        *NODE, "conv_id", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"), (F.col("below") + F.coalesce("saved", F.lit(0))).alias("saved"),
    )
    ended = passed.where("ends").select(*NODE, "conv_id", F.floor(F.col("conv_id") / F.lit(IDS)).alias("block"), F.array("conv_id").alias("ids"))
    ends = merged(ended, [*NODE, "block"], {"ids": lambda c: F.flatten(F.collect_list(c))})
    return whole, ends.withColumn("ids", F.sort_array("ids"))


def labelled(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (null at the root), for conversations as they are (``as_spoken``) of consecutive numbers from 0."""
    said = turns.select("conv_id", (F.col("turn") + 1).alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256).  A node's blocks stream through one task, a row for each range of IDS ids: SHA-256 is a chain."""

    def go(batches):
        import hashlib

        import pyarrow as pa

        key, held = None, None
        for batch in batches:
            out = []
            for *node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if node != key:
                    if key is not None:
                        out.append((*key, held.hexdigest()))
                    key, held = node, hashlib.sha256(text.encode())
                else:
                    held.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, held.hexdigest())], names=[*NODE, "ends_sha256"])

    lists = ends.select(*NODE, "block", F.array_join("ids", ",").alias("listed"))  # ids are long: joined as decimals
    sorted_ = lists.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "listed")
    return sorted_.mapInArrow(go, "depth long, k1 long, k2 long, ends_sha256 string")


def digest(turns: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations."""
    nodes, ends = trie(*rebuilt(numbered(turns)))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(end_hashes(ends), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


ORACLE_SQL = f"""with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end)) as t),
seqs as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as seq from conversations where conv_id is not null group by conv_id),
heads as (select seqs.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % {HEADS} as h from seqs, crc),
whole as materialized (select a.conv_id, case when b.conv_id is null then [] else b.seq[1:a.h] end || a.seq[a.h + 1:] as seq from heads a left join seqs b on b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
nodes as materialized (select d, seq[1:d] as prefix, min(conv_id) as conv_id, count(*) as n_convs,
 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(seq) = d), '')) as ends_sha256 from (select *, unnest(range(len(seq) + 1)) as d from whole) group by all),
child as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n from nodes where d > 0 group by all),
full_ as materialized (select nodes.*, coalesce(n, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * strlen(prefix[d].t) end as worth from nodes left join child using (d, prefix)),
up as (select u.d, u.prefix, sum(v.worth)::bigint as saved_tokens, count(*) filter (where v.n_children = 0) as n_leaves from full_ u join full_ v on v.d >= u.d and v.prefix[1:u.d] = u.prefix group by all)
select f.conv_id, f.d as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_ f join up using (d, prefix) left join nodes p on p.d = f.d - 1 and p.prefix = f.prefix[1:f.d - 1]"""
