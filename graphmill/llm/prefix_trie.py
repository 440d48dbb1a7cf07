"""The trie of conversation prefixes, by ROLLUP over positional columns of turn ids.

A turn's id is the length of its text and a SHA-256 of its role and text.  A conversation is a row for each block of
WIDTH turns, with a column for each place: t1, t2, ...; `GROUP BY block, key, ROLLUP (t1, ..., t8)` then aggregates
every prefix at once, and grouping_id() says how long each is.  Further blocks of long conversations carry as `key` the
id of the node that the block before ends at.  These ids are digests of all blocks so far, found by a doubling scan: in
each round a block's digest is joined with that of the block 1, 2, 4, ... before it, so a conversation of many turns is
never one task's work.

Sums over subtrees are a second ROLLUP.  Each node counts once, at its smallest member: that conversation's row carries
what its own nodes from each place on add, so the sum over a prefix's members is the sum over its subtree.

The digest of a node's ends is sequential, so a node's ends pass one task, sorted and as a stream: of ids alone, and
none is kept.

Defined cases
    Turns go in order of turn (null first), role, then turn id; a null role or text is an empty one.  Repeated rows are
    turns each.  Rows without conv_id belong to no conversation.  A conversation without turns is a member of the root.
    Texts of any length count by their UTF-8 bytes.  An empty table gives no rows, not even a root.  Columns besides
    conv_id, turn, role and text are not read, whatever their names.  conv_id and turn are whole numbers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators.windows import running_sum
from graphmill.workspace import checkpointed

#: Turns in a block of columns.
WIDTH = 8
#: Values of `turn`, and blocks, that are counted together within a conversation.
CELL = 4096
#: A rebuilt conversation takes fewer than so many turns of another.
HEADS = 9


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_id: bytes of the text, a dash and a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"), 256)
    ids = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("at"),
        role.alias("role"),
        F.concat_ws("-", F.octet_length(text).cast("string"), digest).alias("turn_id"),
        F.lit(1).cast("long").alias("one"),
    )
    digest_only = F.substring_index("turn_id", "-", -1)
    placed = running_sum(ids.withColumn("digest", digest_only), ["conv_id"], "at", ["at", "role", "digest"], "one", CELL)
    return placed.select("conv_id", F.col("running").alias("place"), "turn_id")


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, turns, place, turn_id of rebuilt conversations.

    Conversation c is the first h turns of conversation c - c % 5 and its own from h + 1 on; h = crc32(c) % 9.  One
    without turns has one row, with a null place.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": h}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    heads = placed.where(f"conv_id % 5 = 0 AND place < {HEADS}").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("place <= k").select("conv_id", "turns", "place", "turn_id")
    rest = placed.where(F.col("place") > h).join(convs, "conv_id").select("conv_id", "turns", F.expr("k + place - h").alias("place"), "turn_id")
    none = convs.where("turns = 0").select("conv_id", "turns", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("turn_id"))
    return heads.unionByName(rest).unionByName(none)


def _digest(*parts) -> Column:
    return F.sha2(F.concat_ws(",", *parts).cast("binary"), 256)


def blocks(rows: DataFrame, width: int = WIDTH) -> tuple[DataFrame, int]:
    """A row for each conversation and block: conv_id, turns, block, key, own, t1 ... tn; and the last block's number.

    own: the id of the node that a full block ends at; the next block has it as key.  The first block's key is empty.
    """
    place = F.coalesce(F.col("place") - 1, F.lit(0))
    names = [f"t{i + 1}" for i in range(width)]
    marked = rows.withColumns({"block": F.floor(place / width), "at": place % width})
    wide = marked.groupBy("conv_id", "block").agg(F.max("turns").alias("turns"), *(F.max(F.when(F.col("at") == i, F.col("turn_id"))).alias(t) for i, t in enumerate(names)))
    wide = checkpointed(wide)
    last = wide.agg(F.max("block")).first()[0] or 0
    ids = wide.where(F.col(names[-1]).isNotNull()).select("conv_id", "block", _digest(*names).alias("own"))
    step = 1
    while step <= last:
        before = ids.select("conv_id", (F.col("block") + step).alias("block"), F.col("own").alias("before"))
        joined = ids.join(before, ["conv_id", "block"], "left")
        ids = checkpointed(joined.select("conv_id", "block", F.when(F.col("before").isNull(), F.col("own")).otherwise(_digest("before", "own")).alias("own")))
        step *= 2
    if last == 0:
        return wide.withColumns({"key": F.lit(""), "own": F.when(F.col(names[-1]).isNotNull(), _digest(*names))}), 0
    keys = ids.select("conv_id", (F.col("block") + 1).alias("block"), F.col("own").alias("key"))
    out = wide.join(ids, ["conv_id", "block"], "left").join(keys, ["conv_id", "block"], "left").withColumn("key", F.coalesce("key", F.lit("")))
    return checkpointed(out), int(last)


def _node(level: Column, width: int) -> Column:
    """Id of the node at a level (0 to width) of a block."""
    out = F.when(level == 0, F.col("key")).when(level == width, F.col("own"))
    for d in range(1, width):
        out = out.when(level == d, _digest("key", *(f"t{i}" for i in range(1, d + 1))))
    return out


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """A row for each prefix within a block: block, key, own, level, t1 ... tn (null beyond the level), and aggregates."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    out = rows.sparkSession.sql(
        f"SELECT block, key, {names}, {width} - bit_count(grouping_id()) AS level, max(own) AS own, {aggregates} FROM {{rows}} GROUP BY block, key, ROLLUP ({names})",
        rows=rows,
    )
    # A shorter conversation is grouped at the levels beyond its end, too; a later block's level 0 is the former's last.
    there = F.when(F.col("level") == 0, F.col("block") == 0)
    for d in range(1, width + 1):
        there = there.when(F.col("level") == d, F.col(f"t{d}").isNotNull())
    return out.where(there)


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """node_id, ends_sha256 of the nodes at which conversations end."""
    last = F.floor(F.greatest(F.col("turns") - 1, F.lit(0)) / width)
    ends = rows.where(F.col("block") == last).select(_node(F.col("turns") - F.col("block") * width, width).alias("node_id"), "conv_id")

    def run(batches):
        node, digest = None, None
        for batch in batches:
            nodes, convs = batch.column("node_id").to_pylist(), batch.column("conv_id").to_pylist()
            done = []
            for i, (at, conv) in enumerate(zip(nodes, convs)):
                if at == node:
                    digest.update(b",%d" % conv)
                    continue
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = at, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], ["node_id", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (node, digest.hexdigest())], ["node_id", "ends_sha256"])

    return ends.repartition("node_id").sortWithinPartitions("node_id", "conv_id").mapInArrow(run, "node_id string, ends_sha256 string")


def _after(wide: DataFrame, own: DataFrame) -> DataFrame:
    """leaf_after, saved_after, new_after of each conversation and block: what its later blocks add, and the next one's first turn."""
    sums = wide.select("conv_id", "block", (-F.col("block")).alias("back")).join(own.select("conv_id", "block", "leaf1", "saved1"), ["conv_id", "block"], "left").na.fill(0)
    for x in ("leaf", "saved"):
        sums = running_sum(sums, ["conv_id"], "back", ["back"], f"{x}1", CELL).withColumn(f"{x}_after", F.col("running") - F.col(f"{x}1")).drop("running")
    nexts = own.select("conv_id", (F.col("block") - 1).alias("block"), F.col("new1").alias("new_after"))
    return sums.join(nexts, ["conv_id", "block"], "left").na.fill(0).select("conv_id", "block", "leaf_after", "saved_after", "new_after")


def trie(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    rows: conv_id, turns, place, turn_id of conversations, as rebuilt() gives them.
    """
    wide, last = blocks(rows, width)
    levels = range(width + 1)
    first = _rollup(wide, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(turns) AS longest")
    bytes_ = F.lit(0).cast("long")
    for d in range(1, width + 1):
        bytes_ = F.when(F.col("level") == d, F.substring_index(f"t{d}", "-", 1).cast("long")).otherwise(bytes_)
    single = first.select("conv_id", "block", "level", (F.col("longest") == F.col("block") * width + F.col("level")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * bytes_).alias("saved"))
    own = checkpointed(
        single.groupBy("conv_id", "block").agg(
            *(F.sum(F.when(F.col("level") >= d, F.col(x))).alias(f"{x}{d}") for x in ("leaf", "saved") for d in levels),
            *(F.count(F.when(F.col("level") == d, 1)).alias(f"new{d}") for d in range(1, width + 1)),
        )
    )
    added = wide.join(own, ["conv_id", "block"], "left").na.fill(0)
    if last:
        added = added.join(_after(wide, own), ["conv_id", "block"])
    else:
        added = added.withColumns({x: F.lit(0).cast("long") for x in ("leaf_after", "saved_after", "new_after")})
    sums = [f"sum({x}{d} + {x}_after) AS {x}{d}" for x in ("leaf", "saved") for d in levels] + [f"sum(new{d}) AS new{d}" for d in range(1, width + 1)] + ["sum(new_after) AS new_after"]
    second = _rollup(added, width, "min(conv_id) AS conv_id, count(*) AS n_convs, " + ", ".join(sums))

    def at_level(name: str, shift: int = 0) -> Column:
        out = F.lit(None).cast("long")
        for d in levels:
            column = "new_after" if name == "new" and d == width else f"{name}{d + shift}"
            out = F.when(F.col("level") == d, F.col(column)).otherwise(out)
        return out

    nodes = checkpointed(
        second.select(
            _node(F.col("level"), width).alias("node_id"),
            F.when(F.col("level") > 0, _node(F.col("level") - 1, width)).alias("parent_id"),
            "conv_id",
            (F.col("block") * width + F.col("level")).alias("depth"),
            "n_convs",
            at_level("new", 1).alias("n_children"),
            at_level("leaf").alias("n_leaves"),
            at_level("saved").alias("saved_tokens"),
        )
    )
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent_id", "left").join(_ends(wide, width), "node_id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
