"""A trie of conversations by their common first turns, with totals of subtrees by leaf-peeling message passing.

A node is a distinct sequence of first turns.  It is known by its depth and two 64-bit numbers, each the exclusive-or over its turns of a hash
of place, role and text, so a prefix's key is a running aggregate and no text is kept along.  Nodes are made by one grouping of all
turns by that key, which combines before the shuffle, so a first turn that a third of all conversations share is one row of each map task.

Totals go up by message passing: each node holds how many children haven't answered.  A node with none left is complete and
sends its subtree's leaves and saved tokens to its parent, in one grouping of messages by parent for each round, until only roots
finish.  A run of nodes with one child each is passed in one round (:func:`chains`): rounds follow
the branchings on a path, not its turns.

No conversation and no node is ever one group in one task: turns are numbered by a sort over ranges of (conversation, turn, role, text),
running aggregates are by (conversation, range) with what the ranges before add up to, for which there are at most as many rows as
ranges, and a node's ids are digested from chunks of ``CHUNK`` consecutive ids, streamed in order.

Defined results: rows are ordered by turn (null first), then role, then text, repeated rows are turns of their own; null role or
text is empty; rows without conv_id belong to no conversation and are left out; extra columns are left out; without conversations there are
no nodes; a conversation without turns (or all of whose turns are given away) ends at the root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import Scratch, written

CHUNK = 256
GROUP, HEADS = 100, 6
#: Depths for each block of a chain.
BLOCK = 1024
NODE, PARENT = ("depth", "k1", "k2"), ("up", "p1", "p2")


def zero() -> Column:
    return F.lit(0).cast("bigint")


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every turn as (conv_id, part, pos, k1, k2, chars), pos from 1, and every conversation's (conv_id, n, part).

    part is the range of the sort that a row lies in; the sort's last key tells equal rows apart, so they can be dealt out.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    both = F.struct("role", "text")
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(1), both).alias("k1"), F.xxhash64(F.lit(2), both).alias("k2"), F.length("text").cast("bigint").alias("chars"))
    rows = scratch.written(rows, "turns")
    pieces = scratch.written(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "pieces")
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("part").alias("part"), F.count("*").alias("pieces"))
    # where a conversation goes on in another range: one row for each range at most, so it may be broadcast
    split = convs.where("pieces > 1").select("conv_id")
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.join(split, "conv_id", "left_semi").withColumn("before", F.sum("n").over(w)).where("before is not null").select("conv_id", "part", "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("row"))
    turns = rows.withColumn("place", place).join(F.broadcast(before), ["conv_id", "part"], "left")
    return turns.select("conv_id", "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "chars"), convs.select("conv_id", "n", "part")


def heads(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as rebuilt (with depth in place of pos), and the conversations with their number of rebuilt turns, ``total``."""
    convs = convs.withColumn("h", heads(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))).cast("bigint"))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(convs.where(F.col("n") > F.col("h")).select("conv_id", "h", "taken", "total"), "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", "part", "total", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "k1", "k2", "chars")
    # a group's first conversation gives less than HEADS turns to at most 2 * GROUP others
    given = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "chars")
    first = convs.where("taken > 0").select("conv_id", "part", "total", "base", "taken").join(given, "base").where("pos <= taken")
    return own.unionByName(first.select("conv_id", "part", "total", F.col("pos").alias("depth"), "k1", "k2", "chars")), convs.select("conv_id", "total")


def prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, total, depth, the node's key (k1, k2), its parent's (p1, p2), and the last text's code points."""
    rows = rows.select("conv_id", "part", "total", "depth", F.xxhash64("depth", "k1").alias("t1"), F.xxhash64("depth", "k2").alias("t2"), "chars")
    rows = scratch.written(rows, "rebuilt")
    pieces = rows.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    split = pieces.groupBy("conv_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("conv_id")
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # again one row for each range of the sort at most
    carried = pieces.join(split, "conv_id", "left_semi").select("conv_id", "part", F.bit_xor("x1").over(w).alias("x1"), F.bit_xor("x2").over(w).alias("x2")).where("x1 is not null")
    local = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("y1", F.bit_xor("t1").over(local)).withColumn("y2", F.bit_xor("t2").over(local)).join(F.broadcast(carried), ["conv_id", "part"], "left")
    out = out.withColumns({f"k{i}": F.col(f"y{i}").bitwiseXOR(F.coalesce(f"x{i}", zero())) for i in (1, 2)})
    return out.select("conv_id", "total", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "chars")


def nodes(rows: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each node: key, parent's key, conv_id, n_convs, n_children, ``own`` (tokens saved by the node itself) and ``reach``,
    its longest conversation as (turns, -id)."""
    root = convs.select("conv_id", "total", *[zero().alias(c) for c in (*NODE, *PARENT[1:], "chars")])
    made = rows.unionByName(root).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.max("chars")).alias("own"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.max(F.struct("total", (-F.col("conv_id")).alias("id"))).alias("reach"),
    )
    made = scratch.written(made.withColumn("up", F.col("depth") - 1), "nodes")
    children = made.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    children = children.select(*[F.col(a).alias(b) for a, b in zip(PARENT, NODE, strict=True)], "n_children")
    return scratch.written(made.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", zero())), "counted")


def chains(made: DataFrame) -> DataFrame:
    """nodes with ``end``, the depth of the first node at or below with no child or several, down a run of single children, and
    ``run``, the tokens saved by the nodes from this one to that end, the end left out.

    All nodes of a run have the longest conversation of its end, so a run lies in one ``reach``.  Blocks of ``BLOCK`` depths of a
    reach are summed by themselves, from the deepest node up, and only one row for each block meets the others.
    """
    made = made.withColumn("block", F.floor(F.col("depth") / BLOCK))
    up = Window.partitionBy("reach", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    local = made.withColumn("sum", F.sum("own").over(up))
    local = local.withColumn("stop", F.last(F.when(F.col("n_children") != 1, F.struct(F.col("depth").alias("end"), "sum")), True).over(up))
    blocks = local.groupBy("reach", "block").agg(F.sum("own").alias("total"), F.min("stop").alias("high"))  # the highest end has the least depth
    before = Window.partitionBy("reach").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("below", F.coalesce(F.sum("total").over(before), zero()))
    blocks = blocks.withColumn("next", F.last(F.when(F.col("high").isNotNull(), F.struct("high.end", (F.col("high.sum") + F.col("below")).alias("sum"))), True).over(before))
    both = local.join(blocks.where("next is not null").select("reach", "block", "below", "next"), ["reach", "block"], "left")
    below = F.coalesce("below", zero())
    out = both.withColumn("to", F.when(F.col("stop").isNotNull(), F.struct("stop.end", (F.col("stop.sum") + below).alias("sum"))).otherwise(F.col("next")))
    return out.select(*[c for c in made.columns if c != "block"], F.col("to.end").alias("end"), (F.col("sum") + below - F.col("to.sum")).alias("run"))


def peel(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves and saved of every run's end, for runs (key of the end, n_children, own, above, parent's key).

    Each round, the ends completed in the last one send (leaves, saved) to their parents; a parent counts its messages and is
    completed by the last.  Rounds are written, so a lost executor costs a re-read.
    """
    first = runs.select(*NODE, *PARENT, "own", "above", F.col("n_children").alias("left"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), F.col("own").alias("saved"))
    rounds = [scratch.written(first, "round")]
    while True:
        now = rounds[-1]
        waiting = now.where("left > 0")
        if waiting.isEmpty():
            break
        sent = now.where("left = 0 and depth >= 0 and up >= 0").groupBy(*PARENT).agg(F.count("*").alias("n"), F.sum("leaves").alias("add_leaves"), F.sum(F.col("saved") + F.col("above")).alias("add_saved"))
        sent = sent.select(*[F.col(a).alias(b) for a, b in zip(PARENT, NODE, strict=True)], "n", "add_leaves", "add_saved")
        heard = waiting.join(sent, list(NODE), "left")
        plus = lambda c, d: (F.col(c) + F.coalesce(d, zero())).alias(c)
        rounds.append(scratch.written(heard.select(*NODE, *PARENT, "own", "above", (F.col("left") - F.coalesce("n", zero())).alias("left"), plus("leaves", "add_leaves"), plus("saved", "add_saved")), "round"))
        if len(rounds) % 40 == 0:  # else a plan of very many branches
            rounds = [scratch.written(reduce(DataFrame.unionByName, [*(r.where("left = 0") for r in rounds[:-1])]), "completed"), rounds[-1]]
    return reduce(DataFrame.unionByName, [r.where("left = 0") for r in rounds]).select(*NODE, "leaves", "saved")


def digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """ends_sha256 of every node that a conversation ends at: ids in chunks, each put in order by itself, streamed to the digest."""
    last = rows.where("depth = total").select(*NODE, "conv_id")
    none = convs.where("total = 0").select(*[zero().alias(c) for c in NODE], "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = last.unionByName(none).groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def digest(batches):
        at, h = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
            done, hexes = [], []
            for key, text in zip(keys, batch.column("ids").to_pylist(), strict=True):
                if key == at:
                    h.update(b"," + text.encode())
                else:
                    if at is not None:
                        done.append(at)
                        hexes.append(h.hexdigest())
                    at, h = key, hashlib.sha256(text.encode())
            yield _digested(done, hexes)
        if at is not None:
            yield _digested([at], [h.hexdigest()])

    return chunks.mapInArrow(digest, f"{', '.join(f'{c} bigint' for c in NODE)}, ends_sha256 string")


def _digested(keys: list, hexes: list) -> pa.RecordBatch:
    columns = zip(*keys, strict=True) if keys else ((), (), ())
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns), pa.array(hexes, pa.string())], [*NODE, "ends_sha256"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    scratch = Scratch(conversations.sparkSession, "conversation-trie")
    turns, convs = rebuilt(*numbered_turns(conversations, scratch))
    convs = scratch.written(convs, "conversations")
    rows = scratch.written(prefixes(turns, scratch), "prefixes")
    made = scratch.written(chains(nodes(rows, convs, scratch)), "chains")
    top = F.min_by(F.struct(*PARENT), "depth")
    end = F.max_by(F.struct(*NODE, "n_children", "own"), "depth")
    runs = made.groupBy("reach", "end").agg(top.alias("top"), end.alias("low"), F.max("run").alias("above"))
    runs = scratch.written(runs.select("reach", "end", "low.*", "above", "top.*"), "runs")
    totals = runs.select("reach", "end", *NODE).join(peel(runs, scratch), list(NODE)).select("reach", "end", "leaves", "saved")
    parents = made.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(a).alias(b) for a, b in zip(NODE, PARENT, strict=True)])
    out = made.join(totals, ["reach", "end"]).join(parents, list(PARENT), "left").join(digests(rows, convs), list(NODE), "left")
    none = F.lit(hashlib.sha256().hexdigest())
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("run")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    out = written(out, "trie")
    scratch.drop()
    return out


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
