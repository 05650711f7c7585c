"""Trie of the turns that conversations begin with, by the Euler-tour technique.

A node is a distinct sequence of first turns. Each node has an arc that enters
it and one that leaves it; the arcs in the order of a depth-first walk are a
linked list, built from siblings and parents without walking. Ranking that list
gives each arc its position and the sums of what lies before it, and a subtree's
sum is the difference between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import materialise, release, tasks
from larder.llm.listrank import FINISH, prefix_sums

#: Bits of the row number in monotonically_increasing_id, fixed by Spark.
ROW_BITS = 33
LOW = (1 << 32) - 1
#: Ids of ending conversations written as one piece of text.
PIECE = 16384
NODE = ["depth", "a", "b"]


def _in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` written in order of `by` over ranges of them, with `row`: the range and the place in it.

    Rows that are equal in all of `by` must be interchangeable. A key that many
    rows share is cut over ranges by the columns after it.
    """
    laid = rows.repartitionByRange(tasks(rows.sparkSession), *by).sortWithinPartitions(*by)
    return materialise(laid.withColumn("row", F.monotonically_increasing_id()), name)


def _range(row: str = "row") -> Column:
    return F.shiftright(row, ROW_BITS)


def _running(laid: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """`laid` (of `_in_order`, `group` first) with running sums within `group`.

    A window covers one range's part of a group; what the ranges before add is
    joined on. At most one group goes on from a range to the next, so there
    are fewer such rows than ranges, and they are broadcast.
    """
    rows = laid.withColumn("_range", _range())
    w = Window.partitionBy(group, "_range").orderBy("row")
    totals = rows.groupBy(group, "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (totals.select(group, "_range", F.count("*").over(earlier).alias("_k"), *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums))
              .where("_k > 0").drop("_k"))
    out = rows.select("*", *(F.sum(c).over(w).alias(n) for n, c in sums.items())).join(F.broadcast(before), [group, "_range"], "left")
    return out.select(*laid.columns, *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """`conversations(conv_id, turn, role, text)` -> (conv_id, place, digest, chars), place 1.. by turn.

    A null turn comes first; equal turns follow their digest. Null roles and
    texts are empty, rows without a conv_id belong to no conversation. The
    digest is SHA-256 over role and text; texts are moved no further.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    # The last key parts a range of equal rows; it follows the scan, so a task run again gives the same.
    laid = _in_order(rows.withColumn("_tie", F.monotonically_increasing_id()), ["conv_id", "turn", "digest", "_tie"], "turns")
    return _running(laid, "conv_id", {"place": F.lit(1).cast("long")}).select("conv_id", "place", "digest", "chars")


def shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of a common one: (their ids, their turns with columns order, place).

    Of conversation c come the first h turns of c - c % every (all if it has
    fewer, none if there is none) and then c's own after its first h, where
    h = crc32(c) % most.
    """
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    ids = turns.select("conv_id").distinct()
    own = turns.where((base == F.col("conv_id")) | (F.col("place") > h)).withColumn("order", F.lit(1))
    first = (turns.where((base == F.col("conv_id")) & (F.col("place") < most))
             .select(F.col("conv_id").alias("base"), "place", "digest", "chars"))
    given = (ids.where(base != F.col("conv_id")).withColumn("base", base).withColumn("h", h).join(first, "base")
             .where("place <= h").select("conv_id", "place", "digest", "chars", F.lit(0).alias("order")))
    return ids, own.unionByName(given)


def _keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars) and the node that the first `depth` turns lead to: (a, b), from (pa, pb).

    A node's key sums a 128-bit hash of (depth, digest) over its turns, so that
    it can be had from sums over ranges, however long a conversation is.
    """
    laid = _in_order(turns, ["conv_id", "order", "place"], "turns")
    deep = materialise(_running(laid, "conv_id", {"depth": F.lit(1).cast("long")})
                       .select("conv_id", "depth", "digest", "chars", "row"), "turns")
    release(laid)
    words = {f"s{k}": F.shiftright(F.xxhash64(F.lit(k // 2), "depth", "digest"), 32 * (k % 2)).bitwiseAND(LOW) for k in range(4)}
    summed = _running(deep, "conv_id", words).select("*", *(w.alias(f"t{n[1:]}") for n, w in words.items()))

    def pack(x: Column, y: Column) -> Column:
        return F.shiftleft(x.bitwiseAND(LOW), 32).bitwiseOR(y.bitwiseAND(LOW))

    s, p = [F.col(f"s{k}") for k in range(4)], [F.col(f"s{k}") - F.col(f"t{k}") for k in range(4)]
    return summed.select("conv_id", "depth", "digest", "chars", pack(s[0], s[1]).alias("a"), pack(s[2], s[3]).alias("b"),
                         pack(p[0], p[1]).alias("pa"), pack(p[2], p[3]).alias("pb"))


def _nodes(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node, the root's key being zeros. Fails if two sequences share a key."""
    one = [F.min(c) == F.max(c) for c in ("digest", "pa", "pb")]
    same = one[0] & one[1] & one[2]
    below = (rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
                                     F.max("pa").alias("pa"), F.max("pb").alias("pb"), same.alias("same"))
             .withColumn("chars", F.when(F.col("same"), F.col("chars")).otherwise(F.raise_error(F.lit("two sequences of turns share a key"))))
             .drop("same"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = (ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("chars"), none.alias("pa"), none.alias("pb")))
    return materialise(below.unionByName(root), "nodes")


def _digest_ends(ends: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id) -> (depth, a, b, ends_sha256) over the ids in order.

    Ranges of ids are joined to texts where they lie; a node's texts then go
    through one hash in order, as SHA-256 is sequential, a piece at a time.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = np.stack([b.column(c).to_numpy() for c in NODE]), b.column("conv_id")
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cuts = np.union1d(cuts, np.arange(0, b.num_rows, PIECE)).astype(int)
            texts = [",".join(map(str, ids.slice(s, e - s).to_pylist())) for s, e in zip(cuts, [*cuts[1:], b.num_rows])]
            yield pa.RecordBatch.from_arrays([pa.array(k[cuts]) for k in key] + [ids.take(pa.array(cuts)), pa.array(texts, pa.string())],
                                             names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for d, x, y, text in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (d, x, y) != now:
                    if sha:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (d, x, y), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield table(done)
        if sha:
            yield table([(*now, sha.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[k], pa.int64()) for k in range(3)] + [pa.array(cols[3], pa.string())],
                                          names=[*NODE, "ends_sha256"])

    n, schema = tasks(ends.sparkSession), "depth long, a long, b long, "
    laid = ends.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = laid.mapInArrow(join, schema + "first long, ids string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, schema + "ends_sha256 string")


def _tour(tree: DataFrame) -> DataFrame:
    """`tree(row, depth, a, b, pa, pb, saved)` in order of parent and conv_id -> its arcs, an Euler tour as a linked list.

    The arc that enters node `row` is 2 * row and the one that leaves it
    2 * row + 1. A sibling is the next row; where a range ends, the first of the
    next range, which is broadcast: a row for each range.
    """
    kids = (tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
            .agg(F.min("row").alias("first_kid"), F.max("row").alias("last_kid"), F.count("*").alias("n_children")))
    above = materialise(tree.select("row", *NODE).join(kids, NODE).select("row", "first_kid", "last_kid", "n_children"), "parents")
    ranges = tree.groupBy(_range().alias("_range")).agg(F.min("row").alias("_first"), F.max("row").alias("_last"))
    nexts = ranges.select(F.col("_last"), F.lead("_first").over(Window.orderBy("_range")).alias("_next"))  # a row for each range
    last = above.select(F.col("last_kid").alias("row"), F.col("row").alias("parent"))
    node = (tree.select("row", "saved").join(above.drop("last_kid"), "row", "left").join(last, "row", "left")
            .join(F.broadcast(nexts), F.col("row") == F.col("_last"), "left"))
    sibling = F.coalesce("_next", F.col("row") + 1)
    enter, leave = 2 * F.col("row"), 2 * F.col("row") + 1
    onward = F.when(F.col("parent").isNotNull(), 2 * F.col("parent") + 1).when(~F.col("root"), 2 * sibling)
    root = tree.where("depth = 0").select(F.col("row").alias("_root"))  # one row
    node = node.join(F.broadcast(root), F.col("row") == F.col("_root"), "left").withColumn("root", F.col("_root").isNotNull())
    zero, leaf = F.lit(0).cast("long"), F.col("n_children").isNull().cast("long")
    arcs = F.array(F.struct(enter.alias("id"), F.coalesce(2 * F.col("first_kid"), leave).alias("next"), leaf.alias("leaves"), F.col("saved").alias("saved")),
                   F.struct(leave.alias("id"), onward.alias("next"), zero.alias("leaves"), zero.alias("saved")))
    return node.select("n_children", F.explode(arcs).alias("x")).select("x.*", F.lit(1).cast("long").alias("position"), "n_children")


def prefix_trie(ids: DataFrame, turns: DataFrame, finish: int = FINISH) -> DataFrame:
    """The nodes of the trie over `turns(conv_id, order, place, digest, chars)` of the conversations `ids(conv_id)`.

    A row for each distinct sequence of first turns in order of (order, place),
    the empty one included: conv_id (the smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves and
    saved_tokens over the subtree, ends_sha256 over the ids of those that end
    here, and enter and leave, the arcs' positions in the tour. Conversations
    without turns end at the root; equal conversations share all nodes; without
    conversations there are no nodes.
    """
    ids = materialise(ids.distinct(), "conversations")
    rows = materialise(_keyed(turns), "turns")
    nodes = _nodes(ids, rows)
    # Many children may share a parent: both sides are plain tables, so that AQE can split the join.
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(parent, ["depth", "pa", "pb"], "left").withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    tree = _in_order(tree, ["depth", "pa", "pb", "conv_id"], "tree")
    arcs = materialise(_tour(tree), "arcs")
    sums = prefix_sums(arcs, ["position", "leaves", "saved"], finish)
    leaves = F.col("id").bitwiseAND(1) == 1
    spans = (sums.groupBy(F.shiftright("id", 1).alias("row"))
             .agg(F.max(F.when(~leaves, F.col("position"))).alias("enter"), F.max(F.when(leaves, F.col("position"))).alias("leave"),
                  *(F.sum(F.when(leaves, F.col(c)).otherwise(-F.col(c))).alias(n) for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens")))))
    kids = arcs.where("n_children is not null and id % 2 = 0").select(F.shiftright("id", 1).alias("row"), "n_children")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("x"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"x.{c}", zero).alias(c) for c in NODE))
    return (tree.join(spans, "row").join(kids, "row", "left").join(materialise(_digest_ends(ends), "ends"), NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "enter", "leave"))
