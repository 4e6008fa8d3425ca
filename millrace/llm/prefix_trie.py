"""Prefix trie of conversations, with sums over subtrees by pointer jumping.

A node is a distinct sequence of the first d turns of some conversation. It is named by a 128-bit digest: the sum,
modulo 2**64 in two lanes, of hashes of (depth, turn). The digest of a prefix is a running sum, so it needs no walk along a
conversation, and a parent's digest is the node's less its last term. Rows travel as numbers; no text is shuffled.

Rows are ordered by a range partitioning over (conversation, turn), which may cut a long conversation: places and running
sums are told within a partition, and what a conversation brings from the partitions before is one row a partition.

Sums over subtrees take log2(depth) rounds: in round k every node with an ancestor 2**k above hands it what it has summed
so far (its descendants less than 2**k below), takes in what others hand to it, and jumps to that ancestor's own ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Own turns that a rebuilt conversation can take from another: fewer than this.
CUTS = 6


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, by: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows (conv_id, by, sums: longs; conv_id not null) with place (from 0 in its conversation, ordered by by); each of sums is a running total, modulo 2**64."""
    spark, names = rows.sparkSession, rows.columns
    at_key, at_sums = names.index("conv_id"), [names.index(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, before, carry, first = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * len(sums), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at_key).to_numpy()
            index = np.arange(len(keys))
            new = np.concatenate([[keys[0] != key if key is not None else True], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(new, index, -1))  # -1: goes on from the batch before
            place = np.where(start < 0, before + index, index - start)
            columns = [*batch.columns]
            for j, c in enumerate(at_sums):
                upto = np.concatenate([[np.uint64(0)], np.cumsum(batch.column(c).to_numpy().view(np.uint64))])
                total = upto[1:] - upto[np.maximum(start, 0)] + np.where(start < 0, carry[j], np.uint64(0))
                columns[c] = pa.array(total.view(np.int64))
                carry[j] = total[-1]
            first = keys[0] if first is None else first
            key, before = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(np.full(len(keys), part)), pa.array(keys == first)], [*names, "place", "part", "at_head"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    # Another number of rows a partition only moves the cuts; the bounds are drawn once, in the driver.
    dealt = rows.repartitionByRange(partitions(rows), "conv_id", *by).sortWithinPartitions("conv_id", *by)
    table = common.materialize(dealt.mapInArrow(run, f"{fields}, place long, part long, at_head boolean"), "placed")
    heads = table.where("at_head").select("conv_id").distinct()  # one conversation a partition at most
    own = table.join(F.broadcast(heads), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"), *[F.max_by(s, "place").alias(s) for s in sums])
    offsets, so_far = [], {}
    for r in own.orderBy("conv_id", "part").collect():  # rows: twice the number of partitions at most
        n, *totals = so_far.get(r.conv_id, (0, *[0] * len(sums)))
        if n:
            offsets.append((r.conv_id, r.part, n, *[(t + (1 << 63)) % (1 << 64) - (1 << 63) for t in totals]))
        so_far[r.conv_id] = (n + r.n, *[t + r[s] for t, s in zip(totals, sums, strict=True)])
    if not offsets:
        return table.select(*names, "place")
    more = spark.createDataFrame(offsets, ", ".join(["conv_id long, part long, n_before long", *[f"{s}_before long" for s in sums]]))
    both = table.join(F.broadcast(more), ["conv_id", "part"], "left")
    wrapped = {s: wrap_add(F.col(s), F.coalesce(f"{s}_before", F.lit(0))) for s in sums}
    return both.withColumns({"place": F.col("place") + F.coalesce("n_before", F.lit(0))} | wrapped).select(*names, "place")


def wrap_add(a, b):
    """The sum of two longs modulo 2**64, as a long: halves are added, so that nothing overflows."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrap_minus(a, b):
    """The difference of two longs modulo 2**64, as a long."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) - b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftright(a, 32) - F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), t1, t2 (a turn's 128-bit name), n (code points of its text) of conversations (conv_id, turn, role, text).

    Turns are in ascending order, null first; rows of one turn are in the order of a hash of role and text. A null role
    or text is empty. Rows without conv_id are of no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.length(text).cast("long").alias("n"))
    return placed(rows, ["turn", "t1", "t2", "n"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations of turns (ordered_turns): their rows conv_id, depth (from 1), t1, t2, n, and all conv_ids.

    The first h turns are those of conversation c - c % 100 (all, if it has fewer), the others c's own after its first h.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % CUTS
    convs = common.materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).select("conv_id", base.alias("base"), h.alias("h"), "n_own"), "convs")
    bases = convs.where("base = conv_id").select("base", F.col("n_own").alias("n_base"))
    heads = turns.where((base == F.col("conv_id")) & (F.col("place") < CUTS - 1)).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "n")
    taken = convs.join(heads, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "t1", "t2", "n")
    own = turns.withColumns({"base": base, "h": h}).where("place >= h").join(bases, "base", "left")
    own = own.select("conv_id", (F.least("h", F.coalesce("n_base", F.lit(0))) + F.col("place") - F.col("h") + 1).alias("depth"), "t1", "t2", "n")
    return taken.unionByName(own), convs.select("conv_id")


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of conversations (rows: conv_id, depth from 1, t1, t2, n; convs: all conv_ids), and where each conversation ends.

    Nodes: g1, g2, p1, p2 (the parent's name; null at the root), depth, conv_id (least member), n_convs, n. Ends: g1, g2, conv_id.
    The root is (0, 0); without conversations there is none.
    """
    named = rows.select("conv_id", "depth", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("g1"), F.xxhash64(F.lit(2), "depth", "t1", "t2").alias("g2"), "n", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("x1"), F.xxhash64(F.lit(2), "depth", "t1", "t2").alias("x2"))
    members = placed(named, ["depth"], ("g1", "g2"))
    nodes = members.groupBy("g1", "g2").agg(F.min("x1").alias("x1"), F.min("x2").alias("x2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n").alias("n"))
    nodes = nodes.select("g1", "g2", wrap_minus(F.col("g1"), F.col("x1")).alias("p1"), wrap_minus(F.col("g2"), F.col("x2")).alias("p2"), "depth", "conv_id", "n_convs", "n")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("g1"), zero.alias("g2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n"))
    last = members.groupBy("conv_id").agg(F.max_by(F.struct("g1", "g2"), "depth").alias("g"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("g.g1", zero).alias("g1"), F.coalesce("g.g2", zero).alias("g2"), "conv_id")
    return common.materialize(nodes.unionByName(root), "nodes"), ends


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """g1, g2 and, for each of values (longs of nodes), its sum over the node and all its descendants."""
    handed = [nodes.select("g1", "g2", *values)]
    active = nodes.where("p1 is not null").select("g1", "g2", "p1", "p2", *values)
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    for k in range(int(deepest).bit_length()):
        got = active.groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(*[F.sum(v).alias(v) for v in values])
        got = common.materialize(got, f"handed-{k}")
        handed.append(got)
        if 2 << k > deepest:
            break  # no node is that deep
        ahead = active.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
        more = got.select("g1", "g2", *[F.col(v).alias(f"{v}_got") for v in values])
        moved = active.join(ahead, ["p1", "p2"]).join(more, ["g1", "g2"], "left")
        active = common.materialize(moved.select("g1", "g2", F.col("a1").alias("p1"), F.col("a2").alias("p2"), *[(F.col(v) + F.coalesce(f"{v}_got", F.lit(0))).alias(v) for v in values]), f"jump-{k}")
    both = handed[0]
    for h in handed[1:]:
        both = both.unionByName(h)
    return both.groupBy("g1", "g2").agg(*[F.sum(v).alias(v) for v in values])


def ends_digest(ends: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """g1, g2, ends_sha256 (of the ascending conv_ids, comma-joined) of ends (g1, g2, conv_id).

    Ids are first joined into pieces where a range of (node, conv_id) lies, so that a node where very many conversations
    end comes as few rows; its pieces are then hashed in order, as that digest asks for, one held at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["g1", "g2", "first", "ids"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            g1, g2, ids = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g1)], strict=True):
                for i in range(a, b, most_bytes // 20):
                    for c, v in zip(out, (int(g1[i]), int(g2[i]), int(ids[i]), ",".join(map(str, ids[i : min(b, i + most_bytes // 20)].tolist()))), strict=True):
                        c.append(v)
            if out[0]:
                yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            done = []
            for g1, g2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key != (g1, g2):
                    if key:
                        done.append((*key, now.hexdigest()))
                    key, now = (g1, g2), hashlib.sha256(ids.encode())
                else:
                    now.update(f",{ids}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["g1", "g2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, now.hexdigest())], ["g1", "g2", "ends_sha256"])

    order = ["g1", "g2", "conv_id"]
    pieces = common.bounded(ends.select(*order)).repartitionByRange(partitions(ends), *order).sortWithinPartitions(*order).mapInArrow(join, "g1 long, g2 long, first long, ids string")
    return pieces.repartition(partitions(ends), "g1", "g2").sortWithinPartitions("g1", "g2", "first").mapInArrow(digest, "g1 long, g2 long, ends_sha256 string")


def rollup(conversations: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations of conversations (conv_id, turn, role, text; other columns are not read).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null roles and
    texts are empty, null turns come first, rows of one turn stay all (in the order of a hash), rows
    without conv_id are left out, and an empty table gives no rows.
    """
    nodes, ends = trie(*rebuilt(ordered_turns(conversations)))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["g1", "g2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = common.materialize(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n")}), "valued")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop("n_leaves", "saved_tokens").join(sums, ["g1", "g2"]).join(ends_digest(ends), ["g1", "g2"], "left").join(parents, ["p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
