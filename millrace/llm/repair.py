"""Structure repair of conversations: the cheapest edits that give role initials (s?(ua)+)?, by a bidirectional tight-arc DAG.

Nodes are (turns read, state), states: nothing yet, after a system turn, after a user turn, after an assistant turn. Arcs keep,
rerole or delete a turn, or insert one. An arc is tight if the minimum cost from the start to it, its own, and that from it to the
end add up to the least cost: tight arcs are the arcs of all optimal paths. From the start, a set of frontier
nodes moves along the tight arcs with the least letter.

Turns are worked on in blocks of 1024. A block's costs between any two states are a 4 by 4 matrix; where a conversation
has more than one block, minimum costs at their ends are carried over one row of numbers a block, in order, with constant
memory. Within a batch all blocks step together in numpy, from the longest to the shortest. Texts are shuffled twice: by
(conversation, turn) ranges, and by block, where edits meet them and are streamed into a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BITS = 10
FAR = 1 << 40  # a cost that no path reaches
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads: to a user turn, after which an assistant's follows.
NEXT = [USER, USER, ASSISTANT, USER]
ENDS = np.array([0, FAR, FAR, 0])
SPACE = " \t\n\x0b\f\r"


def arc_costs() -> np.ndarray:
    """[class, letter, state]: costs of D, K and R; class is initial (s, u, a, other) + 4 (must go) + 8 (truncated)."""
    out = np.full((16, 3, 4), FAR)
    for c in range(16):
        initial, must_go, cut = c & 3, c >> 2 & 1, 5 * (c >> 3)
        for q in range(4):
            out[c, 0, q] = 2
            if not must_go:
                if (initial == 0 and q == START) or (initial in (1, 2) and NEXT[q] == initial + 1):
                    out[c, 1, q] = cut
                out[c, 2, q] = 1 + cut
    return out


ARC = arc_costs()
#: [class, letter, state]: the state that D, K and R lead to.
LEADS = np.array([[[q, SYSTEM if c & 3 == 0 and letter == 1 else NEXT[q]][letter > 0] for q in range(4)] for c in range(16) for letter in range(3)]).reshape(16, 3, 4)


def inserted(costs: np.ndarray, backwards: bool) -> np.ndarray:
    """Minimum costs [.., state] with insertions (5 each) after, or before, the states."""
    out = costs.copy()
    for _ in range(2):
        for q in range(4):
            a, b = (q, NEXT[q]) if backwards else (NEXT[q], q)
            out[..., a] = np.minimum(out[..., a], out[..., b] + 5)
    return out


def step_matrices() -> np.ndarray:
    """[class, from, to]: the least cost of insertions and then one arc of a turn."""
    out = np.full((16, 4, 4), FAR)
    for c in range(16):
        for q in range(4):
            ahead = inserted(np.where(np.arange(4) == q, 0, FAR), False)
            for letter in range(3):
                for m in range(4):
                    to = LEADS[c, letter, m]
                    out[c, q, to] = min(out[c, q, to], ahead[m] + ARC[c, letter, m])
    return np.minimum(out, FAR)


STEP = step_matrices()


def padded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[turn, block] classes of blocks, and their lengths; blocks come from the longest to the shortest."""
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((int(sizes.max(initial=0)), len(codes)), np.uint8)
    for i, c in enumerate(codes):
        out[: len(c), i] = np.frombuffer(c, np.uint8)
    return out, sizes


def matrices(codes: list[bytes]) -> np.ndarray:
    """[block, from, to]: the least costs of blocks (from the longest to the shortest), insertions at their ends not counted."""
    grid, sizes = padded(codes)
    out = np.tile(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 1, 1))
    for i in range(len(grid)):
        n = int((sizes > i).sum())
        out[:n] = np.minimum((out[:n, :, :, None] + STEP[grid[i, :n]][:, None]).min(2), FAR)
    return out


def edits(codes: list[bytes], forward: np.ndarray, backward: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of blocks (from the longest to the shortest): their letters, the state after each, and the cost.

    forward and backward [block, state]: minimum costs from the start to the block, and from its end to the end; entry: its
    state; last: whether it is its conversation's last block, which has the insertions at the end.
    """
    grid, sizes = padded(codes)
    steps, k = len(grid), len(codes)
    fore, back = np.full((steps + 1, k, 4), FAR), np.zeros((steps + 1, k, 4), np.int64)
    fore[0] = inserted(forward, False)
    for i in range(steps):
        n = int((sizes > i).sum())
        fore[i + 1, :n] = (inserted(fore[i, :n], False)[:, :, None] + np.where(LEADS[grid[i, :n]][..., None] == np.arange(4), ARC[grid[i, :n]][..., None], FAR).min(1)).min(1)
        fore[i + 1, :n] = inserted(np.minimum(fore[i + 1, :n], FAR), False)
    back[sizes, np.arange(k)] = inserted(backward, True)
    for i in range(steps - 1, -1, -1):
        n = int((sizes > i).sum())
        after = back[i + 1, np.arange(n)[:, None, None], LEADS[grid[i, :n]]]
        back[i, :n] = inserted(np.minimum((ARC[grid[i, :n]] + after).min(1), FAR), True)
    total = (fore[0] + back[0]).min(1)
    frontier = np.zeros((k, 4), bool)
    frontier[np.arange(k), entry] = True
    letters = np.zeros((3 * (steps + 1), k), "S1")
    cost, exits = np.zeros(k, np.int64), entry.copy()
    for i in range(steps + 1):
        here = np.flatnonzero((sizes > i) | ((sizes == i) & last))
        moving = here
        for slot in range(3):  # two insertions at most, then an arc of the turn
            if not len(moving):
                break
            own = i < sizes[moving]
            at = np.minimum(i, steps - 1)
            arcs = ARC[grid[at, moving]] if steps else np.full((len(moving), 3, 4), FAR)
            leads = LEADS[grid[at, moving]] if steps else np.zeros((len(moving), 3, 4), int)
            now, left = fore[i, moving], total[moving, None]
            tight = np.full((len(moving), 4, 4), False)  # D, I, K, R of each state of the frontier
            after = back[min(i + 1, steps), moving[:, None, None], leads]
            tight[:, [0, 2, 3]] = own[:, None, None] & (now[:, None] + arcs + after == left[:, None])
            tight[:, 1] = now + 5 + back[i, moving][:, NEXT] == left
            tight &= frontier[moving][:, None, :]
            some = tight.any(2)
            done = ~some.any(1)  # the end of the conversation
            letter = some.argmax(1)
            states = tight[np.arange(len(moving)), letter]
            state = states.argmax(1)  # a state and a letter lead to one state, so a frontier from one start has one
            lead = np.where(letter == 1, np.array(NEXT)[state], leads[np.arange(len(moving)), np.array([0, 0, 1, 2])[letter], state])
            chosen = np.select([letter == 0, letter == 2, letter == 1], [np.full(len(moving), b"D", "S1"), np.full(len(moving), b"K", "S1"), np.where(lead == USER, b"U", b"A")], np.where(lead == USER, b"u", b"a"))
            price = np.where(letter == 1, 5, arcs[np.arange(len(moving)), np.array([0, 0, 1, 2])[letter], state])
            go = moving[~done]
            letters[3 * i + slot, go] = chosen[~done]
            cost[go] += price[~done]
            frontier[go] = False
            frontier[go, lead[~done]] = True
            exits[go] = lead[~done]
            moving = moving[~done & (letter == 1)]
        if len(moving):
            raise RuntimeError("no tight arc")
    return [letters[:, j].tobytes().replace(b"\0", b"") for j in range(k)], exits, cost


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes [.!?] off, 3 repeats it, 4 makes it the user's. Nulls are one space there; null ids and turns stay null."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(F.col("kind") == 0, F.array().cast("array<int>")).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def key_of(conv_id: str) -> Column:
    """A conversation's key, which is not null: a null conv_id is a conversation too."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))


def classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text: not null) in order: conv, turn, role, text, at (ascending), block; and conv, block, at, turn, fault, cls.

    Ordered by turn (null first), rows of one turn by a hash of role and text. fault: blank, duplicate, truncated or null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv = key_of("conv_id")
    keyed = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64(F.lit(1), conv, "role", "text").alias("h1"), F.xxhash64(F.lit(2), conv, "role", "text").alias("h2"))
    order = ["conv", "turn", "h1", "h2"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = common.materialize(ordered.withColumn("block", F.shiftright("at", BLOCK_BITS)), "turns")
    tail = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    found = ordered.select("conv", "block", "at", "turn", "h1", "h2", initial.alias("initial"), (tail == "").alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("truncated"))
    again = ordered.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), F.lit("blank")).when(F.col("at") > F.col("first"), F.lit("duplicate")).when(F.col("truncated"), F.lit("truncated"))
    cls = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    found = found.join(again, ["h1", "h2"], "left").withColumn("fault", fault).select("conv", "block", "at", "turn", "fault", cls.alias("cls"))
    return ordered, common.materialize(found, "classes")


def by_length(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Batches of blocks (codes are their third column) of about most turns, padding counted, from the longest to the shortest."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(2)).to_numpy()
        order, start = np.argsort(-sizes, kind="stable"), 0
        while start < len(order):
            n = max(1, most // max(1, int(sizes[order[start]])))
            yield batch.take(pa.array(order[start : start + n]))
            start += n


def carried(rows: DataFrame, backwards: bool, start: np.ndarray, step, fields: str) -> DataFrame:
    """rows (conv, block, arrays) with, for each, the state (array) that step leaves of those before (or after) it; a stream over one row a block, with constant memory."""
    order = [F.col("conv"), F.col("block").desc() if backwards else F.col("block")]
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, start
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != key:
                    key, now = row["conv"], start
                out.append(now.tolist())
                now = step(now, row)
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*names, "carried"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv").sortWithinPartitions(*order).mapInArrow(run, f"{fields}, carried array<bigint>")


def solved(blocks: DataFrame) -> DataFrame:
    """conv, block, last, single, letters, cost, of blocks (conv, block, codes, last, single)."""
    first = np.where(np.arange(4) == START, 0, FAR)
    matrix = lambda row: np.array(row["m"]).reshape(4, 4)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_length(batches):
            m = matrices(batch.column(2).to_pylist()).reshape(batch.num_rows, 16)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(m.tolist(), pa.list_(pa.int64()))], ["conv", "block", "m"])

    def solve(exits_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_length(batches):
                codes, last = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                fore, back = (np.array(batch.column(i).to_pylist(), np.int64).reshape(-1, 4) for i in (5, 6))
                if exits_only:
                    exits = np.zeros((len(codes), 4), np.int64)
                    for q in range(4):
                        # Another entry state than the path's is on no tight arc: its costs are taken as if it were.
                        alone = np.where(np.arange(4) == q, 0, FAR) + np.zeros((len(codes), 1), np.int64)
                        exits[:, q] = edits(codes, alone, back, np.full(len(codes), q), last)[1]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(exits.tolist(), pa.list_(pa.int64()))], ["conv", "block", "exits"])
                else:
                    letters, _, cost = edits(codes, fore, back, batch.column(7).to_numpy().astype(int), last)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), batch.column(4), pa.array(letters, pa.binary()).cast(pa.string()), pa.array(cost)], ["conv", "block", "last", "single", "letters", "cost"])

        return run

    out = "conv string, block long, last boolean, single boolean, letters string, cost long"
    arrays = lambda a: F.array(*[F.lit(int(x)) for x in a]).cast("array<bigint>")
    ones = blocks.where("single").select("conv", "block", "codes", "last", "single", arrays(first).alias("fore"), arrays(ENDS).alias("back"), F.lit(0).alias("entry"))
    long = blocks.where("not single")
    sums = common.materialize(long.mapInArrow(measure, "conv string, block long, m array<bigint>"), "block-costs")
    fore = carried(sums, False, first, lambda now, row: np.minimum((now[:, None] + matrix(row)).min(0), FAR), "conv string, block long, m array<bigint>")
    back = carried(sums, True, ENDS, lambda now, row: np.minimum((matrix(row) + inserted(now, True)).min(1), FAR), "conv string, block long, m array<bigint>")
    both = fore.select("conv", "block", F.col("carried").alias("fore")).join(back.select("conv", "block", F.col("carried").alias("back")), ["conv", "block"])
    both = common.materialize(long.join(both, ["conv", "block"]).select("conv", "block", "codes", "last", "single", "fore", "back"), "block-bounds")
    exits = both.mapInArrow(solve(True), "conv string, block long, exits array<bigint>")
    entry = carried(exits, False, np.array([START]), lambda now, row: np.array([row["exits"][now[0]]]), "conv string, block long, exits array<bigint>")
    many = both.join(entry.select("conv", "block", F.col("carried")[0].cast("int").alias("entry")), ["conv", "block"]).select(*ones.columns)
    return ones.unionByName(many).mapInArrow(solve(False), out)


def digests(ordered: DataFrame, done: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """conv, repaired_sha256: texts (ordered) meet the letters of their block (done) in one sorted stream.

    A conversation of one block is digested there; the others' blocks come out as pieces, which are then hashed in order.
    """
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = done.select("conv", "block", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("letters").alias("text"), "single")
    both = ordered.select("conv", "block", "at", "role", "text", F.lit(False).alias("single")).unionByName(heads)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"key": None}
        out: list[tuple] = []

        def put(line: str) -> None:
            data = ("\n" + line).encode("utf-8", "surrogatepass")
            if state["single"]:
                state["sha"].update(data if state["some"] else data[1:])
            else:
                state["held"].append(data)
                state["size"] += len(data)
                if state["size"] > most_bytes:
                    cut()
            state["some"] = True

        def cut() -> None:
            out.append((*state["key"], state["seq"], b"".join(state["held"]), None))
            state.update(seq=state["seq"] + 1, held=[], size=0)

        def inserts() -> None:
            while state["i"] < len(state["letters"]) and state["letters"][state["i"]] in "UA":
                put(("user:", "assistant:")[state["letters"][state["i"]] == "A"])
                state["i"] += 1

        def close() -> None:
            if state["key"] is None:
                return
            inserts()
            if state["single"]:
                out.append((*state["key"], 0, b"", state["sha"].hexdigest()))
            else:
                cut()

        def batch_of() -> pa.RecordBatch:
            names, kinds = ["conv", "block", "seq", "data", "sha"], [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for whole in batches:
            for batch in common.slices([whole], 4):
                for conv, block, at, role, text, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at < 0:
                        close()
                        state = {"key": (conv, block), "single": single, "letters": text, "i": 0, "sha": hashlib.sha256(), "some": False, "held": [], "size": 0, "seq": 0}
                        continue
                    inserts()
                    letter = state["letters"][state["i"]]
                    state["i"] += 1
                    if letter != "D":
                        put(f"{({'u': 'user', 'a': 'assistant'}).get(letter, role)}:{text}")
                if out:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, some = None, None, False
        for batch in batches:
            ready = []
            for conv, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != key:
                    if key is not None:
                        ready.append((key, now.hexdigest()))
                    key, now, some = conv, hashlib.sha256(), False
                now.update(data if some else data[1:])
                some = some or bool(data)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ready, strict=True)], ["conv", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([now.hexdigest()])], ["conv", "sha"])

    pieces = common.bounded(both).repartition(parts, "conv", "block").sortWithinPartitions("conv", "block", "at").mapInArrow(stream, "conv string, block long, seq int, data binary, sha string")
    pieces = common.materialize(pieces, "repaired")
    rest = pieces.where("sha is null").repartition(parts, "conv").sortWithinPartitions("conv", "block", "seq").select("conv", "data").mapInArrow(finish, "conv string, sha string")
    return pieces.where("sha is not null").select("conv", "sha").unionByName(rest).withColumnRenamed("sha", "repaired_sha256")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text; role and text not null): the ordered turns, their faults, and the letters of the cheapest edits by block."""
    ordered, classes = classed(rows)
    codes = F.array_sort(F.collect_list(F.struct("at", "cls")))
    blocks = classes.groupBy("conv", "block").agg(F.transform(codes, lambda x: F.substring(F.hex(x["cls"] + 256), 2, 2)).alias("codes"))
    blocks = blocks.select("conv", "block", F.unhex(F.concat_ws("", "codes")).alias("codes"))  # at most 1024 turns
    spans = classes.groupBy("conv").agg(F.max("block").alias("end"), (F.min("block") == F.max("block")).alias("single"))
    blocks = common.materialize(blocks.join(spans, "conv").select("conv", "block", "codes", (F.col("block") == F.col("end")).alias("last"), "single"), "blocks")
    return ordered, classes, common.materialize(solved(blocks), "edits")


def illegal_pairs(classes: DataFrame) -> DataFrame:
    """conv, illegal: neighbours whose role initials are not su, ua or au; neighbours in different blocks too.

    Each turn goes to its own block, and the last of a block to the next block of its conversation as well.
    """
    ends = classes.groupBy("conv", "block").agg(F.max_by("cls", "at").alias("last"), F.min_by("cls", "at").alias("first"))
    w = F.array_sort(F.collect_list(F.struct("at", (F.col("cls") % 4).alias("c"))))
    within = classes.groupBy("conv", "block").agg(w.alias("w")).select("conv", F.explode(F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.struct(a["c"].alias("a"), b["c"].alias("b")))).alias("p"))
    order = Window.partitionBy("conv").orderBy("block")  # a row a block
    across = ends.withColumn("before", F.lag("last").over(order)).where("before is not null").select("conv", F.struct((F.col("before") % 4).alias("a"), (F.col("first") % 4).alias("b")).alias("p"))
    legal = ((F.col("p.a") == 0) & (F.col("p.b") == 1)) | ((F.col("p.a") == 1) & (F.col("p.b") == 2)) | ((F.col("p.a") == 2) & (F.col("p.b") == 1))
    return within.unionByName(across).groupBy("conv").agg(F.count(F.when(~legal, 1)).alias("illegal"))


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id (null too) of conversations (conv_id, turn, role, text; others are not read), damaged and repaired.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows of one turn all count, in the order of
    a hash of role and text; a conversation that damage leaves without rows has zeros, no edits and the digest of nothing; an empty table has no rows.
    """
    ordered, classes, done = repair(damaged(conversations))
    counts = classes.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"), *[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")])
    distinct = classes.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.count("*").alias("turns"))
    audits = done.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("letters"))
    every = conversations.select(key_of("conv_id").alias("conv"), "conv_id").distinct()
    found = every.join(counts, "conv", "left").join(distinct, "conv", "left").join(illegal_pairs(classes), "conv", "left").join(audits, "conv", "left").join(digests(ordered, done), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", (F.coalesce("span", F.lit(0)) - F.coalesce("turns", F.lit(0))).cast("long").alias("gaps"), *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.translate(F.coalesce("letters", F.lit("")), "UAua", "IIRR").alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
