"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Documents longer than a sequence are cut into full pieces and a last one. Pieces are dealt by a hash
into groups of a few thousand; a group is packed on its own, longest piece first, each into the open
bin with the least room that still holds it. A group leaves one bin or so unfilled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

END_ID = 1


class CapacityTree:
    """Open bins by remaining capacity; a node knows whether a bin lies below it."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a bin of the smallest capacity that is least or more; the capacity and the bin."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a subtree to the right has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are 1 to most. Equal lengths go in the order given."""
    tree, bins = CapacityTree(most), 0
    of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        found = tree.take(n)
        if found is None:
            found, bins = (most, bins), bins + 1
        of[i], offset[i] = found[1], most - found[0]
        if found[0] > n:
            tree.put(found[0] - n, found[1])
    return of, offset


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document (null text: empty)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in common.slices(batches, most_bytes=1 << 20):
            ids, sizes = enc.encode(batch.column(1).to_pylist())
            rows, end = [], 0
            for doc_id, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                own = np.append(ids[end : end + n], END_ID).astype("<u4")
                end += n
                for k in range(0, n + 1, most):
                    part = own[k : k + most]
                    rows.append((doc_id, k // most, k, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, most: int = 4096, group_pieces: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces().

    Repeated documents are packed each on their own; an empty table gives no rows. Pieces are dealt by a number that
    each row gets when the table of pieces is written, so repeated rows spread like all others. sequence_id holds
    the group in its upper bits and the group's bin in the lower 24.
    """
    cut = common.materialize(cut.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(cut.count() / group_pieces))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("nth", "ascending")])
        bins, offset = best_fit_decreasing(group.column("length").to_numpy(), most)
        ids = (group.column("pack_group").to_numpy().astype(np.int64) << 24) + bins
        return group.drop(["pack_group", "nth"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("nth"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 4096, group_pieces: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, most), most, group_pieces)
