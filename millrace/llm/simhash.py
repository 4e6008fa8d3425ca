"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in three bits or fewer share five or more
positional bytes (the guaranteed minimum). Lists of single positional bytes would hold 1/256 of all
fingerprints each, so the index is keyed by four positional bytes at a time: the 14 sets of four
positions whose numbers xor to zero. Any three positions lie outside one of these sets, so every such
pair meets in a list. In a list, the shared positional bytes of pairs are tallied, pairs that reach
five are kept, and their bits are compared. A list gives a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components

from . import common

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS, LEAST_SHARED = 3, 5
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half the XXH64 (seed 42) of the text's word shingles, repeats included.

    Words are what white space parts, A-Z lower-cased; fewer words than a shingle has are one shingle;
    a null text or one without words has fingerprint 0.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    n = len(parts)
    if n == 0:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if n <= words:
        return h(joined, 42)
    sizes = np.fromiter(map(len, parts), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: n - words + 1].tolist()
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1)
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        set_in += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id and fp (signed) of every row of docs (row, doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = np.fromiter(map(fingerprint, batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["row", "doc_id", "fp"])

    return common.bounded(docs.select("row", "doc_id", "text")).mapInArrow(compute, "row long, doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their xor."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def _linked(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each pair has enough shared bytes and, of those, few enough differing bits."""
    x = np.bitwise_xor(one, other)
    out = shared_bytes(x) >= LEAST_SHARED
    out[out] = np.bitwise_count(x[out]) <= BITS
    return out


def forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is linked in a list: from each reached fingerprint to those that no other has reached."""
    left, a, b = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = _linked(one, left)
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), one))
                b.append(got)
                todo.extend(got)
    return a, b


def flips(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As forest, for many fingerprints that share five bytes or more: looks up what few flipped bits give."""
    fps = np.sort(fps)
    free = [i for i in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> i & 1]
    masks = [np.uint64(sum(1 << i for i in c)) for n in range(1, BITS + 1) for c in combinations(free, n)]
    label, before = np.arange(len(fps)), None
    while before is None or (label != before).any():
        before = label
        label = before.copy()
        for m in masks:
            other = fps ^ m
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            there = fps[at] == other
            label[there] = np.minimum(label[there], before[at[there]])
        label = label[label]
    far = label != np.arange(len(fps))
    return [fps[label[far]]], [fps[far]]


def _index(fps: DataFrame, places: list[tuple[int, ...]]) -> DataFrame:
    """A row for each fingerprint and set of byte positions: list, key (those bytes in place), fp."""
    masks = [sum(255 << 8 * i for i in p) for p in places]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("list", "key"), "fp")


def links(fps: DataFrame, most_in_list: int = 8192) -> DataFrame:
    """a, b: enough links between different fingerprints (column fp, distinct) to join all that are linked.

    The fingerprints of lists longer than most_in_list are dealt again by each five positional bytes,
    of which every linked pair shares one set; such a list has 24 free bits at most, and if it is
    still long its links are found by flipping bits instead of by comparing pairs.
    """

    def search(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for now, part in common.whole_groups(batches, ["list", "key"], (1 << 25) if again else most_in_list):
                fp = now["fp"].view(np.uint64)
                if part:  # too long: on to a further byte
                    yield batch(np.full(len(fp), 2, np.int8), now["fp"], now["fp"])
                    continue
                kept, a, b = np.flatnonzero(np.concatenate([[True], (now["key"][1:] != now["key"][:-1]) | (now["list"][1:] != now["list"][:-1])])), [], []
                sizes = np.diff(np.append(kept, len(fp)))
                of = np.repeat(np.arange(len(kept)), sizes)
                short = sizes[of] <= 16
                for d in range(1, 16):
                    i = np.flatnonzero(short[:-d] & (of[d:] == of[:-d]))
                    if not len(i):
                        break
                    i = i[_linked(fp[i], fp[i + d])]
                    a.append(fp[i])
                    b.append(fp[i + d])
                for k in np.flatnonzero(sizes > 16).tolist():
                    own = fp[kept[k] : kept[k] + sizes[k]]
                    x, y = flips(own) if again and len(own) > most_in_list else forest(own)
                    a += x
                    b += y
                if a:
                    yield batch(np.ones(sum(map(len, a)), np.int8), np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))

        def batch(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        return run

    def dealt(index: DataFrame, again: bool) -> DataFrame:
        return index.repartition("list", "key").sortWithinPartitions("list", "key").mapInArrow(search(again), "kind byte, a long, b long")

    first = common.materialize(dealt(_index(fps, QUADS), False), "links")
    in_long = first.where("kind = 2").select(F.col("a").alias("fp")).distinct()
    second = dealt(_index(in_long, [*combinations(range(8), LEAST_SHARED)]), True)
    return first.where("kind = 1").select("a", "b").unionByName(second.select("a", "b")).distinct()


def groups(fps: DataFrame) -> DataFrame:
    """fp, first (the least (no_id, doc_id, row) of its group) for each distinct fingerprint of fingerprints()."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = fps.groupBy("fp").agg(F.min(place).alias("first"))
    linked = connected_components(links(classes.select("fp")))
    mine = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", "component")
    firsts = mine.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("group_first"))
    return mine.join(firsts, "component", "left").select("fp", F.coalesce("group_first", "first").alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id of the group, null if none has one) of every row of docs.

    docs: doc_id, text; other columns are not read. Repeated rows are rows of one group; all texts
    without words are of one group; an empty table gives no rows.
    """
    fps = common.materialize(fingerprints(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")), "fingerprints")
    found = fps.join(groups(fps), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


