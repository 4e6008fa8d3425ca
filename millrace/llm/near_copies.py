"""Near copies: all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Under any one order of all shingles, two sets of sizes m <= n that reach the similarity have their first
common shingle among the first fifth of the larger set and the first ninth of the smaller one (prefix
filter), with enough of both sets left after it (position filter), and m is at least 0.8 n. Shingles that
a sample shows to be frequent come last in the order, which keeps the lists short; the sample decides
the cost alone.

Of the pairs that a list can make, those go that a count sketch rules out: numbers of shingles by bucket, modulo 16. Sets
that reach the similarity differ in a ninth of m + n shingles at most, each of which moves one count by one, so
the distances of their counts add up to no more: no similar pair is lost. A sketch of 32 buckets rules out nearly all other pairs of sets
of up to 500 shingles; larger sets have a second one, with a bucket for each 8 to 16 shingles, which their pairs
meet next. What is left is compared by whole sets.

A list first links its members to its smallest one. Only pairs that this leaves in different components
are compared after that, so that a large group of near copies does not cost all its pairs. A list that still has many members is dealt
into blocks, and each two blocks of it are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components

from . import common, simhash

WORDS = 5
#: The least similarity, as a fraction; two sets of m and n shingles that reach it share OVER / (OVER + UNDER) of m + n.
OVER, UNDER = 4, 5
BUCKETS = 32
#: Sets of more shingles have a second sketch.
LARGE = 500
#: Members of a block of a list.
BLOCK = 4096


class Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 15:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def shingles(text: str | None, hashes: Hashes | None = None) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's shingles, made of its words' hashes; words as in simhash.fingerprint.

    A text of fewer words than a shingle has one shingle of all of them; one without words has none.
    """
    parts = text.encode("utf-8", "surrogatepass").translate(simhash.LOWER).split() if text else []
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((Hashes() if hashes is None else hashes).__getitem__, parts), np.uint64, n)
    size = min(WORDS, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = (out ^ h[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def counted(own: np.ndarray, buckets: int) -> np.ndarray:
    """The numbers, modulo 16, of a set's shingles in each of buckets (a power of two), by the upper bits of another hash."""
    h = (own ^ (own >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.bincount((h >> np.uint64(32)).astype(np.int64) % buckets, minlength=buckets).astype(np.uint8) & 15


def sketch_of(own: np.ndarray) -> tuple[int, int]:
    """The first sketch of a set: 32 counts of four bits."""
    c = counted(own, BUCKETS)
    one, two = (c[::2] << 4 | c[1::2]).view(np.int64).tolist()
    return one, two


def large_sketch(own: np.ndarray) -> bytes | None:
    """The second sketch of a large set, whose length follows its size: a byte a bucket."""
    return counted(own, 1 << int(len(own) // 8).bit_length() - 1).tobytes() if len(own) > LARGE else None


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least sum of differences that counts (modulo 16, last axis) can have."""
    d = (x - y) & 15
    return np.minimum(d, 16 - d).sum(-1, dtype=np.int64)


def may_be_alike(x: bytes | None, y: bytes | None, m: int, n: int) -> bool:
    """Whether second sketches of sets of m and n shingles allow the similarity; a longer one is folded first."""
    if x is None or y is None:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (c.reshape(-1, size).sum(0, dtype=np.uint8) & 15 for c in (a, b))  # the low bits of a bucket stay
    return (OVER + UNDER) * int(apart(a, b)) <= m + n


def frequent(docs: DataFrame, least: int = 4_000, share: int = 50, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, sorted, and how many of its rows have each.

    The sample is one row in share (by a hash of the text), or least rows if that is more; at most most shingles are told.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, hashes).view(np.int64))], ["h"])

    step = max(1, min(share, docs.count() // least))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(step)) == 0).select("text").dropDuplicates().mapInArrow(cut, "h long")
    top = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(own: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set that come first, rare before frequent, of which a similar set that is not larger shares one."""
    n = len(own)
    seen = np.zeros(n, np.int64)
    if n and len(often[0]):
        at = np.minimum(np.searchsorted(often[0], own), len(often[0]) - 1)
        seen = np.where(often[0][at] == own, often[1][at], 0)
    return own[np.lexsort((own, seen))][: n - -(-OVER * n // UNDER) + 1]


def signatures(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """k1, k2, doc_id, fp (op8's), one and two (name of the set), s1 and s2 (its sketch), big (its second one), n (its size), prefix of every row of docs (k1, k2, doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in common.slices(batches, most_bytes=1 << 20):
            texts = batch.column(3).to_pylist()
            fps = np.fromiter(map(simhash.fingerprint, texts), np.uint64, len(texts))
            sets = [shingles(t, hashes) for t in texts]
            names = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
            one, two = [(h >> 64) - (1 << 63) for h in names], [(h & (1 << 64) - 1) - (1 << 63) for h in names]
            lists = pa.array([prefix(s, often).view(np.int64) for s in sets], pa.list_(pa.int64()))
            s1, s2 = zip(*map(sketch_of, sets), strict=True)
            columns = [*batch.columns[:3], pa.array(fps.view(np.int64)), *(pa.array(c, pa.int64()) for c in (one, two, s1, s2)), pa.array(map(large_sketch, sets), pa.binary()), pa.array(list(map(len, sets)), pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc_id", "fp", "one", "two", "s1", "s2", "big", "n", "prefix"])

    return common.bounded(docs.select("k1", "k2", "doc_id", "text")).mapInArrow(compute, "k1 long, k2 long, doc_id long, fp long, one long, two long, s1 long, s2 long, big binary, n int, prefix array<long>")


def fits(m: np.ndarray, i: np.ndarray, n: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of m <= n shingles can be similar if place i of the one and j of the other is their first common shingle."""
    return (UNDER * m >= OVER * n) & ((OVER + UNDER) * np.minimum(m - i, n - j) >= OVER * (m + n))


def first_ninth(m: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether a set of m shingles can be the smaller of a similar pair whose first common shingle is at its place i."""
    return fits(m, i, m, i)


def alike(s1: np.ndarray, s2: np.ndarray, t1: np.ndarray, t2: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether first sketches allow the similarity of sets of m and n shingles."""
    counts = lambda one, two: np.stack(np.broadcast_arrays(one, two), -1).view(np.uint8).reshape(-1, 16)
    x, y = counts(s1, s2), counts(t1, t2)
    return (OVER + UNDER) * (apart(x >> 4, y >> 4) + apart(x & 15, y & 15)) <= m + n


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each list's smallest member that can be the smaller of a pair with the others that fit; rows (h, n, row, at, s1, s2) are sorted."""
    head = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not batch.num_rows:
            continue
        if head is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(head, columns, strict=True)]
        h, n, row, at, s1, s2 = columns
        able = np.flatnonzero(first_ninth(n, at))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        first = np.full(len(starts), -1)
        first[of[able[::-1]]] = able[::-1]  # the smallest is written last
        lead = first[of]
        x = np.flatnonzero((lead >= 0) & (lead != np.arange(len(h))))
        x = x[lead[x] < x]
        y = lead[x]
        ok = fits(n[y], at[y], n[x], at[x])
        x, y = x[ok], y[ok]
        ok = alike(s1[y], s2[y], s1[x], s2[x], n[y], n[x])
        yield _pairs(row[y[ok]], row[x[ok]])
        head = [c[first[-1]] for c in columns] if first[-1] >= 0 else None


def rest(most: int = 1 << 18):
    """All pairs (a, b) of different components that members of one group can make: rows (h, i, j, b, n, row, at, s1, s2, component) sorted by h, i, j, n.

    A group is a block (i = j) or two blocks of a list, of which it has the pairs across.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, _ in common.whole_groups(batches, ["h", "i", "j"], 1 << 62):  # a group has about two blocks' members
            h, i_, j_, block, n, row, at, s1, s2, component = (now[c].astype(np.int64) for c in ("h", "i", "j", "b", "n", "row", "at", "s1", "s2", "component"))
            ends = np.append(np.flatnonzero((h[1:] != h[:-1]) | (i_[1:] != i_[:-1]) | (j_[1:] != j_[:-1])) + 1, len(h))
            able, (a, b, held) = first_ninth(n, at), ([], [], 0)
            for start, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                across = i_[start] != j_[start]
                for i in (start + np.flatnonzero(able[start:end])).tolist():
                    x = np.arange(i + 1, start + int(np.searchsorted(n[start:end], UNDER * n[i] // OVER, "right")))
                    x = x[component[x] != component[i]]
                    if across:
                        x = x[block[x] != block[i]]
                    x = x[fits(n[i], at[i], n[x], at[x])]
                    x = x[alike(s1[i], s2[i], s1[x], s2[x], n[i], n[x])] if len(x) else x
                    a.append(np.full(len(x), row[i]))
                    b.append(row[x])
                    held += len(x)
                    if held > most:
                        yield _pairs(np.concatenate(a), np.concatenate(b))
                        a, b, held = [], [], 0
            if held:
                yield _pairs(np.concatenate(a), np.concatenate(b))

    return run


def possible(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that the second sketches of found (row, n, big) allow; pairs without a large set are all left."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded_rows(batches, (2, 3)):
            ok = [may_be_alike(*r) for r in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    big = found.where("big is not null").select("row", "n", "big")
    x, y = (big.select(F.col("row").alias(c), F.col("big").alias(f"{c}_big"), F.col("n").alias(f"{c}_n")) for c in "ab")
    both = common.materialize(pairs.join(x.select("a", "a_n"), "a", "left").join(y.select("b", "b_n"), "b", "left"), "near-sized")
    large = both.where("a_n is not null and b_n is not null").select("a", "b").join(x, "a").join(y, "b").select("a", "b", "a_big", "b_big", "a_n", "b_n")
    return both.where("a_n is null or b_n is null").select("a", "b").unionByName(large.mapInArrow(check, "a long, b long"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (row, hs) reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(UNDER * both >= OVER * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("row").alias("a"), F.col("hs").alias("x")), sets.select(F.col("row").alias("b"), F.col("hs").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def sets_of(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """row, hs (the whole set) of rows (row, k1, k2), from the texts of keyed (k1, k2, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, hashes).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "hs"])

    rows = common.materialize(rows, "near-ends")
    some = common.probed(keyed.select("k1", "k2", "text"), ["k1", "k2"], rows, "some").where("some")  # only these texts are shuffled
    found = some.join(rows, ["k1", "k2"]).select("row", "text").dropDuplicates(["row"])
    return found.mapInArrow(cut, "row long, hs array<long>")


def links(keyed: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: enough links between those rows of found (row, k1, k2, n, prefix) that reps names (row; different sets) to join all that are similar.

    Lists of one member, nearly all of them, go before anything else is joined.
    """

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of lists that have more than one; rows are sorted by h."""
        held, same = None, False
        for batch in batches:
            whole = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()
            if not whole:
                continue
            h = whole[0].column(0).to_numpy()
            equal = h[1:] == h[:-1]
            keep = np.concatenate([[same], equal]) | np.concatenate([equal, [False]])
            yield whole[0].slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
            held, same = whole[0].slice(len(h) - 1), bool(equal[-1]) if len(equal) else same
        if held is not None and same:
            yield held

    dealt = lambda d: d.repartition("h").sortWithinPartitions("h", "n", "row")
    index = dealt(found.select(F.posexplode("prefix").alias("at", "h"), "n", "row").select("h", "n", "row", "at")).mapInArrow(many, "h long, n int, row long, at int")
    bits = common.materialize(found.select("row", "s1", "s2").join(reps, "row", "left_semi"), "near-bits")
    index = common.materialize(common.materialize(index, "near-lists").join(bits, "row").select("h", "n", "row", "at", "s1", "s2"), "near-index")
    first = common.materialize(dealt(index).mapInArrow(star, "a long, b long").distinct(), "near-star-all")
    first = common.materialize(possible(first, found), "near-star")
    ends = lambda p: p.select(F.col("a").alias("row")).unionByName(p.select(F.col("b").alias("row"))).distinct()
    names = found.select("row", "k1", "k2")
    sets = common.materialize(sets_of(keyed, names.join(ends(first), "row", "left_semi")), "near-sets")
    linked = common.materialize(similar(first, sets), "near-links")
    parts = connected_components(linked).withColumnRenamed("node", "row")
    parted = common.materialize(index.join(parts, "row", "left").select("h", "n", "row", "at", "s1", "s2", F.coalesce("component", "row").alias("component")), "near-parts")
    mixed = parted.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2")
    blocks = mixed.select("h", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = parted.join(blocks, "h").withColumn("b", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "n", "row", "at", "s1", "s2", "component")
    other = own.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "row").mapInArrow(rest(), "a long, b long").distinct()
    other = common.materialize(other.join(first, ["a", "b"], "left_anti"), "near-rest-all")
    other = common.materialize(possible(other, found), "near-rest")
    more = sets_of(keyed, names.join(ends(other).join(ends(first), "row", "left_anti"), "row", "left_semi"))
    more = common.materialize(sets.join(ends(other), "row", "left_semi").unionByName(more), "near-sets")
    return linked.unionByName(similar(other, more))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without near copies: first one row of each group of op8's fingerprints,
    then, of those, one row of each group that similar sets of shingles join; always the least doc_id (null last).

    All texts without words are of one group. Of rows that are equal in all columns one stays. docs is read from
    files or a written table; a row is named by 128 bits of hash of its columns, so it needs no number.
    """
    k1, k2 = common.unused(docs, "k1"), common.unused(docs, "k2")
    keyed = common.with_key(docs, k1, k2)
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "doc_id", "text")
    with common.scratch(docs.sparkSession):
        found = common.materialize(signatures(texts, frequent(texts)).withColumn("row", F.monotonically_increasing_id()), "signatures")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "row")
        groups = simhash.groups(found.select("row", "doc_id", "fp"))
        left = common.materialize(found.select("row", "one", "two", "k1", "k2", "doc_id").join(groups.select(F.col("first.row").alias("row")).distinct(), "row", "left_semi"), "near-left")
        classes = common.materialize(left.groupBy("one", "two").agg(F.min(place).alias("first")), "near-classes")
        parts = connected_components(links(texts, found, classes.select(F.col("first.row").alias("row"))))
        kept = classes.join(parts, F.col("first.row") == F.col("node"), "left").groupBy(F.coalesce("component", "first.row").alias("group")).agg(F.min("first").alias("first"))
        kept = common.materialize(kept.select("first.k1", "first.k2"), "near-kept")
        return common.keep_keys(docs, found.select("k1", "k2"), kept)
