"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the test items. A block of two words at the end of the
search position looks up how far the position may move on: blocks that no pattern holds move it past
the whole block. Where the shift is zero, the block's hash gives a bucket of patterns that end in it,
and a direct comparison of all words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A to Z to lower case; what is not part of a word ([^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing) to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8: the bytes of a non-ASCII character are all word bytes."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class WuManber:
    """Finds all occurrences of patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]) -> None:
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.ids: dict[bytes, int] = {}
        for p in patterns:
            for w in p:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.base = len(self.ids) + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], list[str]]]] = {}
        for p, items in patterns.items():
            code = tuple(self.ids[w] for w in p)
            for end in range(self.block, self.length + 1):
                b = self._hash(code, end)
                self.shift[b] = min(self.shift.get(b, self.most), self.length - end)
            self.buckets.setdefault(self._hash(code, self.length), []).append((code, items))

    def _hash(self, code: tuple[int, ...] | list[int], end: int) -> int:
        return code[end - 1] if self.block == 1 else code[end - 2] * self.base + code[end - 1]

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """The first word of each occurrence, in ascending order, and the items of its pattern."""
        n, length, base, most, shift = len(text), self.length, self.base, self.most, self.shift
        if n < length:
            return
        code = [*map(self.ids.get, text)]
        end = length
        while end <= n:
            last = code[end - 1]
            if last is None:  # no pattern has this word
                end += length
                continue
            if self.block == 2:
                before = code[end - 2]
                if before is None:
                    end += most
                    continue
                move = shift.get(before * base + last, most)
            else:
                move = 0
            if move:
                end += move
                continue
            here = tuple(code[end - length : end])
            for pattern, items in self.buckets.get(self._hash(code, end), ()):
                if pattern == here:
                    yield end - length, items
            end += 1


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """item_id and words of every different window; an item of fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                size = min(window, len(w))
                out += [(item, b" ".join(w[i : i + size])) for i in range(len(w) - size + 1 if size else 0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["item_id", "words"])

    found = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(cut, "item_id string, words binary")
    return found.distinct()


def pattern_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[WuManber]]:
    """Searchers for about most windows at a time, one for each length of pattern.

    Windows are dealt into blocks by a hash; a block is read by the driver when its turn comes, so it holds one at a time.
    """
    dealt = common.materialize(item_windows(benchmark, window), "windows")
    blocks = max(1, -(-dealt.count() // most))
    for k in range(blocks):
        held: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
        for row in dealt.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toLocalIterator():
            pattern = tuple(bytes(row["words"]).split(b" "))
            held.setdefault(len(pattern), {}).setdefault(pattern, []).append(row["item_id"])
        yield [WuManber(p) for _, p in sorted(held.items())]


def _search(searchers: list[WuManber], text: str | None) -> tuple[int, bytes, list[str]]:
    """The number of words, the spans (pairs of first word and end, as int64 bytes) of all occurrences, and their items."""
    w, hits, names = words(text), [], set()
    for s in searchers:
        for start, of in s.search(w):
            hits.append((start, start + s.length))
            names.update(of)
    return len(w), np.asarray(hits, "<i8").tobytes(), sorted(names)


def _passes(rows: DataFrame, blocks: Iterator[list[WuManber]], first: list[WuManber], second: list[WuManber]) -> DataFrame:
    """Of rows (row, text): row, n_words, spans, items from a pass for each block; a later pass gives only rows with hits."""
    paths = []
    for k, searchers in enumerate(chain([first, second], blocks)):
        shared = rows.sparkSession.sparkContext.broadcast(searchers)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, every=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                found = [(row, *_search(shared.value, text)) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(HITS.names, x, strict=True)) for x in found if every or x[2]], HITS)

        paths.append(common.new_path(rows.sparkSession, "hits"))
        common.bounded(rows.select("row", "text")).mapInArrow(run, "row long, n_words long, spans binary, items array<string>").write.parquet(paths[-1])
        shared.destroy()  # executors hold one block at a time
    return rows.sparkSession.read.schema("row long, n_words long, spans binary, items array<string>").parquet(*paths)


HITS = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_patterns: int = 200_000) -> DataFrame:
    """doc_id, n_words, spans (pairs of first word and end, as int64 bytes), items of each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. The windows of the test items are taken in
    blocks of about most_patterns. One block is searched in one stage without a shuffle; with more, the documents are
    numbered in a table and pass through a stage for each block, so neither the driver nor a task holds more than one
    block's tables however large the benchmark is. A null or empty text has no words and no hits, repeated rows are
    judged alike, and an empty benchmark finds nothing.
    """
    blocks = pattern_blocks(benchmark, window, most_patterns)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        rows = common.numbered(docs.select("doc_id", "text"), "row")
        found = _passes(rows, blocks, first, second).groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a block each
        found = found.select("row", "n_words", F.concat_ws("", F.transform("spans", F.hex)).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
        return rows.select("row", "doc_id").join(found, "row").select("doc_id", "n_words", F.unhex("spans").alias("spans"), "items")
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [_search(shared.value, text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], HITS.types[i + 1]) for i in range(3))], ["doc_id", *HITS.names[1:]])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, spans binary, items array<string>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence, each once), n_items, items_sha256, contaminated of every row of find()."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n_items, digest = [], [], []
            for n, spans, items in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                    hit.append(int((np.cumsum(edge)[:-1] > 0).sum()))
                else:
                    hit.append(0)
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_patterns: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of a test item occurs.

    Rows without words stay, and so do all if no item has a word. Blocks as in find(): with one, rows are filtered in one
    stage; with more, a table is written after each block, of the rows that it leaves.
    """
    blocks = pattern_blocks(benchmark, window, most_patterns)
    searchers, at = next(blocks), common.place_of(docs, "text")
    while searchers is not None:
        shared = docs.sparkSession.sparkContext.broadcast(searchers)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, at):
                words_of = map(words, batch.column(at).to_pylist())
                yield batch.filter(pa.array([not any(next(iter(s.search(w)), None) for s in shared.value) for w in words_of], pa.bool_()))

        docs = common.bounded(docs).mapInArrow(clean, docs.schema)
        searchers = next(blocks, None)
        if searchers is not None:
            docs = common.materialize(docs, "clean-so-far")
            shared.destroy()
    return docs
