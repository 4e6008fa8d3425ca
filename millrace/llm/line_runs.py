"""Line dedup: repeated runs of lines, found with a suffix array over line-ID sequences.

Suffixes of the documents' line sequences are ranked by distributed prefix doubling: a round ranks
them by 2k lines from the pairs of ranks by k lines. A suffix that is alone with its rank is final and
leaves the table, so what goes on shrinks from round to round. All suffixes of one rank form an
interval of the suffix array whose longest common prefix is k lines or more.

A run counts from min_words words on. Every repeated run of that many words is the union of windows
that reach min_words words with their last (or first) line, and such a window holds min_words lines
at most: rounds beyond that depth add nothing. A window of m lines is named by the ranks, by k lines
with k <= m < 2k, at its start and k lines before its end; equal names are the members of an
interval of common prefix m. Each member but the earliest is a later copy, and its lines go.

All tables that are joined here grow with the input, so none is broadcast at any size: a join that is one at a small size
and shuffles at a larger one would grow faster than its input. Of the texts, only those that may have a copy are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def split_lines(text: str | None) -> tuple[list[bytes], list[int]]:
    """The lines of a text as UTF-8, and the number of words (parted by ASCII white space) of each."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [len(x.split()) for x in lines]


def windows(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line (of one word or more), the lengths of the windows that start with it.

    From each line on: the fewest lines with the least number of words. Up to each line: the same, backwards.
    """
    n = len(words)
    out: list[list[int]] = [[] for _ in range(n)]
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + least)  # first end with enough words
    for i in np.flatnonzero(end <= n).tolist():
        out[i].append(int(end[i]) - i)
    start = np.searchsorted(upto, upto[1:] - least, "right") - 1
    for j in np.flatnonzero(start >= 0).tolist():
        i = int(start[j])
        if (m := j + 1 - i) not in out[i]:
            out[i].append(m)
    return out


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word of docs (row, doc_id, text): row, doc_id, pos (among these lines), id1, id2 (128-bit line ID), sizes of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows, ids, pos, one, two, sizes = [], [], [], [], [], []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, words = split_lines(text)
                lines, words = [x for x, n in zip(lines, words, strict=True) if n], [n for n in words if n]
                hashes = [xxhash.xxh128_intdigest(x.strip()) for x in lines]
                rows += [row] * len(lines)
                ids += [doc_id] * len(lines)
                pos += range(len(lines))
                one += [(h >> 64) - (1 << 63) for h in hashes]
                two += [(h & (1 << 64) - 1) - (1 << 63) for h in hashes]
                sizes += windows(np.array(words, np.int64), min_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.list_(pa.int32()))], ["row", "doc_id", "pos", "id1", "id2", "sizes"]
            )

    return common.bounded(docs.select("row", "doc_id", "text")).mapInArrow(cut, "row long, doc_id long, pos int, id1 long, id2 long, sizes array<int>")


def ranked(suffixes: DataFrame, tag: str) -> DataFrame:
    """Suffixes (row, pos, id1, id2) that share (id1, id2) with another: row, pos, rank in the order of (id1, id2).

    The pairs are counted before they are dealt by value, so a frequent pair is one row there. A range
    of pairs lies in one partition, and partitions are in order, so the running number is a rank.
    """
    spark = suffixes.sparkSession
    pairs = suffixes.groupBy("id1", "id2").agg(F.count("*").alias("n")).where("n > 1").select("id1", "id2")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = pairs.repartitionByRange(parts, "id1", "id2").sortWithinPartitions("id1", "id2").select("id1", "id2", F.monotonically_increasing_id().alias("rank"))
    order = common.materialize(order, f"{tag}-order")
    return common.materialize(suffixes.select("row", "pos", "id1", "id2").join(order.hint("merge"), ["id1", "id2"]).select("row", "pos", "rank"), tag)


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """row, pos, m of docs (row, doc_id, text): windows of m lines from pos on that occur earlier, by (doc_id, row, line).

    A null doc_id comes after all others. Windows of one text may overlap, as in a line that repeats.
    """
    lines = common.materialize(lines_of(docs, min_words), "lines")
    owners = lines.select("row", "doc_id", "pos", F.explode("sizes").alias("m"))
    found, k = [], 1
    suffixes = lines
    while k <= min_words:
        ranks = ranked(suffixes, f"ranks-{k}")
        named = owners.where(F.col("m").between(k, 2 * k - 1)).join(ranks.hint("merge"), ["row", "pos"])
        last = ranks.select("row", F.col("pos").alias("last"), F.col("rank").alias("last_rank"))
        named = named.withColumn("last", (F.col("pos") + F.col("m") - k).cast("int")).join(last.hint("merge"), ["row", "last"])
        named = named.select("m", "rank", "last_rank", "row", "pos", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "pos").alias("place"))
        found.append(common.materialize(named, f"windows-{k}"))  # each round's joins are a plan of their own, which keeps the driver's part small
        ahead = ranks.select("row", (F.col("pos") - k).cast("int").alias("pos"), F.col("rank").alias("id2"))
        k *= 2
        if k > min_words:
            break
        suffixes = common.materialize(ranks.withColumnRenamed("rank", "id1").join(ahead.hint("merge"), ["row", "pos"]), f"suffixes-{k}")  # read twice
        if suffixes.isEmpty():
            break
    named = reduce(DataFrame.unionByName, found)
    first = named.groupBy("m", "rank", "last_rank").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.materialize(first.drop("n"), "first-places")  # a join of two tables: adaptive execution can split a frequent interval
    return named.join(first.hint("merge"), ["m", "rank", "last_rank"]).where("place <> first").select("row", "pos", "m")


def without(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """The text without the marked lines (of those with words), the number of lines with words, and how many are gone.

    A line without words goes with the line before it.
    """
    lines, words = split_lines(text)
    keep, at, before = [], 0, True
    for n in words:
        if n:
            before = not gone[at]
            at += 1
        keep.append(before)
    return b"\n".join(x for x, k in zip(lines, keep, strict=True) if k).decode("utf-8", "surrogatepass"), at, int(gone.sum())


def remove_later_copies(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_gone")) -> DataFrame:
    """docs, with all columns, in which text is without the lines of repeated runs that occur earlier; and n_lines, n_gone.

    docs has doc_id and text. Its rows are numbered once, in a table in the shared folder. A run is of min_words words or more, parted
    by ASCII white space; lines are equal if their bytes are, but for white space at their ends. A null
    text stays null with 0 lines; no row is dropped; an empty table gives none. Of repeated rows the first keeps its
    lines. A column of docs that is named as a count stays as it is: the count then has an underscore after its name.
    """
    names, counts = docs.columns, tuple(common.unused(docs, c) for c in counts)
    place, copies, some = (common.unused(docs, n) for n in ("place", "copies", "some"))
    numbered = common.numbered(docs, place)
    with common.scratch(docs.sparkSession):
        found = later_copies(numbered.select(F.col(place).alias("row"), "doc_id", "text"), min_words)
        found = common.materialize(found.groupBy(F.col("row").alias(place)).agg(F.collect_list(F.struct("pos", "m")).alias(copies)), "copies", keep=True)  # bounded by the document's lines
    columns = [*(f"`{n}`" for n in names), copies]
    told = common.probed(numbered, [place], found, some)
    both = told.where(~F.col(some)).withColumn(copies, F.lit(None).cast(found.schema[copies].dataType)).select(*columns)
    both = both.unionByName(told.where(some).join(found.hint("merge"), place, "left").select(*columns))
    at = common.place_of(docs, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, at):
            texts, totals, goes = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                n = sum(1 for w in split_lines(text)[1] if w)
                gone = np.zeros(n, bool)
                for c in own or ():
                    gone[c["pos"] : c["pos"] + c["m"]] = True
                texts.append(without(text, gone)[0] if own else text)
                totals.append(n)
                goes.append(int(gone.sum()))
            columns = [*batch.columns[: len(names)], pa.array(totals, pa.int64()), pa.array(goes, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.bounded(both).mapInArrow(apply, f"{fields}, {counts[0]} long, {counts[1]} long")


def digest(done: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_gone, text_sha256 (of the text that is left; null: empty)."""
    return done.select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


