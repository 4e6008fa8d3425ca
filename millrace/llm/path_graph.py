"""Substring dedup: repeated runs of words, found by compacting a De Bruijn graph of words.

Edges are windows of `size` words, nodes the runs of size - 1 words between them; every text is a walk. A walk is cut where
the minimizer of its windows (the least hash of SEED consecutive words within a window) moves on: a segment is a path of edges
that share one minimizer, so equal windows lie in segments of equal minimizers, and only such segments are looked at again.

* Equal segments (128-bit names of their words) are one path with a multiplicity; from two on, all its edges are repeated.
* Different segments of one minimizer are compared edge by edge, each different segment once, whatever its multiplicity.
* A link between two segments does not branch if it occurs as often as either of them. Nonbranching paths of repeated
  segments are compacted by joins (pointer doubling); an occurrence of a path in a text is then one span of words.
* Spans meet the texts by the texts' 128-bit digests. Before a span's words go, they are named again from the text at the
  span's coordinates, and must have the name that the graph has for them.

Texts are shuffled twice, as they meet the requests for edges and the spans; all else is numbers. A frequent window, segment or text is counted
before it is shuffled, and joined back by equi-joins that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import terminal_of

from . import common

SEED = 8
#: Window starts that are worked on at a time.
CHUNK = 1 << 15
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Random values of the 256 bytes in two lanes, and an odd multiplier for each.
BYTES = np.random.default_rng(13).integers(0, 1 << 64, (2, 256), np.uint64)
STEPS = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]
ONE = 1 << 64


class Powers:
    """Powers of a multiplier and of its inverse, modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.bases, self.tables = (base, pow(base, -1, ONE)), [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, t * np.uint64(pow(b, m, ONE))]) for t, b in zip(self.tables, self.bases, strict=True)]
        return self.tables[0], self.tables[1]


POWERS = [Powers(s) for s in STEPS]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places where the words of a text (UTF-8) start and end; words are parted by ASCII white space."""
    inside = np.concatenate([[False], ~WHITE[np.frombuffer(data, np.uint8)], [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def word_names(data: bytes, starts: np.ndarray, ends: np.ndarray, lane: int, most_bytes: int = 1 << 18) -> np.ndarray:
    """A 64-bit name of each word: a polynomial in its bytes, from differences of running sums over a piece of the text."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most_bytes, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        up, down = POWERS[lane].upto(to - at)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[lane][np.frombuffer(data, np.uint8, to - at, at)] * up[: to - at])])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at]
        i = j
    return mixed(out)


class Runs:
    """Names of runs of words, from running sums over the names of at most a chunk of words and a window."""

    def __init__(self, names: np.ndarray, lane: int) -> None:
        up, self.down = POWERS[lane].upto(len(names) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(names * up[: len(names)])])

    def named(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def segments(data: bytes, size: int) -> list[np.ndarray]:
    """Of a text's windows of size words: minimizer, name (two lanes), first window and number of windows of each segment."""
    starts, ends = words_of(data)
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    for a in range(0, len(starts) - size + 1, CHUNK):
        b = min(len(starts), a + CHUNK + size - 1)
        runs = [Runs(word_names(data, starts[a:b], ends[a:b], lane), lane) for lane in (0, 1)]
        n = b - a - size + 1
        seeds = runs[0].named(np.arange(b - a - SEED + 1), SEED)
        least = np.lib.stride_tricks.sliding_window_view(seeds, size - SEED + 1)[:n].argmin(1) + np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(first, n))
        for out, v in zip(found, (seeds[least[first]], *(r.named(first, count + size - 1) for r in runs), first + a, count), strict=True):
            out.append(v)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]


class Named:
    """A text's words, and the names of its runs of words; for the texts that spans or requests meet."""

    def __init__(self, data: bytes, lanes: tuple[int, ...] = (0, 1)) -> None:
        self.starts, self.ends = words_of(data)
        self.lanes = [Runs(word_names(data, self.starts, self.ends, lane), lane) for lane in lanes]

    def named(self, start: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
        return [r.named(start, size) for r in self.lanes]


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... (n of them) for each pair, and how far each is from first."""
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + off, off


def fields_of(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's structs (of integers) begin and end, and the columns of all structs; a null row has none."""
    ends = np.stack([lists.offsets[:-1].to_numpy(), lists.offsets[1:].to_numpy()], 1).astype(np.int64)
    ends[np.asarray(lists.is_null())] = 0
    return ends, [c.fill_null(0).to_numpy() for c in lists.values.flatten()]


def _lists(columns: list[list[np.ndarray]], kinds: list[pa.DataType]) -> list[pa.Array]:
    """Arrow lists of integers, of a list of numpy arrays for each column."""
    out = []
    for column, kind in zip(columns, kinds, strict=True):
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int32)
        values = np.concatenate(column) if column else np.zeros(0, np.int64)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if kind == pa.int64() else values.astype(np.int32))))
    return out


def digested(docs: DataFrame, t1: str, t2: str) -> DataFrame:
    """docs with a 128-bit digest of the text: rows of one digest have equal texts."""
    return docs.withColumns({t1: F.xxhash64(F.lit(1), "text"), t2: F.xxhash64(F.lit(2), "text")})


def walks(docs: DataFrame, size: int) -> DataFrame:
    """A row for each text with a window: t1, t2, ref (number of the row), and of its segments m, s1, s2, first, n (lists)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            keep, found = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = segments((text or "").encode("utf-8", "surrogatepass"), size)
                if len(own[0]):
                    keep.append(i)
                    for c, v in zip(found, own, strict=True):
                        c.append(v)
            if keep:
                lists = _lists(found, [pa.int64()] * 3 + [pa.int32()] * 2)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in (0, 1)), *lists], ["t1", "t2", "m", "s1", "s2", "first", "n"])

    texts = common.bounded(digested(docs.select("text"), "t1", "t2").select("t1", "t2", "text"))
    return texts.mapInArrow(cut, "t1 long, t2 long, m array<long>, s1 array<long>, s2 array<long>, first array<int>, n array<int>").withColumn("ref", F.monotonically_increasing_id())


def shared_segments(table: DataFrame) -> DataFrame:
    """Segments of walks whose minimizer another segment has too: ref, i (number in its text), m, s1, s2, next (s1 of the next segment or null), first, n."""
    # Written, so that the join has an exchange of its own on both sides, whose frequent keys adaptive execution can split.
    often = common.materialize(table.select(F.explode("m").alias("m")).groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "often")
    ahead = F.concat(F.expr("slice(s1, 2, size(s1))"), F.array(F.lit(None).cast("long")))
    each = table.select("ref", F.posexplode(F.arrays_zip("m", "s1", "s2", ahead.alias("next"), "first", "n")).alias("i", "x")).select("ref", "i", "x.m", "x.s1", "x.s2", "x.next", "x.first", "x.n")
    return each.join(often, "m")


def compared(docs: DataFrame, owners: DataFrame, kinds: DataFrame, size: int) -> DataFrame:
    """Repeated windows of segments that occur once: ref, start (a window's first word).

    kinds: the different segments of minimizers that have more than one: sid, ref, first, n, c (how often they occur). Their
    windows are taken from one text that has them; a window is repeated if it is in two segments, or in one that is.
    """
    asked = kinds.join(owners, "ref").groupBy("t1", "t2").agg(F.collect_list(F.struct("sid", "first", "n", "c")).alias("asked"))  # at most a text's segments
    texts = digested(docs.select("text"), "t1", "t2")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in common.slices(batches, 2):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            ends, (sid, first, n, c) = fields_of(batch.column(3))
            for t1, t2, text, (a, b) in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), ends.tolist(), strict=True):
                if before == (t1, t2):  # rows of equal texts come together; one that comes again elsewhere does no harm
                    continue
                before = (t1, t2)
                at, off = spread(first[a:b].astype(np.int64), n[a:b].astype(np.int64))
                for column, v in zip(out, (*Named(text.encode("utf-8", "surrogatepass")).named(at, size), np.repeat(sid[a:b], n[a:b]), off, np.repeat(c[a:b] > 1, n[a:b])), strict=True):
                    column.append(v)
            if out[0]:
                columns = [np.concatenate(c) for c in out]
                kinds = [np.int64, np.int64, np.int64, np.int32, bool]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds, strict=True)], ["e1", "e2", "sid", "off", "many"])

    both = common.bounded(texts.join(asked, ["t1", "t2"]).select("t1", "t2", "text", "asked"))
    table = common.materialize(both.mapInArrow(name, "e1 long, e2 long, sid long, off int, many boolean"), "edges")
    repeated = table.groupBy("e1", "e2").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.max("many").alias("many")).where("many or lo < hi").select("e1", "e2")
    repeated = common.materialize(repeated, "repeated-edges")
    found = table.where("not many").join(repeated, ["e1", "e2"]).groupBy("sid").agg(F.collect_set("off").alias("offs"))  # at most a segment's windows
    return kinds.join(found, "sid").select("ref", "first", F.explode("offs").alias("off")).select("ref", (F.col("first") + F.col("off")).alias("start"))


def repeated_spans(docs: DataFrame, size: int = 35) -> DataFrame:
    """t1, t2, spans (array of start, stop in words) of the texts of docs (text) with windows of size words that start elsewhere too.

    Equal texts have one row. spans also has check_n and check: the number of windows and the name of the segment or window that
    the span starts with.
    """
    with common.scratch(docs.sparkSession):  # what the later steps do not read goes here
        table = common.materialize(walks(docs, size), "walks")
        shared = common.materialize(shared_segments(table), "segments", keep=True)
        owners = common.materialize(table.select("ref", "t1", "t2"), "owners", keep=True)
    kinds = shared.groupBy("m", "s1", "s2").agg(F.count("*").alias("c"), F.min(F.struct("ref", "first", "n")).alias("at"))
    kinds = common.materialize(kinds.select("m", "s1", "s2", "c", "at.ref", "at.first", "at.n").withColumn("sid", F.monotonically_increasing_id()), "kinds")
    # Different segments of one minimizer, one of which occurs once.
    several = common.materialize(kinds.groupBy("m").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1").select("m"), "several")
    single = common.materialize(compared(docs, owners, kinds.join(several, "m", "left_semi").select("sid", "ref", "first", "n", "c"), size), "single")
    # Nonbranching links between repeated segments, and the paths that they make up.
    many = kinds.where("c > 1").select("s1", "c")
    links = shared.where("next is not null").groupBy("s1", "next").agg(F.count("*").alias("c"))
    links = links.join(many, ["s1", "c"], "left_semi").join(many.withColumnRenamed("s1", "next"), ["next", "c"], "left_semi")
    ends = terminal_of(links, "s1", "next").where("terminal is not null").select(F.col("id").alias("s1"), "terminal", "hops")
    paths = common.materialize(kinds.where("c > 1").select("s1", "s2").join(ends, "s1", "left").select("s1", "s2", F.coalesce("terminal", "s1").alias("path"), F.coalesce("hops", F.lit(0)).alias("hops")), "paths")
    walked = shared.join(paths, ["s1", "s2"]).groupBy("ref", "path", (F.col("i") + F.col("hops")).alias("end")).agg(F.min(F.struct("first", "n", "s1")).alias("head"), F.max(F.col("first") + F.col("n")).alias("stop"))
    spans = walked.select("ref", F.col("head.first").alias("start"), (F.col("stop") + size - 1).alias("stop"), F.col("head.n").alias("check_n"), F.col("head.s1").alias("check"))
    alone = single.select("ref", "start", (F.col("start") + size).alias("stop"), F.lit(0).alias("check_n"), F.lit(None).cast("long").alias("check"))
    both = spans.unionByName(alone).join(owners, "ref").groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop", "check_n", "check")).alias("spans"))
    return common.materialize(both, "spans", keep=True)


def without_repeats(docs: DataFrame, size: int = 35, counts: tuple[str, str] = ("n_words", "n_removed"), digest: str | None = None) -> DataFrame:
    """docs, with all columns, in which text is without the words of repeated windows, and n_words, n_removed.

    docs has text and is read from files or a written table. A window is size consecutive words, parted by ASCII white space,
    of one text; its words go, at all places, if the same words start at another place of any text, the same text included.
    Windows are judged on the given texts. The words that stay are joined by a space in a text that loses words; other texts
    stay as they are. digest: also a column of that name with the SHA-256 of the words that stay, joined by a space. A null text stays null and has
    no words; repeated rows are copies like any others; an empty table gives none. A column of docs that is named as a count
    stays as it is: the count then has an underscore after its name.
    """
    names, counts = docs.columns, tuple(common.unused(docs, c) for c in (*counts, *([digest] if digest else [])))
    t1, t2, spans = (common.unused(docs, n) for n in ("t1", "t2", "spans"))
    with common.scratch(docs.sparkSession):
        found = repeated_spans(docs, size)
    found = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(spans))
    both = digested(docs, t1, t2).join(found, [t1, t2], "left").select(*[f"`{n}`" for n in names], spans)
    at = common.place_of(docs, "text")

    def cut(data: bytes, start: np.ndarray, stop: np.ndarray, check_n: np.ndarray, check: np.ndarray) -> tuple[bytes, int, int]:
        """The words that stay, joined by a space, the number of words, and how many go. Spans are verified at their places first."""
        words = Named(data, (0,))
        n, told = len(words.starts), check_n > 0
        if stop.max() > n or (words.named(start[told], check_n[told] + size - 1)[0].view(np.int64) != check[told]).any():
            raise RuntimeError("a text is not as it was when its spans were found")
        goes = np.cumsum(np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(stop, minlength=n + 1)[: n + 1])[:-1] > 0
        edge = np.diff(np.concatenate([[1], goes.astype(np.int8), [1]]))
        runs = zip(words.starts[np.flatnonzero(edge == -1)].tolist(), words.ends[np.flatnonzero(edge == 1) - 1].tolist(), strict=True)
        return b" ".join([b" ".join(data[a:b].split()) for a, b in runs]), n, int(goes.sum())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, at):
            texts, more = [], ([], [], [])
            ends, own = fields_of(batch.column(len(names)))
            for text, (a, b) in zip(batch.column(at).to_pylist(), ends.tolist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if a < b:
                    left, total, gone = cut(data, *(c[a:b].astype(np.int64) for c in own))
                    texts.append(left.decode("utf-8", "surrogatepass"))
                else:
                    parts, gone = data.split(), 0
                    texts.append(text)
                    total, left = len(parts), b" ".join(parts) if digest else b""
                for column, v in zip(more, (total, gone, hashlib.sha256(left).hexdigest() if digest else None), strict=True):
                    column.append(v)
            columns = [*batch.columns[: len(names)], *(pa.array(c, k) for c, k in zip(more, (pa.int64(), pa.int64(), pa.string()), strict=True))][: len(names) + len(counts)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return common.bounded(both).mapInArrow(apply, ", ".join([*fields, *[f"{c} {k}" for c, k in zip(counts, ("long", "long", "string"))]]))
