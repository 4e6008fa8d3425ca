"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard file holds one frame for each document in ascending doc_id order, then a skippable frame with
the documents' ids, then the seek table of the public zstd seekable format (sizes and the low 32 bits
of XXH64 of each frame's content), so a reader fetches and decompresses only the frames it wants.

Files are written and read by Spark itself, on any file system that it knows, and a task that runs again
leaves one file: a row of the text writer is a chunk of a file, and the line separator is the format's last
four bytes. A chunk that is not the last ends with the head of a skippable frame of four bytes, so that the
separator after it is such a frame's content.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Fixed values of the public formats.
SKIPPABLE, SEEK_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LAST = struct.pack("<I", SEEK_MAGIC)
END_ID = 1
NO_ID = -(1 << 63)  # stands for a null doc_id in the id list


class ShardWriter:
    """Makes the chunks of a file: each is written with LAST after it."""

    def __init__(self, most: int = 4 << 20) -> None:
        self.held, self.size, self.most, self.entries, self.doc_ids = [], 0, most, [], []

    def _entry(self, size: int, content_size: int, checksum: int) -> None:
        self.entries.append(struct.pack("<III", size, content_size, checksum))

    def _chunk(self) -> bytes:
        out, self.held, self.size = b"".join(self.held), [], 0
        return out

    def add(self, doc_id: int | None, frame: bytes, content_size: int, checksum: int) -> Iterator[bytes]:
        self.held.append(frame)
        self.size += len(frame)
        self._entry(len(frame), content_size, checksum)
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        if self.size > self.most:
            self.held.append(struct.pack("<II", SKIPPABLE, len(LAST)))
            self._entry(8 + len(LAST), 0, xxhash.xxh64_intdigest(LAST) & 0xFFFFFFFF)
            yield self._chunk()

    def close(self) -> bytes:
        ids = np.asarray(self.doc_ids, "<i8").tobytes()
        self.held.append(struct.pack("<II", SKIPPABLE, len(ids)) + ids)
        self._entry(8 + len(ids), 0, 0)
        table = b"".join(self.entries)
        self.held.append(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table + struct.pack("<IB", len(self.entries), 0x80))
        return self._chunk()


class ShardReader:
    """Reads the seek table of a file that can seek, then single frames on demand. Documents' frames have content; others have none."""

    def __init__(self, source, width: int = 2) -> None:
        self.source, self.dtype = source, f"<u{width}"
        end = source.seek(0, 2)
        end = source.tell() if end is None else end
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        documents = np.flatnonzero(table[:, 1])
        self.table, self.starts = table[documents], starts[documents]
        self.doc_ids = np.frombuffer(self._at(int(starts[n - 1]) + 8, 8 * len(documents)), "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        size, content_size, checksum = self.table[k].tolist()
        data = self.unpack.decompress(self._at(int(self.starts[k]), size), max_output_size=content_size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(data, self.dtype)

    def document(self, doc_id: int) -> np.ndarray:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        if k == len(self.doc_ids) or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.frame(k)


def keys(docs: DataFrame) -> DataFrame:
    """docs with d and h, by which documents are ordered: doc_id (null first), then a hash of the text; and size."""
    return docs.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"))


def shard_bounds(docs: DataFrame, shard_bytes: int, per_shard: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ascending (d, h) that part keys() into shards of about shard_bytes of text.

    The driver gets the keys of about per_shard sampled rows for each shard, once each however often they repeat. A key that is
    heavier than a shard stands there several times: its equal rows are dealt over as many shards.
    """
    n, size = docs.agg(F.count("*"), F.sum("size")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    if shards == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, per_shard * shards / n)
    sample = docs.where(F.rand(7) < share).groupBy("d", "h").agg(F.sum("size").alias("size")).toPandas().sort_values(["d", "h"])
    upto = np.cumsum(sample["size"].to_numpy(np.float64))
    if not len(upto):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return sample["d"].to_numpy(np.int64)[at], sample["h"].to_numpy(np.int64)[at]


def shard_of(d: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], nth: int) -> np.ndarray:
    """The number of bounds below each key; a key that is a bound several times takes them in turn, from nth on."""
    low, high = np.searchsorted(bounds[0], d, "left"), np.searchsorted(bounds[0], d, "right")
    out = low.astype(np.int64)
    rows = np.flatnonzero(low < high)  # some bounds have this d
    for a in np.unique(low[rows]).tolist():
        mine = rows[low[rows] == a]
        own = bounds[1][a : int(high[mine[0]])]
        left, right = np.searchsorted(own, h[mine], "left"), np.searchsorted(own, h[mine], "right")
        out[mine] = a + left + (nth + mine) % np.maximum(right - left, 1)
    return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, shard_bytes: int = 64 << 20, level: int = 3, width: int = 2) -> str:
    """Encodes every document and writes the shard files into a new folder, part-00000 and so on; returns the folder.

    docs: doc_id, text; other columns are not read. A null or empty text is the end id alone. Documents of equal
    doc_id lie side by side in the order of a hash of their text; those without doc_id come first, and neither they
    nor repeated rows share a shard if they are too many for one. A task that reads a file holds it whole, so shard_bytes bounds
    its memory. An empty table gives no file with content.
    """
    docs = keys(docs.select("doc_id", "text"))
    bounds = shard_bounds(docs, shard_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack, nth = encoder(tokenizer), zstandard.ZstdCompressor(level=level), 0
        for batch in common.slices(batches, most_bytes=1 << 20):
            ids, sizes = enc.encode(batch.column(1).to_pylist())
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError("an id does not fit the width of the file")
            frames, checks, ends = [], [], np.cumsum(sizes)
            for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                data = np.append(ids[end - n : end], END_ID).astype(f"<u{width}").tobytes()
                frames.append(pack.compress(data))
                checks.append(xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
            d, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            shard = shard_of(d, h, bounds, nth)
            nth += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), batch.column(2), batch.column(3), pa.array(sizes + 1, pa.int64()), pa.array(checks, pa.int64()), pa.array(frames, pa.binary())], ["shard", "doc_id", "d", "h", "n_tokens", "checksum", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter()
        for batch in batches:
            for doc_id, n, check, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for chunk in writer.add(doc_id, frame, n * width, check):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["chunk"])
        if writer.doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["chunk"])

    frames = common.bounded(docs).mapInArrow(encode, "shard int, doc_id long, d long, h long, n_tokens long, checksum long, frame binary")
    dealt = frames.repartitionById(len(bounds[0]) + 1, F.col("shard")).sortWithinPartitions("d", "h", "frame")
    chunks = dealt.select("doc_id", "n_tokens", "checksum", "frame").mapInArrow(write, "chunk binary")
    chunks.select(F.col("chunk").cast("string")).write.option("lineSep", LAST.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """One row a document from the files of a folder: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Each file is read once; where a file's ids start comes from the files' sums, added up within groups of 1024 files
    and over the groups, of which the driver holds a number each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(pa.BufferReader(content.as_buffer()), width)
                n = len(reader.doc_ids)
                sizes, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k in range(n):
                    ids = reader.frame(k)
                    sizes[k], sums[k] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int32()), pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums)], ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard")
    found = common.materialize(common.bounded(files.select(shard, "content")).mapInArrow(read, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-documents")
    each = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.col("shard").bitwiseAND(-1024))
    totals = sorted(each.groupBy("group").agg(F.sum("n")).collect())
    before = dict(zip([g for g, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False)) or {0: 0}
    groups = spark.createDataFrame([*before.items()], "group int, before long")
    own = F.sum("n").over(Window.partitionBy("group").orderBy("shard")) - F.col("n")
    bases = each.join(groups, "group").select("shard", (own + F.col("before")).alias("base"))
    return found.join(bases, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
