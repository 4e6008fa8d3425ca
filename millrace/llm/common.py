"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import materialize, new_path, scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bounded(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """df, whose session from now on hands batches of about most_bytes at most to Python, however long the texts are."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > most_bytes:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    return df


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, whose name may be written in other case, as Spark allows."""
    return [c.lower() for c in df.columns].index(name.lower())


def with_key(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """df with two 64-bit hashes of all its columns (maps aside, which have none): rows of one key are equal."""
    columns = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    nulls = F.concat(*[c.isNull().cast("string") for c in columns])  # a null leaves a hash as it is
    return df.withColumns({k1: F.xxhash64(F.lit(1), nulls, *columns), k2: F.xxhash64(F.lit(2), nulls, *columns)})


def keep_keys(df: DataFrame, every: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of df whose key (with_key) is in kept, one for each; every has the keys of all rows (k1, k2), kept some of them, once each.

    The rows that go are named by an anti join with the keys that go, which are mostly few; rows that a Bloom filter
    of these rules out take no part in it. Keys of repeated rows go with them, and one row of each that is kept comes back.
    """
    names = [f"`{n}`" for n in df.columns]
    k1, k2 = unused(df, "k1"), unused(df, "k2")
    each = every.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").where("n > 1 or stays is null")
    each = materialize(each.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.coalesce("stays", F.lit(False)).alias(unused(df, "stays"))), "keys-gone", keep=True)
    some = unused(df, "some")
    keyed = probed(with_key(df, k1, k2), [k1, k2], each, some)
    left = keyed.where(~F.col(some)).select(*names)
    keyed = keyed.where(some)
    left = left.unionByName(keyed.join(each, [k1, k2], "left_anti").select(*names))
    again = each.where(f"`{unused(df, 'stays')}`")
    if again.isEmpty():
        return left
    return left.unionByName(keyed.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*names))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, in a column of that name, written once: two scans of the same files may split them
    differently, and then number their rows differently."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def bloom_place(h: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a 64-bit hash in a Bloom filter of so many blocks, and its four bits there."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom(hashes: DataFrame, keys: int, most_blocks: int = 1 << 17, keys_per_block: int = 4) -> tuple[DataFrame, int]:
    """block, word of the filter over hashes (bloom_hash), at most most_blocks rows; the number of blocks."""
    blocks = max(1, min(most_blocks, math.ceil(keys / keys_per_block)))
    block, bits = bloom_place(F.col("bloom_hash"), blocks)
    return hashes.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word")), blocks


def probed(df: DataFrame, keys: list[str], named: DataFrame, flag: str) -> DataFrame:
    """df with a flag: whether the row's keys may be among those of named (the same columns, a written table).

    Told by a broadcast Bloom filter of bounded size, so a join with named need not shuffle the rows that have no match. A key that is
    there is always flagged; of the others some may be.
    """
    hashed = F.xxhash64(F.lit("bloom"), *[F.col(f"`{k}`") for k in keys])
    words, blocks = bloom(named.select(hashed.alias("bloom_hash")), named.count())
    words = materialize(words, "bloom-words", keep=True)
    block, word = unused(df, "bloom_block"), unused(df, "bloom_word")
    at, bits = bloom_place(hashed, blocks)
    both = df.withColumn(block, at).join(F.broadcast(words.select(F.col("block").alias(block), F.col("word").alias(word))), block, "left")
    return both.select(*[f"`{c}`" for c in df.columns], F.coalesce(F.col(word).bitwiseAND(bits) == bits, F.lit(False)).alias(flag))


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column (by name or place) of each holds about most_bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def bounded_rows(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that some binary columns of each hold about most_bytes together at most, or one row."""
    for batch in batches:
        sizes = sum(pa.compute.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Columns (integers without nulls) of sorted rows, cut only between groups of equal keys.

    A group of more than most rows comes in parts instead, each alone and marked with True.
    """
    held: dict[str, np.ndarray] = {}
    over: dict | None = None  # key of a group that comes in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        now = {n: np.concatenate([held[n], c]) for n, c in now.items()} if held else now
        held = {}
        if over:
            n = int(np.logical_and.reduce([now[k] == over[k] for k in keys]).sum())
            if n:
                yield {k: c[:n] for k, c in now.items()}, True
            if n == len(now[keys[0]]):
                continue
            now, over = {k: c[n:] for k, c in now.items()}, None
        last = int(np.logical_and.reduce([now[k] == now[k][-1] for k in keys]).sum())
        if last < len(now[keys[0]]):
            yield {k: c[:-last] for k, c in now.items()}, False
        held = {k: c[-last:] for k, c in now.items()}
        if last > most:
            yield held, True
            over, held = {k: held[k][0] for k in keys}, {}
    if held:
        yield held, False
