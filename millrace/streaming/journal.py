"""Tables in buckets that one batch changes together, exactly once.

What a batch changes is first written to a journal under its number: the whole new content of the buckets that it touches, and at
last, by a rename, that it is whole. Then the buckets are replaced. A batch that runs again after a fault finds its
journal and replaces them again, with the same content; it is not computed a second time, so sums count it once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import materialize
from millrace.streaming.views import Buckets


class Journal:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str]) -> None:
        """tables: their names and keys."""
        self.spark, self.folder = spark, f"{folder}/journal"
        self.tables = {name: Buckets(spark, f"{folder}/{name}", key) for name, key in tables.items()}
        self._changes: dict[str, list[int]] = {}
        self._number = 0

    def _ready(self, number: int):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}/ready")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def looked_up(self, table: str, keys: DataFrame, like: str) -> DataFrame:
        """The rows of some keys, from their buckets; an empty table (like: its schema) before the first batch."""
        store = self.tables[table]
        rows = store.read(store.touched(keys))
        return rows.join(keys, store.key, "left_semi") if rows is not None else self.spark.createDataFrame([], like)

    def change(self, table: str, gone: DataFrame, rows: DataFrame) -> None:
        """Notes that keys (gone, and those of rows) give way to rows."""
        store = self.tables[table]
        rows = materialize(rows, table)
        keys = materialize(gone.select(store.key).unionByName(rows.select(store.key)).distinct(), "keys")
        buckets = store.touched(keys)
        old = store.read(buckets)
        whole = old.join(keys, store.key, "left_anti").unionByName(rows) if old is not None else rows
        whole.write.mode("overwrite").parquet(f"{self.folder}/{self._number}/{table}")
        self._changes[table] = buckets

    def once(self, number: int, note: Callable[[], None]) -> None:
        """Applies the changes that note makes (change, once for each table), unless the journal has them from an earlier run; then those."""
        fs, ready = self._ready(number)
        if not fs.exists(ready):
            self._changes, self._number = {}, number
            note()
            aside = ready.suffix("-aside")
            out = fs.create(aside, True)
            out.write(bytearray(json.dumps(self._changes).encode()))
            out.close()
            fs.rename(aside, ready)
        buckets = json.loads(self.spark.read.text(str(ready), wholetext=True).first().value)
        for table in buckets:
            self.tables[table].replace(buckets[table], self.spark.read.parquet(f"{self.folder}/{number}/{table}"))


class BridgeView:
    """The bridge from new identities to stored rows, kept page by page: of each key the row of the least position, how many rows have it, and whether their contents differ.

    The state of a key (least position, number, two digests) adds up in any order, so pages may come in any; each counts once.
    """

    STATE = "v2_key string, first struct<seq: bigint, id: string>, n bigint, lo string, hi string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.journal = Journal(spark, folder, {"bridge": "v2_key"})

    def fold(self, page: DataFrame, number: int = 0) -> None:
        """Takes in a page of rows: v2_key, append_seq, id, canonical. Rows without a key have no identity and make no state."""

        def note() -> None:
            rows = page.where("v2_key is not null")
            content = F.sha2(F.coalesce("canonical", F.lit("")).cast("binary"), 256)
            new = rows.groupBy("v2_key").agg(F.min(F.struct(F.col("append_seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"))).alias("first"), F.count("*").alias("n"), F.min(content).alias("lo"), F.max(content).alias("hi"))
            new = materialize(new, "bridge-page")
            both = self.journal.looked_up("bridge", new.select("v2_key"), self.STATE).unionByName(new)
            self.journal.change("bridge", new, both.groupBy("v2_key").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))

        self.journal.once(number, note)

    def current(self) -> DataFrame | None:
        rows = self.journal.tables["bridge"].read()
        return None if rows is None else rows.selectExpr("v2_key", "first.id AS winner", "n AS multiplicity", "lo <> hi AS collision")
