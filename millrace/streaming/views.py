"""Structured Streaming views: tables that micro-batches keep up to date, equal to their batch recomputation.

A view is a table in buckets of its key. A micro-batch names the keys that it touches; only their buckets are read
and written again, so the cost of a batch follows the batch. Folds are idempotent: a batch that runs again gives
the same table. No row is late: order is by the decision's own tuple, not by arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from millrace.functions import text as T
from millrace.operators.components import connected_components
from millrace.shared import materialize


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads what the source has, in micro-batches, and remembers the position in the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def balanced(rows: DataFrame, bucket: str) -> DataFrame:
    """rows dealt by bucket, for a write of folders: adaptive execution cuts a bucket that has become large into several tasks and files, and gives small ones to one task."""
    return rows.hint("rebalance", F.col(bucket))


class Buckets:
    """A table whose rows lie in folders by a hash of their key; a few folders are replaced at a time.

    The number of buckets is that of the first write: it is in the table's path, and a later n does not change it.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, n: int = 32) -> None:
        self.spark, self.key = spark, key
        top = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        made = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        self.n = next((int(name.split("-")[1]) for name in made if name.startswith("buckets-")), n)
        self.folder = f"{folder.rstrip('/')}/buckets-{self.n}"

    def bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.n))

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: n numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first write."""
        if not self.exists():
            return None
        rows = self.spark.read.parquet(self.folder)
        rows = rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows
        return rows.where("live").drop("live", "bucket")

    def replace(self, buckets: list[int], rows: DataFrame) -> None:
        """Writes rows as the whole content of those buckets; a bucket without rows keeps a mark that it is empty."""
        rows = materialize(rows.withColumns({"live": F.lit(True), "bucket": self.bucket()}), "bucket-rows")
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int").withColumn("live", F.lit(False))
        both = rows.unionByName(marks, allowMissingColumns=True).select(*[c for c in rows.columns if c != "bucket"], "bucket")
        balanced(both, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)


class KeyedView:
    """The best row of each key, by (*order, value)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, value: str, order: list[str]) -> None:
        self.store, self.key, self.value, self.order = Buckets(spark, folder, key), key, value, order

    def reduce(self, rows: DataFrame) -> DataFrame:
        best = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*self.order, self.value)).alias("best"))
        return best.select(self.key, *[F.col(f"best.{c}").alias(c) for c in (*self.order, self.value)])

    def fold(self, batch: DataFrame, _: int = 0) -> None:
        now = materialize(self.reduce(batch), "batch")
        buckets = self.store.touched(now)
        old = self.store.read(buckets)
        self.store.replace(buckets, self.reduce(now.unionByName(old.select(*now.columns))) if old is not None else now)

    def current(self) -> DataFrame | None:
        return self.store.read()


class FreshnessView(KeyedView):
    """The latest time of each source, for thresholds that stay as they were when the view was made."""

    def __init__(self, spark: SparkSession, folder: str, thresholds: DataFrame) -> None:
        super().__init__(spark, f"{folder}/latest", "source", "recorded_at", ["published"])
        self.limits = Buckets(spark, f"{folder}/limits", "source", 1)
        have = self.limits.read()
        if have is None:
            self.limits.replace([0], thresholds)
        elif not (thresholds.exceptAll(have.select(*thresholds.columns)).isEmpty() and have.select(*thresholds.columns).exceptAll(thresholds).isEmpty()):
            raise ValueError("the thresholds differ from those that the view was made for")

    def thresholds(self) -> DataFrame:
        return self.limits.read()


class RecomputedView:
    """A table by key, of which a batch names the keys that it touches, and just these are computed anew.

    recompute(keys) gives the rows of some keys from the whole lake, so a consent that changes, a retraction or a late
    event takes rows out, brings them back or changes them.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, touched: Callable[[DataFrame], DataFrame], recompute: Callable[[DataFrame], DataFrame]) -> None:
        self.store, self.key, self._touched, self.recompute = Buckets(spark, folder, key), key, touched, recompute

    def fold(self, batch: DataFrame, _: int = 0) -> None:
        keys = materialize(self._touched(batch).select(self.key).where(F.col(self.key).isNotNull()).distinct(), "touched")
        buckets = self.store.touched(keys)
        rows, old = self.recompute(keys), self.store.read(buckets)
        self.store.replace(buckets, old.join(keys, self.key, "left_anti").unionByName(rows) if old is not None else rows)

    def rebuild(self, lake: DataFrame, seq: str, high_water: int) -> None:
        """From the rows up to a pinned position, then from those after it, as they stand in the lake by then."""
        self.fold(lake.where(F.col(seq) <= high_water))
        self.fold(lake.where(F.col(seq) > high_water))

    def current(self) -> DataFrame | None:
        return self.store.read()


class Arrivals:
    """What a view has taken in so far, by micro-batch and bucket of the key; nothing else of the source is ever read.

    A batch that runs again replaces what it had written, so nothing is taken twice.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, n: int = 32) -> None:
        self.spark, self.folder, self.key, self.n = spark, folder.rstrip("/"), key, n

    def bucket(self) -> Column:
        return F.pmod(F.hash(self.key), F.lit(self.n))

    def take(self, batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(self.key).isNotNull()).withColumn("arrival_bucket", self.bucket())
        balanced(rows, "arrival_bucket").write.mode("overwrite").partitionBy("arrival_bucket").parquet(f"{self.folder}/arrival={number}")

    def rows(self, like: DataFrame) -> DataFrame:
        """All rows that have arrived, in the columns of like."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return like.where("false")
        schema = StructType([*like.schema.fields, StructField("arrival_bucket", IntegerType()), StructField("arrival", LongType())])
        return self.spark.read.schema(schema).parquet(self.folder)

    def of(self, keys: DataFrame, like: DataFrame, *more: str) -> DataFrame:
        """The rows of some keys that have arrived, from their buckets alone; more: arrival, the number of the batch."""
        here = sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())
        return self.rows(like).where(F.col("arrival_bucket").isin(here)).join(keys, self.key, "left_semi").select(*like.columns, *more)


class ArrivedView(RecomputedView):
    """A table by key, recomputed for the keys that a batch touches from the rows of theirs that have arrived.

    compute(rows) gives a table by key of rows of the stream, which may come late, doubled or in any order.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> None:
        super().__init__(spark, f"{folder}/view", key, lambda batch: batch, compute)
        self.arrivals = Arrivals(spark, f"{folder}/arrived", key)

    def fold(self, batch: DataFrame, number: int = 0) -> None:
        self.arrivals.take(batch, number)
        keys = materialize(batch.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "touched")
        buckets = self.store.touched(keys)
        rows, old = self.recompute(self.arrivals.of(keys, batch)), self.store.read(buckets)
        self.store.replace(buckets, old.join(keys, self.key, "left_anti").unionByName(rows) if old is not None else rows)


class IndexView:
    """Postings (ngram, record_id) of a corpus that changes: what a record had goes, what it has comes in.

    The n-grams of each record are kept beside the postings, so that a batch knows which postings to write again.
    """

    def __init__(self, spark: SparkSession, folder: str, corpus_of: Callable[[DataFrame], DataFrame], text: str = "text", width: int = 3) -> None:
        self.postings, self.forward = Buckets(spark, f"{folder}/postings", "ngram", 64), Buckets(spark, f"{folder}/forward", "record_id")
        self.corpus_of, self.text, self.width = corpus_of, text, width

    def fold(self, batch: DataFrame, _: int = 0) -> None:
        keys = materialize(batch.select("record_id").distinct(), "touched")
        new = materialize(self.corpus_of(keys).select("record_id", T.ngrams(F.col(self.text), self.width, self.width).alias("ngrams")), "new-ngrams")
        here = self.forward.touched(keys)
        had = self.forward.read(here)
        old = had.join(keys, "record_id", "left_semi") if had is not None else new.where("false")
        each = lambda f: f.select(F.explode("ngrams").alias("ngram"), "record_id")
        there = self.postings.touched(each(old.unionByName(new)))
        listed = self.postings.read(there)
        added = each(new)
        self.postings.replace(there, listed.join(keys, "record_id", "left_anti").unionByName(added) if listed is not None else added)
        self.forward.replace(here, had.join(keys, "record_id", "left_anti").unionByName(new) if had is not None else new)


class ComponentsView:
    """Connected components under new edges: a batch joins components, and only nodes of joined ones are written again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.store = Buckets(spark, folder, "node")

    def fold(self, batch: DataFrame, _: int = 0) -> DataFrame:
        """Takes edges (a, b) in; returns the components that have changed, as they are now (node, component)."""
        edges = materialize(batch.select("a", "b").where("a is not null and b is not null").distinct(), "new-edges")
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        have = self.store.read()
        known = nodes.join(have, "node", "left") if have is not None else nodes.withColumn("component", F.col("node"))
        known = materialize(known.select("node", F.coalesce("component", "node").alias("component")), "known")
        of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        joined = connected_components(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
        rows = known if have is None else have.join(joined.select("component"), "component", "left_semi").unionByName(known, allowMissingColumns=True).distinct()
        changed = materialize(rows.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")).groupBy("node").agg(F.min("component").alias("component")), "joined")
        buckets = self.store.touched(changed)
        old = self.store.read(buckets)
        self.store.replace(buckets, old.join(changed, "node", "left_anti").unionByName(changed) if old is not None else changed)
        return changed

    def current(self) -> DataFrame | None:
        return self.store.read()


def propagate(order: list[str], sources: dict[str, list[str]], build: Callable[[str], None]) -> dict[str, str]:
    """Builds projections in order; what depends on one that failed is degraded and not built."""
    state: dict[str, str] = {}
    for name in order:
        if any(state.get(s) in ("broken", "degraded") for s in sources.get(name, [])):
            state[name] = "degraded"
            continue
        try:
            build(name)
            state[name] = "ok"
        except Exception as e:  # noqa: BLE001  one projection's failure must not stop the others
            state[name] = "broken"
            print(f"{name}: {e}")
    return state


def advanced(watermarks: DataFrame, positions: DataFrame) -> DataFrame:
    """projection, leaf, position after a commit: never less than before."""
    return watermarks.unionByName(positions).groupBy("projection", "leaf").agg(F.max("position").alias("position"))
