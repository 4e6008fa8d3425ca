"""Write operators: idempotent append, versioned streams, managed records, projection deltas and generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.shared import materialize


def classify_append(batch: DataFrame, lake: DataFrame | None = None, key: str = "idempotency_key", content: str = "canonical", seq: str = "seq") -> DataFrame:
    """batch with outcome: appended (first row of its key), duplicate (equal content) or conflict.

    The first row of a key is found by aggregation, so a key with many rows is one row before the join
    back. A key that the lake (key, content) has is never appended. A null key is never equal to another.
    """
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(seq, content)).alias("first"))
    if lake is not None:
        known = lake.groupBy(key).agg(F.min(content).alias("known"))
        first = first.join(known, key, "left")
    else:
        first = first.withColumn("known", F.lit(None).cast("string"))
    wanted = F.coalesce("known", F.col(f"first.{content}"))
    outcome = (
        F.when(F.col(key).isNull() | (F.col("known").isNull() & (F.col(seq) == F.col(f"first.{seq}"))), "appended")
        .when(F.col(content).eqNullSafe(wanted), "duplicate")
        .otherwise("conflict")
    )
    return batch.join(first, key, "left").withColumn("outcome", outcome).drop("first", "known")


def append(batch: DataFrame, path: str, key: str = "idempotency_key", content: str = "canonical", seq: str = "seq", buckets: int = 64) -> DataFrame:
    """Appends the new rows of a batch to a Parquet lake in folders by a hash of the key, once each, and returns the outcomes.

    Of the lake, key and content of the folders that the batch touches are read, and no others. A batch that runs again
    finds its own rows as duplicates. For one writer at a time.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    lake = None
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # buckets numbers at most
        lake = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(key, content)
    outcomes = materialize(classify_append(batch, lake, key, content, seq), "outcomes")
    outcomes.where("outcome = 'appended'").drop("outcome").withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)
    return outcomes


def stream_append(requests: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Optimistic appends to streams: requests (seq, stream_id, expected_version, idempotency_key), events (stream_id, stream_version, idempotency_key).

    In order of seq: a request whose key the stream has is a duplicate, one whose expected version is the
    stream's is appended, any other is a version_conflict. An appended request is followed by the first
    later one that expects the next version, so appended requests are the chain from the first request
    that expects the stream's version; the chain is followed by pointer doubling, whatever its length.
    Requests with one key are retries and expect the same version.
    """
    rows = requests.withColumns({"had": F.lit(None).cast("boolean"), "version": F.lit(0).cast("long")})
    if events is not None:
        known = events.select("stream_id", "idempotency_key").distinct().withColumn("had", F.lit(True))
        versions = events.groupBy("stream_id").agg(F.max("stream_version").cast("long").alias("version"))
        rows = requests.join(known, ["stream_id", "idempotency_key"], "left").join(versions, "stream_id", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    rows = materialize(rows.select("seq", "stream_id", F.col("expected_version").cast("long").alias("expected_version"), "idempotency_key", "had", "version"), "requests")
    fresh = rows.where("had is null")
    wanting = fresh.select("stream_id", "seq", (F.col("expected_version") + 1).alias("v"), F.lit(None).cast(rows.schema["seq"].dataType).alias("found"))
    offering = fresh.select("stream_id", "seq", F.col("expected_version").alias("v"), F.col("seq").alias("found"))
    later = Window.partitionBy("stream_id", "v").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    jump = wanting.unionByName(offering).withColumn("next", F.min("found").over(later)).where("found is null and next is not null").select("stream_id", "seq", "next")
    reached = fresh.where("expected_version = version").groupBy("stream_id").agg(F.min("seq").alias("seq"))
    jump, reached = materialize(jump, "jump"), materialize(reached, "reached")
    while True:
        more = materialize(reached.join(jump, ["stream_id", "seq"]).select("stream_id", F.col("next").alias("seq")), "reached")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        far = jump.select("stream_id", F.col("seq").alias("next"), F.col("next").alias("after"))
        jump = materialize(jump.join(far, ["stream_id", "next"]).select("stream_id", "seq", F.col("after").alias("next")), "jump")
    taken = reached.withColumn("taken", F.lit(True))
    out = rows.join(taken, ["stream_id", "seq"], "left")
    keys = out.where("taken").groupBy("stream_id", "idempotency_key").agg(F.min("seq").alias("first_taken"))
    out = out.join(keys, ["stream_id", "idempotency_key"], "left")
    outcome = F.when(F.col("had") | (F.col("first_taken") < F.col("seq")), "duplicate").when(F.col("taken"), "appended").otherwise("version_conflict")
    return out.select("seq", "stream_id", "expected_version", "idempotency_key", outcome.alias("outcome"))


def record_versions(records: DataFrame) -> DataFrame:
    """Versions of managed records (id, seq, mutability): version from 1, whether it is current, and whether it is accepted.

    An append_only record keeps its first row; later ones are rejected.
    """
    by = Window.partitionBy("id").orderBy("seq")
    numbered = records.withColumn("version", F.row_number().over(by)).withColumn("first_kind", F.first("mutability").over(by))
    numbered = numbered.withColumn("accepted", (F.col("version") == 1) | (F.col("first_kind") == "managed_cache"))
    last = Window.partitionBy("id").orderBy(F.col("accepted").desc(), F.col("seq").desc())
    return numbered.withColumn("is_current", F.row_number().over(last) == 1).drop("first_kind")


def apply_delta(items: DataFrame, delta: DataFrame, key: str = "item_key") -> DataFrame:
    """Items after a delta (op insert, update or delete, and the item's columns); every broken rule is an error.

    Inserts of present keys, updates and deletes of absent keys, and keys that occur twice are refused.
    """
    names = [c for c in items.columns if c != key]
    both = items.alias("i").join(delta.alias("d"), key, "full_outer")
    bad = both.select(
        F.sum(((F.col("op") == "insert") & F.col(f"i.{names[0]}").isNotNull()).cast("int")).alias("a"),
        F.sum((F.col("op").isin("update", "delete") & F.col(f"i.{names[0]}").isNull()).cast("int")).alias("b"),
    ).first()
    twice = delta.groupBy(key).count().where("count > 1").limit(1).count()
    if (bad["a"] or 0) + (bad["b"] or 0) + twice:
        raise ValueError(f"refused delta: {bad['a'] or 0} inserts of present keys, {bad['b'] or 0} changes of absent keys, repeated keys: {bool(twice)}")
    kept = both.where("op is null or op <> 'delete'")
    return kept.select(key, *[F.when(F.col("op").isNotNull(), F.col(f"d.{n}")).otherwise(F.col(f"i.{n}")).alias(n) for n in names])


class Generations:
    """Blue-green publication: a generation is written whole, then a pointer table names it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return self.spark.read.schema("n long, generation string").parquet(f"{self.folder}/pointers")

    def publish(self, items: DataFrame) -> str:
        """Writes a generation, then adds the pointer to it; readers see the old one until then."""
        name = uuid.uuid4().hex
        items.write.parquet(f"{self.folder}/generation={name}")
        return self._point(name)

    def _point(self, name: str) -> str:
        pointers = self._pointers()
        n = (pointers.agg(F.max("n")).first()[0] or 0) if pointers is not None else 0
        self.spark.createDataFrame([(n + 1, name)], "n long, generation string").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")
        return name

    def publish_all(self, relations: dict[str, DataFrame]) -> str:
        """Several relations as one generation: readers see all of them or none."""
        name = uuid.uuid4().hex
        for relation, rows in relations.items():
            rows.write.parquet(f"{self.folder}/generation={name}/{relation}")
        return self._point(name)

    def rollback(self, generation: str) -> str:
        """Makes an older generation the head again; those after it stay until they are cleaned up."""
        return self._point(generation)

    def cleanup(self, keep: int = 2) -> list[str]:
        """Removes the folders of all generations but the head and the keep newest; returns their names."""
        pointers = self._pointers()
        if pointers is None:
            return []
        last = pointers.groupBy("generation").agg(F.max("n").alias("n")).withColumns({"projection": F.lit(self.folder), "pinned": F.lit(False)})
        gone = [r["generation"] for r in retired(last, keep).collect()]  # one row a generation
        for name in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation={name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return gone

    def head(self) -> str | None:
        pointers = self._pointers()
        return pointers.agg(F.max_by("generation", "n")).first()[0] if pointers is not None else None

    def read(self, generation: str | None = None, relation: str = "") -> DataFrame | None:
        """The published items (or one of several relations), or those of a pinned generation; None before the first (an empty one is a table)."""
        name = generation or self.head()
        return self.spark.read.parquet(f"{self.folder}/generation={name}/{relation}".rstrip("/")) if name else None


def retired(generations: DataFrame, keep: int) -> DataFrame:
    """projection, generation of those that neither are among the keep newest (by n) of their projection nor are pinned: what may be cleaned up."""
    nth = F.row_number().over(Window.partitionBy("projection").orderBy(F.desc("n")))
    return generations.withColumn("nth", nth).where((F.col("nth") > keep) & ~F.coalesce("pinned", F.lit(False))).select("projection", "generation")


def orphans(blobs: DataFrame, references: DataFrame, key: str = "blob_ref") -> DataFrame:
    return blobs.join(references.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, at: str, now: str, days: int) -> DataFrame:
    return rows.where(F.col(at) >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


def blob_refs(data: DataFrame, content: str = "data") -> DataFrame:
    """Content-addressed blobs: blob_ref, data; equal contents once."""
    return data.select(F.concat(F.lit("blob:sha256:"), F.sha2(content, 256)).alias("blob_ref"), content).dropDuplicates(["blob_ref"])


def identity_bridge(rows: DataFrame, key: str = "v2_key", seq: str = "append_seq", content: str = "canonical") -> DataFrame:
    """For each new key: the winner (lowest position), how many rows have it, and whether their contents differ."""
    agg = rows.groupBy(key).agg(F.min_by("id", seq).alias("winner"), F.count("*").alias("multiplicity"), F.min(content).alias("lo"), F.max(content).alias("hi"))
    return agg.select(key, "winner", "multiplicity", (F.col("lo") != F.col("hi")).alias("collision"))
