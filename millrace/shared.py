"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; on one machine, a temporary one if it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="millrace-")  # one machine: tests
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so that a lost executor costs no recomputation.

    Within scratch() the table goes when that ends; one to keep goes with the scratch around it, if there is one.
    """
    path = new_path(df.sparkSession, tag)
    writer = df.write
    if _scratch:  # many short-lived tables of numbers: this codec frees its buffers when a file is closed, not when they are collected
        writer = writer.option("compression", "zstd")
    writer.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are materialized within it; what is returned from it reads kept tables alone.

    The shuffles of its steps are asked to go as well: Spark removes a shuffle's files once the driver's garbage collector has found it unused.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        spark._jvm.System.gc()
