"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that one sieve holds, a byte each; beyond them rows pass as they are.
SIEVE_KEYS = 16_000_000
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one beside the warehouse of a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_checkpoints"
        if (not found.partition("://")[1] or found.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: what several steps read is worked out once, and a lost executor costs no more than its own step.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    with _swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *works: Callable) -> list:
    """What each of ``works`` returns; they need nothing of each other and run at the same time, as small jobs leave most cores idle."""
    with _swept(spark), ThreadPoolExecutor(len(works)) as pool:  # the setting holds until the last of them ends
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in works]]


def sieved(rows: DataFrame, key: str, own: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``own``, by a Bloom filter, ahead of a join that decides exactly."""
    spark = rows.sparkSession
    keys = own.select(F.xxhash64(key).alias("h"))
    n = keys.count()
    if not 0 < n <= SIEVE_KEYS:
        return rows
    out = spark._jvm.java.io.ByteArrayOutputStream()
    keys._jdf.stat().bloomFilter("h", n, 0.03).writeTo(out)
    # read as a subquery: as a literal its bytes would stand in every text of the plan
    bits = spark.createDataFrame([(bytearray(out.toByteArray()),)], "bits binary").scalar()
    jvm = spark._jvm.org.apache.spark.sql
    of = lambda c: jvm.classic.ExpressionUtils.expression(c._jc)
    return rows.where(Column(jvm.classic.ExpressionUtils.column(jvm.catalyst.expressions.BloomFilterMightContain(of(bits), of(F.xxhash64(key))))))
