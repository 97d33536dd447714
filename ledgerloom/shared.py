"""Helpers that every part of the library uses: shared scratch tables, checked broadcasts, row positions."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows, counted first.
BROADCAST_ROWS = 1_000_000


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-ledgerloom-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local master has one of its own;
    on a cluster, whose executors could not read it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _own_folder()


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgerloom/{spark.sparkContext.applicationId}"


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@functools.cache
def _delete_at_the_end(spark: SparkSession, folder: str) -> None:
    path, system = _files(spark, folder)
    system.deleteOnExit(path)


#: The folder of the scratch tables of what runs now, below the application's; empty outside scratch().
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path among this application's scratch tables, which go when it ends, by release(), or with their scratch()."""
    folder = _application_folder(spark)
    _delete_at_the_end(spark, folder)
    return f"{folder}{_owner.get()}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside go at its end, those of others stay. What is returned must be written or
    collected inside, as it may read them. Scopes may be nested, and threads have their own."""
    token = _owner.set(f"{_owner.get()}/{uuid.uuid4().hex}")
    own = f"{_application_folder(spark)}{_owner.get()}"
    try:
        yield
    finally:
        _owner.reset(token)
        path, system = _files(spark, own)
        system.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that have not been written or collected are lost with them."""
    path, system = _files(spark, _application_folder(spark))
    system.delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count finds at most so many (narrow) rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def with_position(df: DataFrame, keys: list[Column], label: str, position: str = "position") -> DataFrame:
    """Add the 0-based place of each row in the order of keys."""
    return running_totals(df, keys, label, {position: F.lit(1)})


def sorted_parts(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """df written in the order of keys, with _part (partitions follow that order) and _row (rows of a partition do).

    Rows are dealt by range, so rows that share the first keys are as many partitions as their number asks for."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), label)


def last_before(parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """sorted_parts() whose order begins with keys, with the last value that is not null at or before each row of the same keys.

    Values run on inside each partition; of a key that goes over partitions, the last value of each one is
    carried over to those behind it. So one busy key is the work of many tasks."""
    seen = parts.withColumn("_seen", value)
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = seen.withColumn(name, F.last("_seen", ignorenulls=True).over(inside)).drop("_seen")
    ends = seen.groupBy(*keys, "_part").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_row"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).filter(F.col("_carried").isNotNull())
    carried = broadcast_if_small(carried.select(F.col("_part").alias("_into"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_carried"))
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_into"))
    met = run.join(carried, same, "left").withColumn(name, F.coalesce(name, "_carried"))
    return met.drop("_into", "_carried", *[f"_key{i}" for i in range(len(keys))])


def running_totals(df: DataFrame, keys: list[Column], label: str, amounts: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its (whole) amount over all rows before this one in the order of keys.

    Rows are dealt by range and sorted inside each partition; only one figure per partition and amount
    meets in one place. Rows with equal keys come in any order, so keys should settle ties that matter.
    """
    steps = {f"_step{i}": amount.cast("long") for i, amount in enumerate(amounts.values())}
    dealt = sorted_parts(df.withColumns(steps), keys, label)
    order = Window.partitionBy("_part").orderBy("_row")
    out = dealt
    for i, name in enumerate(amounts):
        out = out.withColumn(name, F.sum(f"_step{i}").over(order) - F.col(f"_step{i}"))
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_step{i}").alias(f"_sum{i}") for i in range(len(amounts))])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_offset{i}") for i in range(len(amounts))])
    out = out.join(offsets, "_part").withColumns({name: F.col(name) + F.col(f"_offset{i}") for i, name in enumerate(amounts)})
    return out.drop("_part", "_row", *steps, *[f"_offset{i}" for i in range(len(amounts))])


def part_offsets(df: DataFrame, part: str, amount: Column) -> DataFrame:
    """For each partition number the sum of amount over all smaller ones; a row per partition."""
    totals = df.groupBy(part).agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
