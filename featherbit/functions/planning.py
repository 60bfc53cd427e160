"""Helpers that shape a plan: checkpoints, columns evaluated once, the package on the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_deleted: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so that lineage ends there and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table by columns: for wide rows of which later steps read a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below the session's spark.checkpoint.dir, deleted when the driver's JVM ends.

    Only where that is unset and all runs on this machine (tests), a temporary one is made: executors elsewhere couldn't read it.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="featherbit-"))
    own = sc._jsc.sc().getCheckpointDir().get()
    if own not in _deleted:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _deleted.add(own)
    return own


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with dense numbers from 0 by ``order``: ranges are counted, and each row's number is its range's start plus its place."""
    parts = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn("_r", place).join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + F.col("_r")).cast("bigint")).drop("_p", "_r", "_start")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of fewer tasks than cores (one small file) dealt out to all cores; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row.

    Catalyst merges projections and then evaluates a costly expression anew at each of its uses, inside a lambda even once
    per element. A generator is a border that it doesn't merge across.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python need not have it on its path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    package = Path(__file__).resolve().parents[1].name
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='featherbit-')}/{package}", "zip", root, package))
    _shipped.add(sc.applicationId)
