"""Cutting a long plan: results that several branches use are written once."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Only a local session, as in tests, may go
    without one and gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


#: Seconds of a write after which the driver collects its garbage.
LONG_WRITE = 2.0


def settled(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back. A lost executor then costs no recomputation of what lies
    before.

    What the steps before have shuffled stays on the executors' disks until the driver's garbage is collected, so that is
    done after each write that took a while; the driver's heap then shrinks to what is in use, too.
    """
    path = shared_path(df.sparkSession)
    began = time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - began > LONG_WRITE:
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete what `settled` wrote for these tables, after their last use."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `place`: consecutive numbers from 0 in an order that leaves no ties.

    Rows are sorted by ranges and counted where they lie; an offset for each range, of which there is one row, is added. So
    no task sorts more than its range, however many rows a group of the order has.
    """
    ordered = settled(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(offsets, "part").withColumn("place", place).select(*df.columns, "place")
