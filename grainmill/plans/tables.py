"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting to delete a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a folder of our own if everything runs in one process (tests); on
    a cluster that is an error, since executors don't share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="grainmill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer partitions than there are (a table of one small file); else as it is.

    For work that costs more than moving its input. What a shuffle has dealt already stays.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def materialize(df: DataFrame, tag: str = "table", cleanup: bool = True) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage, and a lost executor costs one read.

    The shuffle files of what was written are deleted with it, not when the driver next collects its garbage; for small
    tables, many of them one after the other, that costs more than it frees (cleanup=False).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/grainmill-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, str(cleanup).lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._grainmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._grainmill_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... in the order of the columns `order`. Sorted by ranges over all tasks and written down; only the ranges' counts meet in one place."""
    spark = df.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    rows = materialize(placed, "numbered").withColumn("__range", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND((1 << 33) - 1))
    ends = rows.groupBy("__range").agg((F.max("__place") + 1).alias("__n"))
    before = ends.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row for each range
    return rows.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))
