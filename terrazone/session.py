"""Session and table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and all executors are in this process (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrazone-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Any executor can read the files, so a lost executor loses no data.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a long column name that counts its rows from 1 in order; ranges of rows are numbered apart, so no task holds all.

    The order should tell all rows apart. The driver holds one count for each range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_of_order", F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("part_of_order").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    told = df.sparkSession.createDataFrame(offsets, "part_of_order int, rows_before long")
    place = F.row_number().over(Window.partitionBy("part_of_order").orderBy(*order))
    return ranged.withColumn(name, place.cast("long")).join(F.broadcast(told), "part_of_order").withColumn(name, F.col(name) + F.col("rows_before")).drop("part_of_order", "rows_before")


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote for tables that no later plan reads, such as the rounds of a loop."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
