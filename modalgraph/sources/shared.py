"""Tables in the folder that all executors share, to end lineage between rounds of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = "/tmp/checkpoints/modalgraph"
    spark.sparkContext.setCheckpointDir(own)
    return "file://" + own


def work_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the application ends, or by ``release``."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Deletes the tables of all queries of the application; results that were not stored yet can no longer be read."""
    folder = work_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.discard(folder)


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "rows") -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there and lost executors do not matter."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(table: DataFrame) -> DataFrame:
    """A table read from files, dealt to all cores if its files make fewer parts than there are; larger tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
