"""Tables between steps: iterative jobs write each round to the shared folder and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse, if the session runs on one machine."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_ and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_ or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds").rstrip("/")


def new_folder(spark: SparkSession, kind: str = "rounds") -> str:
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def folder_of(spark: SparkSession, path: str):
    """The path and its file system, as Spark's Hadoop client has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame) -> DataFrame:
    """Write and read again: cuts the lineage, and survives the loss of an executor."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`staged` that nothing will read again."""
    for df in tables:
        path, files = folder_of(df.sparkSession, df._staged_path)
        files.delete(path, True)


class Layers:
    """Rows laid out by a whole number: a round appends what it finds for other rounds, and reads its own number's folder only."""

    def __init__(self, spark: SparkSession, by: str):
        self.spark, self.by, self.path, self.schema = spark, by, new_folder(spark, "layers"), None

    def add(self, df: DataFrame) -> None:
        """Append rows. They are dealt out by number first, so that a layer has few files; adaptive execution splits large layers."""
        self.schema = df.schema
        df.hint("rebalance", self.by).write.mode("append").partitionBy(self.by).parquet(self.path)

    def at(self, number: int) -> DataFrame:
        """The rows of one layer."""
        rest = [f for f in self.schema if f.name != self.by]
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
        path, files = folder_of(self.spark, f"{self.path}/{self.by}={number}")
        return self.spark.read.schema(names).parquet(str(path.toString())) if files.exists(path) else self.spark.createDataFrame([], names)

    def all(self) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        path, files = folder_of(self.spark, self.path)
        return self.spark.read.schema(names).parquet(self.path) if files.exists(path) else self.spark.createDataFrame([], names)

    def discard(self) -> None:
        path, files = folder_of(self.spark, self.path)
        files.delete(path, True)
