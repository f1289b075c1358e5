"""A folder that driver and executors share, for queries that write files and read them back, and the tables of computations in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which goes when the JVM ends; on a local master without that setting, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    fs, p = _files(spark, path)
    fs.deleteOnExit(p)
    return path


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


class Steps:
    """The tables of a computation in rounds, each written into the shared folder and read again, so that a lost executor costs no earlier round.

    A table kept under a name replaces the one that was kept under it, whose files are removed: what still reads that one must have been kept
    itself. `last` keeps the result, which stays until the JVM ends, and removes all others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path, schema = folder(self.spark, name), df.schema
        df.write.parquet(path)
        if before := self.paths.get(name):
            remove(self.spark, before)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        path, schema = folder(self.spark, "result"), df.schema
        df.write.parquet(path)
        for other in self.paths.values():
            remove(self.spark, other)
        self.paths.clear()
        return self.spark.read.schema(schema).parquet(path)
