"""Session helpers: worker import path and shared scratch tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Put the repository on the Python workers' path, so that functions of this package unpickle there."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one if the master is
    local (tests), else an error, for executors don't see the driver's folders."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {sc.master} share")
    made = tempfile.mkdtemp(prefix="gaitspark-shared-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark removes them when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Materialises tables that are only needed until the block ends, and then removes them:

        with Scratch(spark) as keep:
            part = keep(df, "part")
            result = materialize(part.groupBy("k").count(), "result")
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables of these names before the block ends; nothing may read them again."""
        for path in [p for p in self.paths if p.rpartition("/")[2].rpartition("-")[0] in names]:
            remove(self.spark, path)
            self.paths.remove(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def hadoop_file(spark: SparkSession, path: str):
    """(file system, path) of a path on any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    fs, at = hadoop_file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, at = hadoop_file(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_file(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder over another."""
    fs, at = hadoop_file(spark, path)
    there = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.delete(there, True)
    fs.mkdirs(there.getParent())
    if not fs.rename(at, there):
        raise OSError(f"{path} could not be moved to {to}")
