"""Scratch tables in the shared folder that the session names in ``spark.checkpoint.dir``.

A written table cuts lineage and survives the loss of any executor, because
every executor and the driver can read it again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and Spark runs locally."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set(_KEY, made)
    return made


class Scratch:
    """Tables of one operator call, under one folder that goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._path(self.root, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, at: str, act):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes the frame and returns it as read from the written table."""
        at = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(at)
        self.names.add(name)
        return self.spark.read.schema(frame.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Frees a table that nothing reads any more."""
        self._path(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))

    def clear(self, *but: str) -> None:
        """Frees all tables but those named: what is written from the others has all that it needs."""
        for name in self.names - set(but):
            self.drop(name)
        self.names &= set(but)
