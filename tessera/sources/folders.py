"""Folders in any store that Spark reads: what stands in them, and versions that become visible at once."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


class ChangedMeanwhile(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


def _open(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, path = _open(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def delete(spark: SparkSession, at: str) -> None:
    fs, path = _open(spark, at)
    fs.delete(path, True)


def fingerprint(spark: SparkSession, at: str) -> str:
    """A hash of the names, sizes and times of all files under a folder, or of one file: it changes when a table is written again."""
    fs, path = _open(spark, at)
    found, seen = fs.listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        seen.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()


class Versions:
    """Numbered states of a folder, each a small JSON file that is written aside and then renamed, so that readers see one state or the next."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, f"{at.rstrip('/')}/_versions"

    def newest(self) -> int:
        """Number of the last version; 0 if there is none."""
        return max((int(n[:-5]) for n in names(self.spark, self.at) if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.at}/{version:010d}.json", wholetext=True).first()[0])

    def commit(self, version: int, state: dict) -> None:
        """Makes ``state`` this version; fails if there is one already."""
        fs, aside = _open(self.spark, f"{self.at}/.{uuid.uuid4().hex}.tmp")
        _, last = _open(self.spark, f"{self.at}/{version:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(last) or not fs.rename(aside, last):
            fs.delete(aside, False)
            raise ChangedMeanwhile(f"version {version} of {self.at} is there already")
