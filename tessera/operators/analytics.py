"""Grouped analytics, de-duplication by key, incremental loads and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; only one row per key and task is shuffled."""
    return frame.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, hash) the manifest doesn't have."""
    return files.join(manifest, ["path", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """All rows, with the new one where both have the key; of several new ones the first in the given order, and then by the hash of the row."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return latest_per(both, [key], F.desc("_turn"), *order, F.xxhash64(*old.columns)).drop("_turn")


def status_counts(frame: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """Per group: a count for each status, and the total."""
    return frame.groupBy(group).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values), F.count(F.lit(1)).alias("total"))


def exact_duplicates(frame: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Adds ``first_id``, the smallest id with the same key. Keys are summed up before they meet, so many rows of one key are no group."""
    keyed = frame.withColumn("_key", key)
    first = keyed.groupBy(F.col("_key").alias("_of")).agg(F.min(id_col).alias("first_id"))
    return keyed.join(first, F.col("_key").eqNullSafe(F.col("_of"))).drop("_key", "_of")


def feedback_summary(log: DataFrame) -> DataFrame:
    """Searches (mode, query_type, num_results): counts and mean results by type, by mode and over all, in one pass."""
    known = log.where("mode IS NOT NULL").select(F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("query_type", F.lit("unknown")).alias("query_type"), F.coalesce("num_results", F.lit(0)).alias("num_results"))
    sets = known.groupingSets([["query_type"], ["mode"], []], "query_type", "mode")
    return sets.agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("num_results"), 4).alias("mean_results"), F.count_if(F.col("num_results") < 3).alias("low_results"))


def diverse_sample(frame: DataFrame, kind: str, bucket: str, id_col: str, quota: int) -> DataFrame:
    """Per kind ``quota`` rows, taken from its buckets in turn."""
    in_bucket = F.row_number().over(Window.partitionBy(kind, bucket).orderBy(id_col))
    turn = F.row_number().over(Window.partitionBy(kind).orderBy("_in", bucket))
    # Each window is followed by its limit, so that tasks keep that many rows before they shuffle.
    return frame.withColumn("_in", in_bucket).where(F.col("_in") <= quota).withColumn("pick", turn).where(F.col("pick") <= quota).drop("_in")
