"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    # Written, so that both sides of the join are plain shuffles, of which Spark parts a partition that the hub of a star fills.
    low = scratch.keep(low.select("a", F.least("a", "low").alias("low")), name)
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(low, "a")
    return linked.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """Edges (a, b) of one ordered type -> (node, root): the smallest node that each node reaches.

    Alternates large-star and small-star rounds, which shrink any component to a
    star around its smallest node in a logarithmic number of rounds. Nodes without an edge to
    another node have no row. Each round is a written table; nothing but two
    numbers per round comes to the driver.
    """
    def oriented(frame: DataFrame) -> DataFrame:
        return frame.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(frame: DataFrame):
        return frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = scratch.keep(oriented(edges), "edges-0")
    seen = mark(now)
    for k in range(1, most_rounds + 1):
        if not seen[0]:
            break
        now = scratch.keep(oriented(_small_star(_large_star(now, scratch, f"low-{k}"))), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        scratch.drop(f"low-{k}")
        before, seen = seen, mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
