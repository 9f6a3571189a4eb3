"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch

#: A block key with more distinct fingerprints than this is linked by one-bit neighbours, not by pairs.
PAIRWISE_MOST = 64
_STEP = 1 << 16


def _fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = hashes[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text, width: int = 3):
    """Column of 64-bit SimHash fingerprints (a signed long) of a text column.

    A-Z is lower-cased, words are runs of anything but ASCII white space, and
    every shingle of ``width`` words counts as often as it occurs. Fewer words
    make one shingle; null, empty and blank texts have fingerprint 0.
    """

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([_fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return run(F.encode(text, "utf-8"))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, scratch: Scratch, most_bits: int = 2, blocks: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) links that connect exactly what pairs within ``most_bits`` connect.

    The 64 bits are cut into ``blocks``; two fingerprints within ``most_bits``
    agree on some ``blocks - most_bits`` of them, so they share one of the block
    keys, are joined there and checked. A key that more than PAIRWISE_MOST
    fingerprints share emits no pairs: its members meet at the values one bit
    away (for ``most_bits`` = 2 a common value one bit from both is the same as
    two differing bits at most) and link to the smallest one there.
    """
    if most_bits != 2:
        raise ValueError("hot keys are resolved for two differing bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    full = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(full, blocks - most_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("k")).select("fp", "k.mask", "k.key")
    shared = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.keep(keyed.join(shared, ["mask", "key"]), "met")

    cold = met.where(F.col("n") <= PAIRWISE_MOST)
    left, right = cold.select("mask", "key", F.col("fp").alias("a")), cold.select("mask", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["mask", "key"]).where((F.col("a") > F.col("b")) & (_distance("a", "b") <= most_bits)).select("a", "b")

    hot = met.where(F.col("n") > PAIRWISE_MOST).select("fp").distinct()
    flips = [1 << i for i in range(63)] + [-(1 << 63)]
    near = hot.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("spot"))
    low = near.groupBy("spot").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("spot", "b")
    stars = near.join(low, "spot").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def _rooted(prints: DataFrame, scratch: Scratch, most_bits: int, blocks: int) -> DataFrame:
    """Distinct fingerprints with their component's smallest one: ``prints`` and ``root``."""
    found = components(links(prints.select("fp"), scratch, most_bits, blocks), scratch)
    return prints.join(found, prints.fp == found.node, "left").select(*prints.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_bits: int = 2, blocks: int = 4) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id
    reachable over links of at most ``most_bits`` differing bits. Copies are
    grouped by fingerprint first, so only distinct fingerprints are joined.
    Null texts count as empty; null ids take part, and a component of null ids
    alone has a null ``component_id``. Repeated rows each have a row.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    made = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")), "prints")
    prints = scratch.keep(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    rooted = _rooted(prints, scratch, most_bits, blocks)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Written, so that both sides of the join are plain shuffles, of which Spark parts a partition that one fingerprint fills.
    named = scratch.keep(rooted.join(least, "root").select("fp", "component_id"), "named")
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_bits: int = 2, blocks: int = 4) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their component: the smallest in order of id (nulls last) and text hash.

    Of rows alike in id and text one stays. Null, empty and blank texts are one component; null ids take part. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    text = F.col(text_col)
    made = scratch.keep(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), fingerprint(text, width).alias("fp")), "prints")
    first = F.min(F.struct(F.isnull("_id").alias("none"), F.col("_id"), F.col("_hash"))).alias("first")
    prints = scratch.keep(made.groupBy("fp").agg(first), "distinct")
    stay = scratch.keep(_rooted(prints, scratch, most_bits, blocks).groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._hash"), "stay")
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay["_id"]) & (F.xxhash64(docs[text_col]) == stay["_hash"]), "left_semi")
    again = made.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    scratch.clear("stay")
    return kept.dropDuplicates([id_col, text_col]) if again else kept
