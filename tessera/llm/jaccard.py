"""N-gram Jaccard join: parity sketches of shingle sets, equal blocks of sketches by size band, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.scratch import Scratch
from tessera.llm.skew import join_named

#: A block that more sets share than this is linked by a star and by groups of bounded size, not by pairs.
PAIRWISE_MOST = 32
#: Shingles of the sets that are compared in one task, about.
GROUP = 1 << 19
#: Least ratio of the largest to the smallest size of a band.
STRETCH = 1.5
#: Words of the sketch that candidates are compared by before their sets are.
WORDS = ["s1", "s2", "s3", "s4"]
_SLICE = 256
_ODD = np.random.default_rng(13).integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order; fewer words than ``width`` make one, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), np.uint64, len(words) - width + 1))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[k]
    return x ^ (x >> np.uint64(29))


def sketch(shingles: np.ndarray, blocks: int) -> np.ndarray:
    """``blocks`` words of 64 bits: each shingle turns over one bit, so two sketches differ in no more bits than their sets in shingles."""
    block = ((_mixed(shingles, 0) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = block.astype(np.int64) * 64 + (shingles & np.uint64(63)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=blocks * 64) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Bands:
    """Sizes of sets cut into bands, in each of which a known number of differing shingles is allowed.

    With similarity p / 100, sets of sizes a <= b that link have b <= 100 a / p
    and differ in (a + b) (100 - p) / (100 + p) <= a (100 - p) / p shingles at most.
    """

    def __init__(self, percent: int):
        self.p, self.q = percent, 100 - percent
        self.highs = [-(-self.p // self.q) - 1] if self.q else [1 << 62]

    def _band(self, size: int) -> int:
        while self.highs[-1] < size:
            low = self.highs[-1] + 1
            far = int(low * STRETCH) * self.q // self.p + 1
            self.highs.append(-(-far * self.p // self.q) - 1)
        return int(np.searchsorted(self.highs, size))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each block of the set's sketch in its own band and, if it can be the larger of a pair there, the band below.

        A band that allows d differing shingles has d + 1 blocks, so linked sets agree in one.
        Sets so small that none may differ have no keys: equal ones are one set already.
        """
        own, made = self._band(len(shingles)), []
        for band in (own, own - 1):
            if band > 0 and len(shingles) * self.p <= self.highs[band] * 100:
                blocks = self.highs[band] * self.q // self.p + 1
                place = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)
                made.append(_mixed(_mixed(sketch(shingles, blocks), 1) + _mixed(place, 2), 1))
        return np.unique(np.concatenate(made)).view(np.int64) if made else np.empty(0, np.int64)


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, text) -> (doc_id, text_hash, n_shingles, set_id, s1 to s4, keys): a sketch of fixed length, keys of the blocks."""
    longs = T.LongType()
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("n_shingles", longs), T.StructField("set_id", T.BinaryType()), *(T.StructField(c, longs) for c in WORDS), T.StructField("keys", T.ArrayType(longs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                n, names, fixed, keys = [], [], [], []
                for text in part.column(2):
                    found = shingles(text.as_py(), width)
                    n.append(len(found))
                    names.append(xxhash.xxh3_128_digest(found.tobytes()))
                    fixed.append(sketch(found, len(WORDS)).view(np.int64))
                    keys.append(bands.keys(found))
                fixed = np.array(fixed)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), *map(pa.array, fixed.T), pa.array(keys, pa.list_(pa.int64()))], schema.names)

    return docs.mapInArrow(run, schema)


def _packed(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, packed): texts move compressed, a fourth of what their sets would be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack.compress(t.as_py()) for t in part.column(1)], pa.binary())], ["node", "packed"])

    return texts.mapInArrow(run, "node bigint, packed binary")


def _linked(pairs: DataFrame, width: int, percent: float) -> DataFrame:
    """(a, b, packed_a, packed_b) -> (a, b) of the pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, right = None, None  # pairs come in order of b
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part, found = batch.slice(at, _SLICE), []
                for a, b, x, y in zip(*part.columns, strict=True):
                    if b.as_py() != last:
                        last, right = b.as_py(), shingles(unpack.decompress(y.as_py()), width)
                    left = shingles(unpack.decompress(x.as_py()), width)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    found.append(100 * both >= percent * (len(left) + len(right) - both))
                yield part.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a bigint, b bigint")


def _may_link(a: str, b: str, percent: float) -> Column:
    """Whether sets of these prefixes' sizes and sketches can link: Hamming distance and difference of sizes are no more than the shingles that may differ."""
    apart = sum(F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in WORDS)
    return F.greatest(apart, F.abs(F.col(f"{a}_n") - F.col(f"{b}_n"))) * (100 + percent) <= (F.col(f"{a}_n") + F.col(f"{b}_n")) * (100 - percent)


def _compare(width: int, percent: float):
    """Sets of two groups -> (a, b) links between left ones and others; what is connected already isn't compared."""

    def run(group: pa.Table) -> pa.Table:
        left, node, root = (group.column(c).to_numpy() for c in ("left", "node", "root"))
        unpack = zstandard.ZstdDecompressor()
        sets = [shingles(unpack.decompress(x.as_py()), width) for x in group.column("packed")]
        sizes = np.array([len(s) for s in sets])
        bits = np.stack([sketch(s, 8) for s in sets])
        root, links = root.copy(), []
        rights = np.flatnonzero(~left)
        for k in np.flatnonzero(left).tolist():
            near = rights[root[rights] != root[k]]
            apart = np.maximum(np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64), np.abs(sizes[near] - sizes[k]))
            near = near[apart * (100 + percent) <= (sizes[near] + sizes[k]) * (100 - percent)]
            if len(near):
                joined = np.concatenate([sets[i] for i in near])
                place = np.minimum(np.searchsorted(sets[k], joined), sizes[k] - 1)
                both = np.add.reduceat((sets[k][place] == joined).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
                for i in near[100 * both >= percent * (sizes[near] + sizes[k] - both)].tolist():
                    links.append((max(node[i], node[k]), min(node[i], node[k])))
                    root[root == root[i]] = root[k]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def rooted(nodes: DataFrame, met: DataFrame, rows: DataFrame, again: bool, scratch: Scratch, rounds: list[Scratch], width: int, percent: float, most: int, group: int) -> DataFrame:
    """(node, doc_id, text_hash), keys that sets share (key, m, node, n, sketch[, rest, hot]) and (doc_id, text_hash, text) -> (node, root) of the sets with a link; ``again``: rows may be alike.

    Sets that share a key with at most ``most`` are compared in pairs. Where more share a key they
    are compared with its centre, the set that meets most others over all keys; what then
    stands outside the key's largest component is compared, in groups of about ``group`` shingles, with all sets of other
    components there. So every two sets that share a key are compared or are in one component already.
    Where keys are the first shingles of a set (with ``rest``), pairs that share too few of them go before.
    """
    counted = ["rest", "hot"] if "rest" in met.columns else []
    side = lambda frame, c, more=(): frame.select("key", F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", *WORDS, *more)))
    cold, hot = met.where(F.col("m") <= most), met.where(F.col("m") > most)
    pairs = side(cold, "a", counted).join(side(cold, "b", counted), "key").where((F.col("a") > F.col("b")) & _may_link("a", "b", percent))
    if counted:
        shared = pairs.groupBy("a", "b", *(f"{c}_{x}" for c in "ab" for x in ("n", *counted))).agg(F.count(F.lit(1)).alias("both"))
        pairs = shared.where((F.col("both") + F.least("a_hot", "b_hot") + F.greatest("a_rest", "b_rest")) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent - 1e-6)
    pairs = pairs.select("a", "b")
    degree = hot.groupBy("node").agg(F.sum("m").alias("degree"))
    centre = hot.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n", *WORDS)).alias("c"))
    centre = scratch.keep(centre.select("key", *(f"c.{x}" for x in ("node", "n", *WORDS))), "centres")
    stars = side(hot, "a").join(side(centre, "b"), "key").where((F.col("a") != F.col("b")) & _may_link("a", "b", percent)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    wanted = scratch.keep(pairs.unionByName(stars).distinct(), "pairs")

    wanted_nodes = wanted.select(F.explode(F.array("a", "b")).alias("node")).unionByName(hot.select("node")).distinct()
    named = nodes.join(wanted_nodes, "node", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "node")
    texts = rows.join(named, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash"))).select("node", "text")
    packed = scratch.keep(_packed(texts.dropDuplicates(["node"]) if again else texts), "packed")
    side = lambda c: packed.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}"))
    edges = scratch.keep(_linked(wanted.join(side("a"), "a").join(side("b"), "b"), width, percent), "links")
    found = components(edges, rounds[0])

    inside = scratch.keep(hot.join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
    parts = inside.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "root", "n")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    groups = lambda n: F.ceil(n / group).cast("int")
    plan = scratch.keep(main.select("key", F.col("main.root").alias("main"), groups(F.col("n")).alias("all"), groups(F.col("n") - F.col("main.n")).alias("rest")), "plan")
    if not plan.limit(1).count():
        return found
    planned = inside.join(plan, "key")
    place = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    columns = ["key", "i", "j", "left", "node", "root"]
    lefts = planned.where("root <> main").select("*", F.lit(True).alias("left"), place("rest").alias("i"), each("all").alias("j")).select(*columns)
    rights = planned.select("*", F.lit(False).alias("left"), place("all").alias("j"), each("rest").alias("i")).select(*columns)
    there = lefts.unionByName(rights).join(packed, "node")
    more = scratch.keep(there.groupBy("key", "i", "j").applyInArrow(_compare(width, percent), "a bigint, b bigint"), "more")
    return components(edges.unionByName(more), rounds[1]) if more.limit(1).count() else found


def different_sets(signed: DataFrame, scratch: Scratch, *more: str) -> DataFrame:
    """Signed rows -> (node, set_id, doc_id, text_hash, rows, n, sketch, keys): each set once, by its first row; ``more`` columns hang on the set."""
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("text_hash"))).alias("first")
    grouped = signed.where("n_shingles > 0").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in (*WORDS, *more, "keys")))
    return scratch.keep(grouped.select(F.monotonically_increasing_id().alias("node"), "set_id", "first.doc_id", "first.text_hash", "rows", "n", *WORDS, *more, "keys"), "wide")


def repeated(signed: DataFrame) -> bool:
    """Whether rows are alike in id and text."""
    return bool(signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def sharing(wide: DataFrame, scratch: Scratch, most: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, met) of different sets: all without their keys, and a row for each key of a set that others have too."""
    keyed = wide.select(F.explode("keys").alias("key"), "node")
    shared = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").join(keyed, "key"), "shared")
    nodes = scratch.keep(wide.drop("keys"), "nodes")
    scratch.drop("wide")
    met = shared.join(nodes.select("node", "n", *WORDS, *more), "node")
    if more:
        met = met.withColumn("hot", F.count_if(F.col("m") > most).over(Window.partitionBy("node")))
    return nodes, scratch.keep(met, "met")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    A document's set holds the distinct shingles of ``width`` words (A-Z
    lower-cased, words part at ASCII white space); fewer words are one shingle.
    Two documents link when their sets have a Jaccard similarity of ``percent``
    hundredths or more, and ``component_id`` is the smallest id that links reach.
    Null, empty and blank texts have no shingles, link with nothing and keep their own id.
    Null ids take part; a component of null ids alone has a null ``component_id``.
    Repeated rows each have a row. Other columns are ignored. An empty table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    spark = docs.sparkSession
    scratch, rounds = Scratch(spark, "jaccard"), [Scratch(spark, "jaccard-rounds") for _ in range(2)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.encode(F.col(text_col), "utf-8").alias("text"))
    signed = scratch.keep(_signed(rows, width, percent), "signed")
    wide = different_sets(signed, scratch)
    again = repeated(signed)
    sized = scratch.keep(signed.select("doc_id", "n_shingles", "set_id"), "sized")
    scratch.drop("signed")
    nodes, met = sharing(wide, scratch, PAIRWISE_MOST)
    linked = rooted(nodes, met, rows, again, scratch, rounds, width, percent, PAIRWISE_MOST, GROUP)
    placed = scratch.keep(nodes.select("node", "set_id", "doc_id", "rows").join(linked, "node", "left").select("set_id", "doc_id", "rows", F.coalesce("root", "node").alias("root")), "components")
    least = scratch.keep(placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")), "least")
    named = scratch.keep(join_named(placed.select("set_id", "rows", "root"), least, "root", "sets").select("set_id", "rows", "component_id"), "named")
    for done in (*rounds, scratch):
        done.clear("sized", "named")
    blank = sized.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_named(sized.where("n_shingles > 0"), named, "set_id", "rows").select("doc_id", "n_shingles", "component_id").unionByName(blank)
