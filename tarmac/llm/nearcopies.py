"""Near copies by word shingles: SimHash blocks link first, MinHash bands and rare shingles propose the rest, the exact Jaccard similarity decides.

A text is the set of its ``WIDTH``-word shingles; only distinct sets are compared. Sets whose SimHashes over the same shingles are equal or meet
in the blocks of ``simhash.links`` are proposed first. ``BANDS`` bands of ``ROWS`` minima each leave out
the sets that share none with any other: a pair of similarity s shares no band with probability (1 - s^5)^32, 3e-6 at 0.8 and less
above. Of n shingles in one order for all sets, two sets at 0.8 must share one of the first n - ceil(0.8 n) + 1, so only those are
joined, rarest first: a passage that many texts quote proposes no pair unless it makes up nearly all of them. A 64-bit
SimHash alone does not serve here: at 0.8 two prints differ in about ten bits, give or take three, which is too wide for blocks.

Where many sets meet at one shingle, 64 * ``WORDS`` parity bits of each decide first. Two sets differ in at least as many shingles as their
bits do, so a pair whose bits differ in more than the similarity allows needs no check, and only pairs near the limit become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm import simhash
from tarmac.llm.components import connected
from tarmac.llm.simhash import keep_labelled
from tarmac.llm.tables import given_back, small_batches
from tarmac.sources.scratch import released, stage

WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
SEED = 42
# Sets that share a rare shingle are compared pair by pair up to this number. More are first compared, in ROUNDS rounds, with members
# drawn by a hash: one, then MORE times as many each time.
PAIRWISE = 3
ROUNDS = 4
MORE = 4
CHUNK = 256
WORDS = 8

_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(SEED)
_TURNS = _DRAWN.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS = _DRAWN.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no word gives none.

    bytes.split and bytes.lower know ASCII only, as in the SimHash.
    """
    words = (text or "").encode().lower().split()
    hashed = xxhash.xxh64_intdigest
    values = np.fromiter((hashed(word, SEED) for word in words), dtype=np.uint64, count=len(words))
    if not words:
        return values
    count = min(width, len(words))
    total = np.zeros(len(words) - count + 1, dtype=np.uint64)
    for i in range(count):
        total = total * _STEP + values[i:i + len(total)]
    return np.unique(_mixed(total))


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a set of shingles."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), 1024):
        np.minimum(least, ((short[start:start + 1024] ^ _TURNS) * _FACTORS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for minima in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + minima)
    return keys


def parities(values: np.ndarray) -> np.ndarray:
    """64 * WORDS bits as longs; each shingle of the set turns one over, so the bits of two sets differ in no more places than the sets."""
    turned = np.bincount((values % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<i8")


def _with_node(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, sizes, keys = [], [], [], []
        for text in batch.column(place):
            values = shingles(text.as_py())
            prints.append(simhash.fingerprint(text.as_py(), WIDTH))
            nodes.append(xxhash.xxh3_64_intdigest(values.tobytes()))
            sizes.append(len(values))
            keys.append(bands(values))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS),
            pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.int64()),
             pa.array(sizes, pa.int64()), lists],
            names=[*batch.schema.names, "print", "fingerprint", "size", "bands"])


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column(0), batch.column(1)):
            values = shingles(text.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([node.as_py()], pa.int64()), pa.array([len(values)], pa.int64()),
                 pa.array([values.view(np.int64)], pa.list_(pa.int64())), pa.array([parities(values)], pa.list_(pa.int64()))],
                names=["node", "size", "held", "bits"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b whose sets are similar enough. Two sets without a shingle are the same node, so no union is empty."""
    one = sets.select(F.col("node").alias("_a"), F.col("held").alias("held_a"))
    two = sets.select(F.col("node").alias("_b"), F.col("held").alias("held_b"))
    both = pairs.distinct().join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).withColumn(
        "common", F.size(F.array_intersect("held_a", "held_b")))
    return stage(both.where(f"common / (size(held_a) + size(held_b) - common) >= {similarity!r}D").select("a", "b"), "similar")


def _sharing(classes: DataFrame) -> DataFrame:
    """The sets, as node, that share a band with another one."""
    keys = classes.select(F.col("print").alias("node"), F.explode("bands").alias("key"))
    sizes = stage(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high")
    ).where("members > 1"), "band-sizes")
    ends = sizes.select(F.explode(F.array("low", "high")).alias("node"))
    others = keys.join(sizes.where("members > 2").select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left_semi")
    return stage(ends.unionByName(others.select("node")).distinct(), "sharing-nodes")


def _blocks(classes: DataFrame) -> DataFrame:
    """Pairs a, b of sets that the SimHash operator links: one set of each of two fingerprints within its distance, and the sets of one fingerprint with its smallest.

    They are candidates like any other. Sets of linked fingerprints that are not paired here, or fail the check, still meet by their bands.
    """
    first = stage(classes.groupBy("fingerprint").agg(F.min("print").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    several = first.where("n > 1").select(F.col("fingerprint").alias("_fingerprint"), "first")
    same = classes.join(several, F.col("fingerprint") == F.col("_fingerprint")).where("print <> first").select(
        F.col("first").alias("a"), F.col("print").alias("b"))
    one, two = (first.select(F.col("fingerprint").alias(f"_{name}"), F.col("first").alias(f"first_{name}")) for name in ("a", "b"))
    near = simhash.links(first.select(F.col("fingerprint").alias("print"))).join(one, F.col("a") == F.col("_a")).join(
        two, F.col("b") == F.col("_b")).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return stage(same.unionByName(near), "block-pairs")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """node, size, key, place, members: the rare shingles (key) by which sets meet, with their place in their own set's order.

    Shingles are ordered by the number of sets that hold them, then by value. Those of one set alone come first and count for
    the places, but can meet nothing.
    """
    held = sets.select("node", "size", F.explode("held").alias("key"))
    times = stage(held.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared-shingles")
    own = Window.partitionBy("node")
    placed = held.join(times.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select(
        "node", "size", "key", (F.col("size") - F.count(F.lit(1)).over(own)
                                + F.row_number().over(own.orderBy("times", "key")) - 1).alias("place"))
    rare = stage(placed.where(f"place <= size - ceil({similarity!r}D * size - 1e-9D)"), "prefixes")
    several = rare.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return stage(rare.join(several, F.col("key") == F.col("_key")).drop("_key"), "meeting-prefixes")


def links(classes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, pairwise: int = PAIRWISE,
          rounds: int = ROUNDS) -> DataFrame:
    """Edges a, b between distinct sets whose components are those of all pairs that share a band and are similar enough.

    ``classes`` has print, fingerprint, size, bands once for each set, ``texts`` print and text. Pairs that meet in SimHash blocks are
    checked first; the others meet at the rare shingles of sets that share a band. Where more than ``pairwise`` sets meet at a
    rare shingle, all are compared with a few of them first; after that only pairs in different components are left, and every
    one of these is compared whose sizes, parity bits, and what follows the shingle in both, still allow the similarity.
    """
    spark = classes.sparkSession
    blocks = _blocks(classes)
    asked = _sharing(classes).unionByName(blocks.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    own = texts.join(asked, F.col("print") == F.col("node"), "left_semi").dropDuplicates(["print"])
    with small_batches(spark):
        sets = stage(own.select("print", "text").mapInArrow(lambda batches: given_back(_with_set(batches)), "node bigint, size bigint, held array<bigint>, bits array<bigint>"), "shingle-sets")
    found = _prefixes(sets, similarity)
    share = similarity / (1 + similarity)
    bits = [f"bit{i}" for i in range(WORDS)]
    differing = " + ".join(f"bit_count({name} ^ _{name})" for name in bits)
    # Sets of the similarity differ in at most this part of their sizes taken together.
    close = f"{differing} <= {1 - 2 * share!r}D * (size + _size) + 1e-9D"

    def possible(a: str, b: str) -> str:
        """Whether sizes and places allow the similarity, given that the shingle is the first that the two sets share."""
        return (f"least({a}size, {b}size) >= {similarity!r}D * greatest({a}size, {b}size) - 1e-9D AND least({a}size - {a}place, "
                f"{b}size - {b}place) >= {share!r}D * ({a}size + {b}size) - 1e-9D")

    few = found.where(f"members <= {pairwise}").groupBy("key").agg(F.collect_list(F.struct("node", "size", "place")).alias("p")).select(
        F.explode(F.expr(f"""flatten(transform(p, a -> transform(
            filter(p, b -> a.node < b.node AND {possible("a.", "b.")}), b -> struct(a.node AS a, b.node AS b))))""")).alias("pair")
    ).select("pair.*")
    edges = _verified(blocks, sets, similarity).unionByName(_verified(few, sets, similarity))
    crowded = found.where(f"members > {pairwise}").select("node", "size", "key", "place")
    nodes = stage(sets.join(crowded.select(F.col("node").alias("_node")).distinct(), F.col("node") == F.col("_node"), "left_semi").select(
        "node", F.col("node").alias("label"), *(F.col("bits")[i].alias(name) for i, name in enumerate(bits))), "crowded-nodes")

    def inside() -> DataFrame:
        """The edges between crowded nodes; others can only be followed at the end."""
        one, two = (nodes.select(F.col("node").alias(name)) for name in ("_a", "_b"))
        return edges.join(one, F.col("a") == F.col("_a"), "left_semi").join(two, F.col("b") == F.col("_b"), "left_semi")

    def still_open(members: DataFrame) -> DataFrame:
        """Those members at shingles where more than one component meets, with their roots and parity bits."""
        with released(spark, "open") as keep:
            roots = connected(nodes, inside()).withColumnsRenamed({"node": "_node", "label": "root"})
            rooted = stage(members.select("node", "size", "key", "place").join(roots, F.col("node") == F.col("_node")).drop("_node"),
                           "rooted")
            several = rooted.groupBy(F.col("key").alias("_key")).agg(
                F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"),
            ).where("low < high").select("_key", "members")
            return keep(rooted.join(several, F.col("key") == F.col("_key")).drop("_key"), "open-members")

    for turn in range(rounds):
        if crowded.isEmpty():
            return edges
        crowded = still_open(crowded)
        order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        drawn = crowded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MORE ** turn).select(
            *(F.col(name).alias(f"_{name}") for name in ("node", "size", "place", "key", "root", *bits)))
        pairs = crowded.join(drawn, F.col("key") == F.col("_key")).where(f"root <> _root AND {possible('', '_')} AND {close}").select(
            F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))
        edges = stage(edges.unionByName(_verified(pairs, sets, similarity)), "near-links")
    if crowded.isEmpty():
        return edges
    members = still_open(crowded).withColumn("chunks", F.expr(f"1 + members DIV {CHUNK}"))
    left = members.withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
    right = members.select(
        *(F.col(name).alias(f"_{name}") for name in ("node", "size", "place", "key", "root", *bits)),
        F.explode(F.expr("sequence(0L, chunks - 1)")).alias("_chunk"))
    rest = left.join(right, (F.col("key") == F.col("_key")) & (F.col("chunk") == F.col("_chunk"))).where(
        f"node < _node AND root <> _root AND {possible('', '_')} AND {close}").select(F.col("node").alias("a"), F.col("_node").alias("b"))
    return stage(edges.unionByName(_verified(rest, sets, similarity)), "near-links")


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows that stay, all columns: of each component of similar texts the document with the smallest id, null ids last.

    Texts without a word, null ones too, are alike. Of documents with that id one set stays, and of rows that repeat both, one. Texts of
    any length are compared whole, and an empty table stays empty. The rows are written once with the keys of their bands; the sets
    of those that share a band are made again when pairs are verified. What is staged for that is deleted once the winners are known.
    """
    def labelled(rows: DataFrame, own_id: str, text: str) -> DataFrame:
        label = F.struct(F.col(own_id).isNull().alias("unnamed"), F.col(own_id).alias("id"), F.col("print"))
        classes = stage(rows.groupBy("print").agg(
            F.min(label).alias("label"), F.min("fingerprint").alias("fingerprint"), F.first("size").alias("size"),
            F.first("bands").alias("bands")), "set-classes")
        found = links(classes.select("print", "fingerprint", "size", "bands"), rows.select("print", F.col(text).alias("text")), **options)
        return connected(classes.select(F.col("print").alias("node"), "label"), found).select(
            F.col("node").alias("_print"), "label")

    return keep_labelled(df, id_column, text_column, _with_node, "print bigint, fingerprint bigint, size bigint, bands array<bigint>", labelled)
