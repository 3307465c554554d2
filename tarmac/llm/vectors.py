"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and a rerank with the vectors.

Several rotations are learned, each turning a vector into 64 balanced bits. Every 16-bit piece of a code is an index table; vectors of
one label that agree in a whole piece meet in a bucket and are compared by cosine in double precision. At a cosine of 0.98 two vectors
share a given piece with chance about 0.35, so that 16 tables miss about one pair in a thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.components import connected
from tarmac.llm.tables import column
from tarmac.sources.scratch import stage

COSINE = 0.98
BITS = 64
PIECE = 16
ROTATIONS = 4
# Rotations are learned from about this many vectors, chosen by a hash of the id; every vector is indexed.
FIT_VECTORS = 8000
ITERATIONS = 30
# Larger buckets are cut into chunks of about this many vectors, and each pair of chunks is a piece of work of its own.
CHUNK = 256
SEED = 11


def learn(sample: np.ndarray, rotations: int = ROTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(directions[dimension, bits], thresholds[bits]) from unit vectors, by iterative quantisation from random starts."""
    random = np.random.default_rng(seed)
    dimension = sample.shape[1]
    centre = sample.mean(axis=0)
    moved = sample - centre
    values, axes = np.linalg.eigh(moved.T @ moved)
    axes = axes[:, ::-1][:, :min(BITS, dimension)]
    directions = []
    for _ in range(rotations):
        if dimension >= BITS:
            start = axes
        else:  # too few axes for the bits: an overcomplete random frame stands in
            start = np.linalg.qr(random.standard_normal((BITS, BITS)))[0][:dimension]
        spread = moved @ start
        turn = np.linalg.qr(random.standard_normal((BITS, BITS)))[0]
        for _ in range(ITERATIONS):
            signs = np.where(spread @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(spread.T @ signs)
            turn = left @ right
        directions.append(start @ turn)
    found = np.hstack(directions)
    return found, np.median(sample @ found, axis=0)


def unit(batch_column: pa.Array, rows: int) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Vectors as doubles, None where they cannot link with anything, and their lengths in components."""
    out: list[np.ndarray | None] = []
    for value in batch_column:
        listed = value.as_py()
        vector = None if listed is None or None in listed else np.array(listed, dtype=float)
        if vector is not None:
            if not len(vector) or not np.isfinite(vector).all() or not vector.any():
                vector = None
            else:
                vector = vector / np.abs(vector).max()
                vector = vector / np.sqrt(vector @ vector)
        out.append(vector)
    return out, np.array([0 if v is None else len(v) for v in out])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, dimension, key of the exact vector (null if it links with nothing), unit vector."""
    for batch in batches:
        vectors, sizes = unit(batch.column(1), batch.num_rows)
        exact = [None if v is None else hashlib.blake2b((np.array(raw.as_py(), dtype=float) + 0.0).tobytes(), digest_size=16).digest()
                 for v, raw in zip(vectors, batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(exact, pa.binary()),
             pa.array(vectors, pa.list_(pa.float64()))], names=["id", "label", "dimension", "exact", "vector"])


def _matrix(lists: pa.Array) -> np.ndarray:
    width = len(lists[0])
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _codes(batches: Iterator[pa.RecordBatch], models: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        pieces: list = [None] * batch.num_rows
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            directions, thresholds = models[int(size)]
            bits = _matrix(batch.column(2).take(pa.array(rows))) @ directions > thresholds
            codes = np.packbits(bits, axis=1).view(">u2").astype(np.int32)
            for row, code in zip(rows, codes):
                pieces[row] = code
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.int32()))], names=["node", "pieces"])


def _cell_links(vectors: np.ndarray, codes: np.ndarray, table: int, weights: np.ndarray, sides: np.ndarray | None,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member: links found in this cell and nowhere before, and the first member that links lead to."""
    close = np.triu(vectors @ vectors.T >= threshold, 1)
    if sides is not None:
        close &= sides[:, None] != sides[None, :]
    one, two = np.nonzero(close)
    # Pairs that share the piece of an earlier table were counted there.
    new = ~(codes[one, :table] == codes[two, :table]).any(axis=1)
    one, two = one[new], two[new]
    links = np.zeros(len(vectors), dtype=np.int64)
    np.add.at(links, one, weights[two])
    np.add.at(links, two, weights[one])
    lead = np.arange(len(vectors))
    while True:
        lower = lead.copy()
        np.minimum.at(lower, one, lead[two])
        np.minimum.at(lower, two, lead[one])
        lower = lower[lower]
        if (lower == lead).all():
            return links, lead
        lead = lower


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a cell that a batch leaves open waits for the next one."""
    waiting: list[pa.RecordBatch] = []

    def emit(cells: pa.Table) -> pa.RecordBatch:
        cells = cells.combine_chunks()
        keys = list(zip(*(cells.column(name).to_pylist() for name in ("bucket", "low", "high"))))
        starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        names = np.array(cells.column("node").to_pylist(), dtype=object)
        weights, tables = cells.column("copies").to_numpy(), cells.column("table").to_numpy()
        chunk, low, high = (cells.column(name).to_numpy() for name in ("chunk", "low", "high"))
        codes = _matrix(cells.column("pieces").chunk(0)) if cells.num_rows else np.zeros((0, 0))
        out_a, out_b, out_n = [], [], []
        vectors = cells.column("vector").chunk(0)
        for start, stop in zip(starts, starts[1:]):
            if stop - start < 2:
                continue
            part = slice(start, stop)
            links, lead = _cell_links(
                _matrix(vectors.slice(start, stop - start)), codes[part], int(tables[start]), weights[part],
                chunk[part] if low[start] != high[start] else None, threshold)
            for member in np.flatnonzero(links):
                out_a.append(names[start + member])
                out_b.append(names[start + lead[member]])
                out_n.append(int(links[member]))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.string()), pa.array(out_b, pa.string()), pa.array(out_n, pa.int64())],
                                          names=["a", "b", "links"])

    def last_cell(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(name))[-1].as_py() for name in ("bucket", "low", "high"))

    for batch in batches:
        if not batch.num_rows:
            continue
        open_cell = last_cell(batch)
        keys = zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("bucket", "low", "high")))
        start = next(i for i, key in enumerate(keys) if key == open_cell)
        if start or (waiting and last_cell(waiting[-1]) != open_cell):
            yield emit(pa.Table.from_batches([*waiting, batch.slice(0, start)]))
            waiting = []
        waiting.append(batch.slice(start))
    if waiting:
        yield emit(pa.Table.from_batches(waiting))


def _models(classes: DataFrame, fit_vectors: int, rotations: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rotations for each number of components; few different numbers are expected."""
    models = {}
    for row in classes.groupBy("dimension").count().collect():
        share = min(1.0, 1.2 * fit_vectors / row["count"])
        rows = classes.where(F.col("dimension") == row["dimension"]).where(
            f"pmod(xxhash64(node), 1000000) < {share * 1e6:.0f}").select("vector").limit(fit_vectors).toPandas()
        sample = np.vstack(rows.vector) if len(rows) else np.eye(row["dimension"])
        models[row["dimension"]] = learn(sample, rotations)
    return models


def link_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                 threshold: float = COSINE, rotations: int = ROTATIONS, fit_vectors: int = FIT_VECTORS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors are compared within equal labels and equal numbers of components. A null label, or a vector that is null, empty, zero or
    holds a null or non-finite component, links with nothing and is its own component. Equal vectors are linked and take part as one
    vector that counts for all; rows that repeat an id count as vectors of their own. A null id is passed over when the smallest
    id is sought. An empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()
    label_kind = df.schema[label_column].dataType.simpleString()
    own = stage(df.select(F.col(column(id_column)), F.col(column(vector_column)), F.col(column(label_column))).mapInArrow(
        _units, f"id {kind}, label {label_kind}, dimension int, exact binary, vector array<double>"
    ).withColumn("node", F.when(F.col("label").isNotNull() & F.col("exact").isNotNull(), F.md5(F.concat_ws(
        ":", F.col("label").cast("string"), "dimension", F.hex("exact"))))), "unit-vectors")
    classes = stage(own.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("label_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("dimension").alias("dimension"), F.first("vector").alias("vector")), "vector-classes")
    models = _models(classes, fit_vectors, rotations)
    coded = stage(classes.select("node", "dimension", "vector").mapInArrow(
        lambda batches: _codes(batches, models), "node string, pieces array<int>"), "vector-codes")
    known = stage(coded.withColumnRenamed("node", "_node").join(classes, F.col("_node") == F.col("node")).drop("_node"), "indexed-vectors")
    keys = known.select("node", "label", "dimension", F.posexplode("pieces").alias("table", "piece")).select(
        "node", "table", F.concat_ws(":", F.col("label").cast("string"), "dimension", "table", "piece").alias("bucket"))
    crowded = stage(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
                    .withColumnRenamed("bucket", "_bucket"), "vector-buckets")
    meeting = stage(keys.join(crowded, F.col("bucket") == F.col("_bucket")).select(
        F.col("node").alias("_node"), "table", "bucket", F.expr(f"CAST(ceil(members / {chunk}) AS INT)").alias("chunks")), "vector-meetings")
    cells = meeting.join(known.select("node", "copies", "pieces", "vector"), F.col("_node") == F.col("node")).withColumn(
        "chunk", F.expr("CAST(pmod(xxhash64(node, 'chunk'), chunks) AS INT)")
    ).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        "bucket", "table", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk",
        "node", "copies", "pieces", "vector")
    found = stage(cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(
        lambda batches: _compare(batches, threshold), "a string, b string, links bigint"), "vector-links")
    labels = connected(classes.select("node", F.col("label_id").alias("label")), found.where("a <> b").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    facts = stage(classes.select("node", "copies").join(
        labels.select(F.col("node").alias("_node"), F.col("label").alias("component")), F.col("node") == F.col("_node")
    ).join(counts, F.col("node") == F.col("_a"), "left").select(
        F.col("node").alias("_node"), "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vector-facts")
    return own.select("id", "node").join(facts, F.col("node") == F.col("_node"), "left").select(
        F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
