"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks and a check of the Hamming distance.

A 64-bit fingerprint is cut into BLOCKS pieces. Two fingerprints that differ in at most ``distance`` bits agree in at least
BLOCKS - distance whole pieces, so they meet in a bucket for one choice of that many pieces. Only distinct fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.components import connected
from tarmac.llm.tables import column, given_back, small_batches
from tarmac.sources.scratch import released, stage

DISTANCE = 2
BLOCKS = 5
SHINGLE = 3
SEED = 42
# Buckets up to this size are compared pair by pair; larger ones by shared neighbours, which is exact as well and linear.
PAIRWISE = 8


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingle hashes; no word gives 0. bytes.split and bytes.lower know ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed, last = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, last, 65536):
        stop = min(last, start + 65536)
        shingles = zip(*(words[start + i:stop + i] for i in range(width))) if len(words) >= width else [words]
        values = np.array([hashed(b" ".join(shingle), seed) for shingle in shingles], dtype="<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py(), width, seed) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "print"])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, print (signed 64 bits) of every row; the whole text is hashed."""
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(column(id_column)), F.col(column(text_column)).cast("string")).mapInArrow(
        lambda batches: _fingerprints(batches, width, seed), f"id {kind}, print bigint")


def _masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of blocks - distance pieces, as signed 64-bit numbers."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    pieces = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(pieces, blocks - distance)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges a, b between distinct fingerprints whose components are those of all pairs within the distance.

    Buckets of at most ``pairwise`` fingerprints give their verified pairs. In a larger bucket every fingerprint names all
    values within distance / 2 of it: two fingerprints meet at a value exactly if they are close enough, and each
    is linked to the smallest one there. This lists 65 values a fingerprint and never the pairs of a bucket.
    """
    if distance != 2:
        raise ValueError("shared neighbours at one bit stand for a distance of two")
    masks = ", ".join(f"struct({i} AS table, print & {mask}L AS bucket)" for i, mask in enumerate(_masks(blocks, distance)))
    keys = prints.select("print", F.explode(F.expr(f"array({masks})")).alias("key")).select("print", "key.*")
    sizes = keys.groupBy("table", "bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("print").alias("low"), F.max("print").alias("high")
    ).where("members > 1")
    sizes = stage(sizes, "bucket-sizes")
    close = f"bit_count(a ^ b) <= {distance}"
    twos = sizes.where("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).where(close)
    crowded = sizes.where("members > 2").select(F.col("table").alias("_table"), F.col("bucket").alias("_bucket"), "members")
    found = stage(keys.join(crowded, (F.col("table") == F.col("_table")) & (F.col("bucket") == F.col("_bucket"))).select(
        "print", "table", "bucket", "members"), "crowded-buckets")
    few = found.where(f"members <= {pairwise}").groupBy("table", "bucket").agg(F.collect_list("print").alias("p")).select(
        F.explode(F.expr(f"""flatten(transform(p, a -> transform(
            filter(p, b -> a < b AND bit_count(a ^ b) <= {distance}), b -> struct(a, b))))""")).alias("pair")
    ).select("pair.*")
    many = found.where(f"members > {pairwise}").select("print").distinct()
    flips = ", ".join(["print"] + [f"print ^ {(1 << bit) - (1 << 64 if bit == 63 else 0)}L" for bit in range(63)]
                      + ["print ^ shiftleft(1L, 63)"])
    near = many.select("print", F.explode(F.expr(f"array({flips})")).alias("value"))
    centres = stage(near.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a")).where("n > 1")
                    .select(F.col("value").alias("_value"), "a"), "neighbour-values")
    stars = near.join(centres, F.col("value") == F.col("_value")).where("print <> a").select("a", F.col("print").alias("b"))
    return stage(twos.unionByName(few).unionByName(stars).distinct(), "simhash-links")


def _labelled(own: DataFrame, **options) -> DataFrame:
    """print, label for every distinct fingerprint: the smallest (id is null, id, print) of its component."""
    label = F.struct(F.col("id").isNull().alias("unnamed"), "id", "print")
    classes = stage(own.groupBy("print").agg(F.min(label).alias("label")), "print-classes")
    found = links(classes.select("print"), **options)
    return connected(classes.select(F.col("print").alias("node"), "label"), found).select(
        F.col("node").alias("_print"), "label")


def components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, the smallest id reachable over links.

    Null, empty and white-space texts have fingerprint zero and are linked like any other. Equal fingerprints are linked. A null id is
    passed over when the smallest id is sought; a component of null ids only has a null component. Rows that repeat an id keep their
    own rows. An empty table gives an empty result.
    """
    own = stage(fingerprints(df, id_column, text_column), "fingerprints")
    return own.join(_labelled(own, **options), F.col("print") == F.col("_print")).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("label.id").alias("component_id"))


def _with_prints(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch.column(place)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, "print"])


def keep_labelled(df: DataFrame, id_column: str, text_column: str, printer: Callable, added: str, labelled: Callable) -> DataFrame:
    """The rows that are the label of their own component, all columns; of rows that repeat id and print, one.

    ``printer`` adds the columns ``added``, print among them, to batches of rows, which are written once so that each text is hashed a
    single time; ``labelled`` gives _print, label from these rows and the names of their id and text.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*names)
    place = df.columns.index(text_column)
    own_id, own_text = names[df.columns.index(id_column)], names[place]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in renamed.schema)
    with small_batches(df.sparkSession):
        rows = stage(renamed.mapInArrow(lambda batches: given_back(printer(batches, place)), f"{schema}, {added}"), "printed")
    with released(df.sparkSession, "labels") as keep:
        labels = labelled(rows, own_id, own_text)
        winners = keep(labels.where("label.print = _print").select("_print", F.col("label.id").alias("_id")), "winners")
    chosen = rows.join(winners, (F.col("print") == F.col("_print")) & F.col(own_id).eqNullSafe(F.col("_id")))
    again = stage(rows.select(F.col(own_id).alias("id"), "print").join(
        winners, (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id"))
    ).groupBy("print").count().where("count > 1").select(F.col("print").alias("_again")), "repeated-winners")
    if not again.isEmpty():
        repeated = F.col("print") == F.col("_again")
        chosen = chosen.join(again, repeated, "left_anti").unionByName(
            chosen.join(again, repeated, "left_semi").dropDuplicates(["print"]))
    return chosen.select(*(F.col(name).alias(own) for name, own in zip(names, df.columns)))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows that stay, all columns: of each component the document with the smallest id, null ids last.

    Of documents with that id the one with the smallest fingerprint stays, and of rows that repeat both, one.
    """
    return keep_labelled(df, id_column, text_column, _with_prints, "print bigint",
                         lambda rows, own_id, _: _labelled(rows.select(F.col(own_id).alias("id"), "print"), **options))
