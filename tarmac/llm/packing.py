"""Packing pieces of documents into sequences by patterns of few lengths, fitted to the histogram of lengths.

The plan depends on how often each length occurs and on nothing else, so the driver sees one count per length. It lists
patterns of at most three rounded lengths that fill a sequence, fits repeat counts to the histogram by non-negative
least squares, rounds them down and realises each pattern with the longest lengths left; what remains is packed by best fit,
which also fills the gaps of the patterns. The plan says for each length which ranks go to which sequence and place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.tables import column, given_back, small_batches
from tarmac.llm.tokens import ChunkEncoder
from tarmac.sources.scratch import stage

SEQUENCE = 2048
STEPS = 128
SEPARATOR = 0

Plan = list[tuple[tuple[int, ...], int]]


def patterns(steps: int) -> np.ndarray:
    """Columns: how often each of the rounded lengths 1..steps occurs in a pattern of one to three that sums to ``steps``."""
    found = [(steps,)] + [(a, steps - a) for a in range(1, steps // 2 + 1)]
    found += [(a, b, steps - a - b) for a in range(1, steps // 3 + 1) for b in range(a, (steps - a) // 2 + 1)]
    table = np.zeros((steps, len(found)))
    for place, pattern in enumerate(found):
        for length in pattern:
            table[length - 1, place] += 1
    return table


def non_negative(matrix: np.ndarray, wanted: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |matrix x - wanted|, by active sets."""
    x = np.zeros(matrix.shape[1])
    active = np.zeros(matrix.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, np.abs(matrix.T @ wanted).max(initial=0))
    for _ in range(rounds):
        gain = matrix.T @ (wanted - matrix @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(matrix[:, active], wanted, rcond=None)[0]
            below = active & (trial <= 0)
            if not below.any():
                break
            share = np.min(x[below] / np.maximum(x[below] - trial[below], 1e-300))
            x += share * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                trial = x
                break
        x = trial
    return x


def _realise(left: np.ndarray, bins: list[list[int]], pattern: list[int], repeats: int, plan: Plan) -> None:
    while repeats > 0:
        used: Counter[int] = Counter()
        for step in pattern:
            lengths = bins[step]
            while lengths and left[lengths[-1]] == 0:
                lengths.pop()
            chosen = next((n for n in reversed(lengths) if left[n] > used[n]), None)
            if chosen is None:
                return
            used[chosen] += 1
        times = min(repeats, *(int(left[n]) // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= k * times
        plan.append((tuple(used.elements()), times))
        repeats -= times


def _best_fit(left: np.ndarray, plan: Plan, sequence: int) -> Plan:
    room: list[Plan] = [[] for _ in range(sequence + 1)]
    for lengths, times in plan:
        room[sequence - sum(lengths)].append((lengths, times))
    for length in range(sequence, 0, -1):
        count = int(left[length])
        space = length
        while count and space <= sequence:
            if not room[space]:
                space += 1
                continue
            lengths, times = room[space].pop()
            now = min(count, times)
            if now < times:
                room[space].append((lengths, times - now))
            room[space - length].append((lengths + (length,), now))
            count -= now
            # What has just been filled may be the tightest place for the next of the same length.
            space = max(length, space - length) if space - length >= length else space
        each = sequence // length
        for size, times in ((each, count // each), (count % each, 1 if count % each else 0)):
            if times:
                room[sequence - size * length].append(((length,) * size, times))
    return [entry for entries in room for entry in entries]


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE, steps: int = STEPS) -> Plan:
    """(lengths of a sequence, how many sequences are like that), covering every counted length exactly."""
    left = np.zeros(sequence + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    steps = min(steps, sequence)
    rounded = -(-np.arange(sequence + 1) * steps // sequence)
    bins: list[list[int]] = [[] for _ in range(steps + 1)]
    for length in range(1, sequence + 1):
        bins[rounded[length]].append(length)
    wanted = np.bincount(rounded[1:], weights=left[1:], minlength=steps + 1)[1:]
    table = patterns(steps)
    repeats = non_negative(table, wanted)
    plan: Plan = []
    for place in np.flatnonzero(repeats >= 1):
        steps_of = [int(step) + 1 for step in np.flatnonzero(table[:, place]) for _ in range(int(table[step, place]))]
        _realise(left, bins, steps_of, int(repeats[place]), plan)
    return _best_fit(left, plan, sequence)


def _intervals(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys with the first sequence number and the offset of each run of ranks."""
    taken: Counter[int] = Counter()
    rows, sequences = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequences, offset))
            taken[length] += times
            offset += length
        sequences += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _cut(batches: Iterator[pa.RecordBatch], path: str, sequence: int) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(path)
    part, ranks = TaskContext.get().partitionId(), np.zeros(sequence + 1, dtype=np.int64)
    end, width = np.array([SEPARATOR], dtype="<u4").tobytes(), 4 * sequence
    for batch in batches:
        source, piece, start, length, check, rank = [], [], [], [], [], []
        for row, own in enumerate(encoder.ids_of(text.as_py() or "" for text in batch.column(1))):
            ids = own + end
            for number, at in enumerate(range(0, len(ids), width)):
                data = ids[at:at + width]
                size = len(data) // 4
                source.append(row)
                piece.append(number)
                start.append(at // 4)
                length.append(size)
                check.append(zlib.crc32(data))
                rank.append(ranks[size])
                ranks[size] += 1
        columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(values, pa.int64()) for values in (start, length, check)]
        columns += [pa.array([part] * len(source), pa.int32()), pa.array(rank, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])


def pieces(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Every document's ids, ended by id 0, cut into pieces; ``part`` and ``rank`` number pieces of one length within a task."""
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(column(id_column)), F.col(column(text_column))).mapInArrow(
        lambda batches: given_back(_cut(batches, path, sequence)),
        f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint",
    )


def _place(batches: Iterator[pa.RecordBatch], keys: np.ndarray, firsts: np.ndarray, offsets: np.ndarray,
           ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column(3).to_numpy()
        rank = batch.column(5).to_numpy()
        run = np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1
        places = [pa.array(firsts[run] + rank - ranks[run]), pa.array(offsets[run])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *places],
                                         names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the separator alone. Repeated rows are packed as often as they occur, whatever
    their ids, and a null id is carried along. An empty table gives an empty result. Pieces are written once; their ranks
    among equal lengths are task ranks plus a running sum over tasks, so no length is gathered anywhere.
    """
    with small_batches(df.sparkSession):
        cut = stage(pieces(df, path, id_column, text_column, sequence), "pieces")
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sizes.select(
        F.col("length").alias("_length"), F.col("part").alias("_part"), "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    counts = {row[0]: row[1] for row in bases.groupBy("_length").agg(F.sum("n")).collect()}
    lengths, ranks, firsts, offsets = _intervals(pack_histogram(counts, sequence))
    keys = lengths * (1 << 50) + ranks
    ranked = cut.join(bases, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    kind = df.schema[id_column].dataType.simpleString()
    return ranked.mapInArrow(
        lambda batches: _place(batches, keys, firsts, offsets, ranks),
        f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("id", id_column)
