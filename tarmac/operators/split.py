"""Exact stratified splits by hash order, without ranking windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.sources.scratch import stage

# Rows fetched to place one cut exactly; a bracket with more is divided again.
FETCH_LIMIT = 20_000
# A sketch of this size places a rank within 0.13 % of a class; the bracket around a cut is wider, and its counts tell if it missed.
SKETCH_SIZE, MARGIN = 4096, 0.005
# Into so many ranges one pass divides the bracket of a cut.
RANGES = 4096
# Hashes are compared as numbers by their first 15 hexadecimal digits, and as text where those are equal.
DIGITS = 15
HIGHEST = 16**DIGITS - 1


def hash_order(key: str, seed: int) -> Column:
    """A fixed shuffle order: md5 of the seed and the row's unique key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


class _Bracket(NamedTuple):
    """A range of hash numbers, both ends included, that should hold the hash at ``rank`` of a class."""

    rank: int
    low: int
    high: int

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // RANGES))


def _brackets(order: DataFrame, shares: Sequence[float]) -> dict[tuple[int, int], _Bracket]:
    """First pass: the size of each class and brackets for its cuts, from a mergeable quantile sketch of its hashes."""
    ends = [sum(shares[: index + 1]) for index in range(len(shares))]
    asked = [min(1.0, max(0.0, end + side)) for end in ends for side in (-MARGIN, MARGIN)]
    found = order.where("label IS NOT NULL").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("place", F.lit(SKETCH_SIZE)).alias("sketch")
    ).select("label", "n", F.kll_sketch_get_quantile_bigint("sketch", F.array(*map(F.lit, asked))).alias("values")).collect()
    brackets = {}
    for row in found:
        for index, end in enumerate(ends):
            rank = round(end * row.n)
            if rank > 0:
                low = 0 if asked[2 * index] == 0 else row["values"][2 * index]
                high = HIGHEST if asked[2 * index + 1] == 1 else row["values"][2 * index + 1]
                brackets[(row.label, index)] = _Bracket(rank, low, high)
    return brackets


def _histograms(order: DataFrame, brackets: dict[tuple[int, int], _Bracket]) -> dict[tuple[int, int], dict[int, int]]:
    """Second pass: rows by range of each bracket, and those below it as range -1; only counts travel to the driver."""
    def at(label: int) -> Column:
        own = [(index, bracket) for (value, index), bracket in brackets.items() if value == label]
        return F.array(*[F.struct(F.lit(index).alias("cut"), F.when(F.col("place") < bracket.low, -1).when(
            F.col("place") <= bracket.high, F.floor((F.col("place") - bracket.low) / bracket.width)).cast("int").alias("range")) for index, bracket in own])

    places = F.lit(None)
    for label in sorted({value for value, _ in brackets}):
        places = F.when(F.col("label") == label, at(label)).otherwise(places)
    counts = order.select("label", F.inline(places)).where("range IS NOT NULL").groupBy("label", "cut", "range").agg(F.count(F.lit(1)).alias("n"))
    out: dict[tuple[int, int], dict[int, int]] = {cut: {} for cut in brackets}
    for row in counts.collect():
        out[(row.label, row.cut)][row.range] = row.n
    return out


def _nth_hashes(order: DataFrame, brackets: dict[tuple[int, int], _Bracket]) -> dict[tuple[int, int], str]:
    """The hash at a 1-based rank of its class, for all (class, cut) at once.

    One pass counts inside the brackets and one fetches the rows of the range that holds each cut. A bracket that missed its cut is
    opened to all hashes, and a range of too many rows becomes the next bracket; either costs one more counting pass, never exactness.
    """
    open_, placed = dict(brackets), {}
    while open_:
        counted = _histograms(order, open_)
        following = {}
        for cut, bracket in open_.items():
            before = counted[cut].get(-1, 0)
            for number in sorted(number for number in counted[cut] if number >= 0):
                n = counted[cut][number]
                if before < bracket.rank <= before + n:
                    low = bracket.low + number * bracket.width
                    inside = _Bracket(bracket.rank, low, min(bracket.high, low + bracket.width - 1))
                    if n > FETCH_LIMIT and inside.high > inside.low:
                        following[cut] = inside
                    else:
                        placed[cut] = (inside, bracket.rank - before)
                    break
                before += n
            else:
                following[cut] = _Bracket(bracket.rank, 0, HIGHEST)
        open_ = following
    if not placed:
        return {}
    inside = reduce(lambda a, b: a | b, [
        (F.col("label") == cut[0]) & F.col("place").between(bracket.low, bracket.high) for cut, (bracket, _) in placed.items()])
    fetched = order.where(inside).select("label", "hash", "place").collect()
    return {cut: sorted(row.hash for row in fetched if row.label == cut[0] and bracket.low <= row.place <= bracket.high)[nth - 1]
            for cut, (bracket, nth) in placed.items()}


def stratified_parts(
    rows: DataFrame, shares: Sequence[float], label: str = "significant", key: str = "id", seed: int = 1,
    name: str = "part",
) -> DataFrame:
    """Add a part number so that every class is divided exactly by ``shares``.

    Part ``i`` takes ``round(cumulative share * class size)`` minus what earlier
    parts took, in hash order; the remainder is the last part. ``key`` must be
    unique. Key and label are written once, and three passes over them place all cuts: a sketch brackets them, a count and a small fetch make them exact. The result is a plain projection comparing each row's hash with its
    class's cuts: no shuffle, no window, and the same answer on any cluster.
    """
    digest = hash_order(key, seed)
    order = stage(rows.select(label, key), "split-keys").select(F.col(label).alias("label"), digest.alias("hash"), F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint").alias("place"))
    brackets = _brackets(order, shares)
    cuts = _nth_hashes(order, brackets)

    row_hash = hash_order(key, seed)
    part = F.lit(len(shares))
    for index in reversed(range(len(shares))):
        below = F.lit(False)
        for value in sorted({value for value, _ in cuts}):
            if (value, index) in cuts:
                below = below | ((F.col(label) == value) & (row_hash <= cuts[(value, index)]))
        part = F.when(below, index).otherwise(part)
    return rows.withColumn(name, part)


def train_test(rows: DataFrame, test_share: float = 0.2, **options) -> DataFrame:
    """Mark the stratified test rows with ``is_test``."""
    parted = stratified_parts(rows, [test_share], name="_part", **options)
    return parted.withColumn("is_test", F.col("_part") == 0).drop("_part")


def folds(rows: DataFrame, count: int = 3, **options) -> DataFrame:
    """Stratified fold number 0..count-1 in ``fold``."""
    return stratified_parts(rows, [1 / count] * (count - 1), name="fold", **options)
