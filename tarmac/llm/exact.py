"""Exact duplicates: a two-pass Bloom filter decides which rows need a shuffle at all.

Pass one counts how often each of two hashed slots per text is hit and packs the slots hit
at least twice into 64-bit words. Pass two lets a text through at once when one of its slots was
hit only once: such a text cannot have a copy. Only the remaining rows are shuffled by their SHA-256.
A crowded filter only sends more rows into the shuffle; the result is the same at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.tables import column, free_name
from tarmac.sources.scratch import stage

# Sixteen slots a row leave about one row in seventy flagged by chance. The packed filter has at
# most MAX_SLOTS / 64 words of 16 bytes, 16 MB, which bounds what is broadcast.
SLOTS_PER_ROW = 16
MIN_SLOTS = 1 << 16
MAX_SLOTS = 1 << 26


def _slots(text: Column, slots: int) -> tuple[Column, Column]:
    hashed = F.xxhash64(text)
    return hashed.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(slots - 1))


def repeated_slots(texts: DataFrame, text: str, slots: int) -> DataFrame:
    """Words of the filter: bit b of word w is set when slot 64 w + b was hit at least twice."""
    hits = texts.select(F.explode(F.array(*_slots(F.col(column(text)), slots))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")
    )


def with_flag(df: DataFrame, text: str, flag: str) -> DataFrame:
    """Add ``flag``: true for every row whose text may occur more than once."""
    count = df.count()
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (SLOTS_PER_ROW * count).bit_length()))
    filled, first, second = (free_name(df, name) for name in ("_filled", "_first", "_second"))
    normal = df.withColumn(filled, F.coalesce(F.col(column(text)), F.lit("")))
    words = stage(repeated_slots(normal, filled, slots), "repeated-slots")
    one, two = _slots(F.col(filled), slots)
    rows = normal.withColumns({first: one, second: two})
    for slot in (first, second):
        lookup = F.broadcast(words.select(F.col("word").alias(f"{slot}_word"), F.col("bits").alias(f"{slot}_bits")))
        rows = rows.join(lookup, F.shiftright(F.col(slot), 6) == F.col(f"{slot}_word"), "left")
    hit = " AND ".join(
        f"(shiftrightunsigned({slot}_bits, CAST({slot} & 63 AS INT)) & 1) = 1" for slot in (first, second)
    )
    return rows.select(*(F.col(column(name)) for name in df.columns), F.expr(f"coalesce({hit}, false)").alias(flag))


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(column(text)), F.lit("")), 256)


def _groups(flagged: DataFrame) -> DataFrame:
    """One row per text that does occur more than once; copies are added up before the shuffle."""
    return flagged.groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("members")).where("members > 1")


def decisions(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text is the empty text. A null id is smaller than any
    other; when all ids of a group are null, ``keep_id`` is null and its rows count as kept. Rows that repeat both id and
    text get the same decision here; ``deduplicate`` keeps one of them. An empty table gives an empty result.
    """
    id_of = F.col(column(id_column))
    flag = free_name(df, "_maybe_repeated")
    narrow = with_flag(df.select(id_of, F.col(column(text_column))), text_column, flag)
    keys = stage(narrow.select(id_of.alias("id"), digest(text_column).alias("sha"), F.col(flag).alias("maybe")), "text-keys")
    groups = stage(_groups(keys.where("maybe")), "copy-groups").withColumnRenamed("sha", "group_sha")
    single = keys.where("NOT maybe").select("id", "sha", F.col("id").alias("keep"), F.lit(1).cast("bigint").alias("members"))
    shared = keys.where("maybe").join(groups, F.col("sha") == F.col("group_sha"), "left").select(
        "id", "sha", F.when(F.col("group_sha").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("members", F.lit(1).cast("bigint")).alias("members"),
    )
    return single.unionByName(shared).select(
        F.col("id").alias(id_column), F.col("keep").alias("keep_id"), F.col("members").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; only flagged rows are shuffled.

    Exactly one row of every distinct text stays, the one with the largest id; of rows that repeat that id with the
    same text, one stays.
    """
    columns = [F.col(column(name)) for name in df.columns]
    flag = free_name(df, "_maybe_repeated")
    sha = free_name(df, "_sha")
    flagged = with_flag(df, text_column, flag)
    maybe = flagged.where(F.col(flag)).withColumn(sha, digest(text_column))
    groups = stage(
        _groups(maybe.select(F.col(column(id_column)).alias("id"), F.col(sha).alias("sha"))), "copy-groups"
    ).select(F.col("sha").alias(f"{sha}_group"), F.col("keep").alias(f"{sha}_keep"))
    joined = maybe.join(groups, F.col(sha) == F.col(f"{sha}_group"), "left")
    alone = joined.where(F.col(f"{sha}_group").isNull()).select(*columns)
    chosen = joined.where(
        F.col(f"{sha}_group").isNotNull() & F.col(column(id_column)).eqNullSafe(F.col(f"{sha}_keep"))
    ).dropDuplicates([sha]).select(*columns)
    return flagged.where(~F.col(flag)).select(*columns).unionByName(alone).unionByName(chosen)
