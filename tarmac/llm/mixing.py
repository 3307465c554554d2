"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source is dealt over shards, about the square root of its documents many, by a seeded hash; a shard's documents stand
in a seeded order on a line of words that is cut into blocks of about ``block_words``. Blocks go to sources by the highest
quotients target / (2 k + 1), and each source's blocks to its shards in the same way. A shard takes all its blocks as often
as its quota allows and the remainder by a seeded permutation, so that no block is taken more than ``max_repeats`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.tables import column
from tarmac.sources.scratch import stage

WORD = r"[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 32
SEED = 17
ID_TEXT = "coalesce(CAST(id AS STRING), '')"


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë seats of each party: columns of ``parties`` plus ``quota``.

    All parties of a group carry the same number in ``seats``. The dividing quotient lies between votes/(seats + n/2) and
    votes/(seats - n/2) for n parties, which settles all but about three seats a party; only those are ranked. Ties
    go by ``key``. A group without votes gets no seats.
    """
    whole = Window.partitionBy(*group)
    bounded = parties.withColumns({
        "_votes": F.sum(votes).over(whole), "_half": F.count(F.lit(1)).over(whole) / 2,
    }).withColumns({
        "_low": F.expr(f"""CASE WHEN _votes > 0 THEN
            greatest(0L, CAST(ceil({votes} * greatest(0D, {seats} - _half) / _votes - 0.5D) AS BIGINT) - 1) ELSE 0L END"""),
        "_high": F.expr(f"""CASE WHEN _votes > 0 THEN
            CAST(floor({votes} * ({seats} + _half) / _votes + 0.5D) AS BIGINT) + 1 ELSE -1L END"""),
    }).withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    ranked = bounded.withColumn("_k", F.explode_outer(F.expr(
        "CASE WHEN _high >= _low THEN sequence(_low, _high) END"
    ))).withColumn("_quotient", F.expr(f"{votes} / (2 * _k + 1)")).withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group).orderBy(F.desc_nulls_last("_quotient"), *key, "_k")
    ))
    won = F.when((F.col("_quotient") > 0) & (F.col("_rank") <= F.col("_open")), 1).otherwise(0)
    return ranked.groupBy(*parties.columns).agg((F.first("_low") + F.sum(won)).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: documents, source_size, target. The table has one row per source and is ordered in one task."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_limit = Window.orderBy("_limit", F.asc_nulls_last("source"))
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    filled = per_source.withColumn("_weight", weight).withColumns({
        "_cap": F.col("source_size") * max_repeats, "_limit": F.col("source_size") * max_repeats / F.col("_weight"),
    }).withColumns({
        "_wanted": F.sum("source_size").over(Window.partitionBy(F.lit(1))) * share,
        "_capped": F.coalesce(F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_weights": F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_level", (F.col("_wanted") - F.col("_capped")) / F.col("_weights"))
    # The first source that does not stop has the highest level; later ones count it as if it had.
    level = F.max(F.when(F.col("_limit") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(F.lit(1)))
    return filled.withColumn("_common", level).select(
        "source", "documents", "source_size",
        F.when(F.col("_limit") <= F.coalesce("_common", "_limit"), F.col("_cap").cast("double"))
        .otherwise(F.col("_weight") * F.col("_common")).alias("target"),
    )


def _hash(*parts: str) -> str:
    return f"CAST(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 8), 16, 10) AS BIGINT)"


def plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, **targets) -> tuple[DataFrame, DataFrame]:
    """(sources with targets and quotas, shards with their quotas) for a staged table id, source, size."""
    sources = source_targets(sizes, **targets).withColumn("shards", F.ceil(F.sqrt("documents")).cast("bigint"))
    sources = stage(sources, "mix-sources")
    shards = with_shard(sizes, sources, seed).groupBy("source", "lane", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    shards = stage(shards.withColumn("blocks", F.expr(f"greatest(1L, CAST(round(words / {block_words}) AS BIGINT))")), "mix-shards")
    blocks = shards.groupBy(F.col("source").alias("_source")).agg(F.sum("blocks").alias("blocks"))
    voted = sources.withColumn("_all", F.lit(1)).withColumn(
        "seats", F.round(F.sum("target").over(Window.partitionBy("_all")) / block_words).cast("bigint"))
    won = apportion(voted, ["_all"], ["source"], "target", "seats").drop("_all", "seats")
    repeats = targets.get("max_repeats", MAX_REPEATS)
    won = stage(won.join(blocks, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn(
        "quota", F.least("quota", F.coalesce(F.col("blocks"), F.lit(0)) * repeats)
    ).drop("_source", "blocks"), "mix-quotas")
    parties = shards.join(
        won.select(F.col("source").alias("_source"), F.col("quota").alias("seats")), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    dealt = apportion(parties, ["source"], ["shard"], "blocks", "seats").withColumns({
        "quota": F.least("quota", F.col("blocks") * repeats),
    }).withColumns({
        "whole": F.expr("quota DIV blocks"), "extra": F.expr("quota % blocks"),
        # Both steps are primes, so the one that does not divide the number of blocks permutes them.
        "step": F.expr("CASE WHEN blocks % 1000003 <> 0 THEN 1000003L ELSE 998244353L END"),
        "shift": F.expr(_hash(f"'{seed}'", "lane", "CAST(shard AS STRING)")),
    })
    return won, stage(dealt, "mix-shard-quotas")


def with_shard(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Add ``shard`` to rows that have columns id, source; one row per source is looked up."""
    counts = sources.select(F.col("source").alias("_source"), "shards")
    return rows.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_source"))).withColumns({
        # Null ids and sources get a value that no text has after the colon.
        "lane": F.expr("coalesce(concat('=', source), '')"),
        "shard": F.expr(f"{_hash(repr(f'{seed}:shard'), ID_TEXT)} % shards"),
    }).drop("_source", "shards")


def placed(rows: DataFrame, sources: DataFrame, shards: DataFrame, seed: int, ties: list[str]) -> DataFrame:
    """Add the place of each row on its shard's line of words and the shard's quota; rows are shuffled once."""
    numbers = shards.select("lane", "shard", "words", "blocks", "whole", "extra", "step", "shift")
    order = F.md5(F.expr(f"concat_ws(':', '{seed}', {ID_TEXT})"))
    line = Window.partitionBy("lane", "shard").orderBy(order, "id", *ties)
    return with_shard(rows, sources, seed).join(numbers, ["lane", "shard"], "left").withColumn(
        "start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))


# Block b of a line of W words in n blocks starts at word b W / n.
TAKEN = """CASE WHEN size = 0 OR blocks IS NULL THEN 0L ELSE whole * size + CASE WHEN extra = 0 THEN 0L ELSE aggregate(
    sequence(((start + 1) * blocks - 1) DIV words, ((start + size) * blocks - 1) DIV words), 0L,
    (sum, b) -> sum + CASE WHEN pmod(b * step + shift, blocks) < extra
        THEN least(start + size, ((b + 1) * words) DIV blocks) - greatest(start, (b * words) DIV blocks) ELSE 0L END
) END END"""
CHOSEN = "pmod((((start + i + 1) * blocks - 1) DIV words) * step + shift, blocks) < extra"


def sized(df: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    return df.select(
        F.col(column(id_column)).alias("id"), F.col(column(source_column)).alias("source"),
        F.expr(f"coalesce(CAST(regexp_count({column(text_column)}, '{WORD}') AS BIGINT), 0L)").alias("size"),
    )


def quotas(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
           seed: int = SEED, **options) -> DataFrame:
    """One row per input row: id, size, source_size, target of its source, taken words.

    A null text has size 0, a null source is a source of its own that comes last. A repeated id keeps its own row. Documents
    without words take nothing. An empty table gives an empty result. Sources are few enough for one task
    and a broadcast: one row each.
    """
    sizes = stage(sized(df, id_column, source_column, text_column), "mix-sizes")
    sources, shards = plan(sizes, seed=seed, **options)
    located = placed(sizes, sources, shards, seed, ["size"])
    facts = F.broadcast(sources.select(F.col("source").alias("_source"), "source_size", "target"))
    return located.join(facts, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("id").alias(id_column), "size", "source_size", "target", F.expr(TAKEN).alias("taken"))


def mix(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
        length_column: str | None = "n_chars", seed: int = SEED, **options) -> DataFrame:
    """The mixed table with the columns of the input: a row per time that a document, or part of it, is taken.

    A document taken whole keeps its text as it is. A document taken in part has the chosen words joined by single spaces and
    its ``length_column`` counted anew. Documents that the mix does not take, those without words among them, are left out.
    """
    sizes = stage(sized(df, id_column, source_column, text_column), "mix-sizes")
    sources, shards = plan(sizes, seed=seed, **options)
    rows = df.select(
        F.col(column(id_column)).alias("id"), F.col(column(source_column)).alias("source"),
        F.expr(f"coalesce(CAST(regexp_count({column(text_column)}, '{WORD}') AS BIGINT), 0L)").alias("size"),
        F.col(column(text_column)).alias("text"), F.struct(*(F.col(column(c)) for c in df.columns if c != text_column)).alias("rest"),
    )
    words = f"filter(regexp_extract_all(text, '({WORD})', 1), (w, i) -> {CHOSEN})"
    located = placed(rows, sources, shards, seed, ["size", "text"]).where("size > 0 AND blocks IS NOT NULL").withColumn(
        "part", F.expr(f"({TAKEN}) - whole * size"))
    copies = located.withColumn("copy", F.explode(F.expr(
        "concat(array_repeat(false, CAST(whole AS INT)), IF(part > 0, array(part < size), array()))"
    ))).withColumn("text", F.when(F.col("copy"), F.expr(f"array_join({words}, ' ')")).otherwise(F.col("text")))
    def output(name: str):
        if name == text_column:
            return F.col("text").alias(name)
        value = F.col(f"rest.{column(name)}")
        if name == length_column:
            value = F.when(F.col("copy"), F.length("text").cast(df.schema[name].dataType)).otherwise(value)
        return value.alias(name)
    return copies.select(*(output(name) for name in df.columns))
