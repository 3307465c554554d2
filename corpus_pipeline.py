"""Documents to packed sequences: language, exact copies, near copies, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import exact, langid, mixing, nearcopies, packing
from tarmac.llm.tables import column, read, small_batches
from tarmac.sources.scratch import released, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those whose text is null, empty or without any letter go.

    Whole texts are scored, repeated rows alike. A null lang teaches nothing. Without labelled rows, as in an empty table, nothing stays.
    """
    labelled = docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang")
    model = langid.fit(labelled, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.predict(docs.withColumnsRenamed({name: f"{name}_own" for name in docs.columns if name in ("lang_pred", "score")}), model)
    # Written here, since whole texts go to Python and back: a result that is written elsewhere does so 10,000 at a time.
    with small_batches(spark):
        known = stage(found.where(F.col("lang_pred") != langid.UNKNOWN).drop("lang_pred", "score"), "in-a-language")
    return known.toDF(*docs.columns).select(*(F.col(column(name)) for name in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every distinct text, the one with the largest id; a null text counts as empty, a null id as smallest.

    Rows that repeat id and text leave one. An empty table stays empty.
    """
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, Jaccard of 0.8 or more), the one with the smallest id.

    Pairs meet in the blocks of operator 5, over SimHashes of the same shingles, and what these miss by MinHash bands and rare shingles; all
    are checked exactly. Null ids come last. Texts without a word are copies of each other; shorter ones than five words are one shingle. Whole texts are
    compared, rows that repeat id and text leave one, and an empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the part, as the mix takes them.

    A null source is a source of its own and comes last. A text that is null or has no word counts nothing, and repeated rows count
    each. An empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place.

    A null or empty text is one piece, the separator. Longer texts than a sequence are cut, repeated rows are packed each, null ids
    are carried along, and an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# Tokenizers, fingerprints and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        with released(spark, name) as keep:
            docs = keep(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
