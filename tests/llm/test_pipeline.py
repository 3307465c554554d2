from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import langid, packing
from tarmac.llm.tables import BATCH
from tests.llm.awkward import documents
from tests.llm.test_nearcopies import expected_ids

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF)
    assert known.columns == columns
    assert Counter(known.collect()) == Counter(row for row in docs.collect() if any(map(str.isalpha, row.text or "")))
    single = stages["exact_copies"](spark, known, SF)
    best = {}
    for row in known.collect():
        best[row.text] = max(row.doc_id, best.get(row.text, row.doc_id))
    rows = single.collect()
    assert single.columns == columns and sorted(row.doc_id for row in rows) == sorted(best.values())
    apart = stages["near_copies"](spark, single, SF)
    expected = expected_ids([(row.doc_id, row.text) for row in rows])
    assert apart.columns == columns and sorted((row.doc_id for row in apart.collect()), key=str) == expected
    assert len(expected) < len(rows)
    mixed = stages["mix"](spark, apart, SF)
    assert mixed.columns == columns
    words = sum(len(row.text.split()) for row in apart.collect())
    assert abs(sum(len(row.text.split()) for row in mixed.collect()) - 1.5 * words) < 0.02 * words
    packed = stages["pack"](spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_awkward_documents_pass_every_stage(spark):
    docs = documents(spark)
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = kept
        kept.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {row.doc_id for row in packed.collect()} == {row.doc_id for row in docs.collect()}


def test_an_empty_table_passes_every_stage(spark):
    docs = documents(spark, [])
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
        assert docs.collect() == []


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    used = {}

    def watched(module):
        write = module.stage

        def stage(df, label):
            used[label] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
            return write(df, label)

        monkeypatch.setattr(module, "stage", stage)

    watched(corpus_pipeline)
    watched(packing)
    docs, stages = documents(spark), dict(corpus_pipeline.STAGES)
    stages["pack"](spark, stages["language"](spark, docs, SF), SF)
    assert 0 < used["in-a-language"] <= BATCH and 0 < used["pieces"] <= BATCH


def test_run_packs_the_corpus(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_held_out_matches_its_definition(spark):
    rows = spark.range(50).withColumn("held", langid.held_out(F.col("id"))).collect()
    assert all(row.held == (zlib.crc32(str(row.id).encode()) % 5 == 0) for row in rows)
