from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import queries, rollups
from tests.llm.awkward import ROWS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
CHANGES = "id bigint, source string, lang string, version string, tokens bigint"


def totals(rollup):
    return {tuple(row)[:3]: tuple(row)[3:] for row in rollup.totals().collect()}


def test_batches_equal_a_plain_ledger(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}")
    ledger = {}
    batches = [
        [(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v1", 7), (1, "a", "en", "v2", 20)],
        [(1, "a", "en", "v1", 12), (2, None, None, "v1", None), (9, "a", "en", "v1", None)],
        [(1, "b", "de", "v1", 12), (2, "a", "en", "v1", 6)],
        [],
        [(3, "c", "fr", "v1", 7), (3, "c", "fr", "v1", 7), (1, None, None, "v2", None)],
    ]
    for number, rows in enumerate(batches):
        changes = spark.createDataFrame(rows, CHANGES)
        assert rollup.commit(number, changes)
        before = totals(rollup)
        assert not rollup.commit(number, changes) and totals(rollup) == before
        for i, source, lang, version, tokens in rows:
            old = ledger.get((i, version))
            if tokens is None:
                ledger.pop((i, version), None)
            else:
                ledger[(i, version)] = (source or (old or [None])[0], lang or (old or [None] * 2)[1], tokens)
        expected = {}
        for (_, version), (source, lang, tokens) in ledger.items():
            n, t = expected.get((source, lang, version), (0, 0))
            expected[(source, lang, version)] = (n + 1, t + tokens)
        assert before == expected


def test_an_unfinished_batch_does_not_count_and_can_be_repeated(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}")
    changes = spark.createDataFrame([(1, "a", "en", "v1", 10)], CHANGES)
    changes.write.parquet(f"file://{tmp_path}/deltas/1")
    assert totals(rollup) == {}
    assert rollup.commit(1, changes) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_changes_without_an_id_are_refused(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="without an id"):
        rollup.commit(1, spark.createDataFrame([(None, "a", "en", "v1", 10)], CHANGES))
    assert totals(rollup) == {}


def test_counts_equal_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter((i, s, lang, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, lang, s in ROWS)
    assert Counter(map(tuple, rollups.token_counts(documents(spark), PATH).collect())) == expected
    assert rollups.token_counts(documents(spark, []), PATH).agg(F.sum("tokens")).first()[0] is None


def test_op4_counts_documents_without_an_id(spark, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(1, 1, 1), (None, 0, 1), (None, 0, 0), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    once = {(i if i is not None else f"row {at}"): (s, lang, t) for at, (i, t, lang, s) in enumerate(ROWS) if i != 1}
    expected = {}
    for source, lang, text in once.values():
        n, tokens = expected.get((source, lang), (0, 0))
        expected[source, lang] = (n + 1, tokens + len(tokenizer.encode(text or "", add_special_tokens=False).ids))
    rows = queries.QUERIES["op4_token_rollup"](spark, f"file://{tmp_path}").collect()
    assert {(row.source, row.lang): (row.documents, row.tokens) for row in rows} == expected


def test_documents_without_an_id_are_inserts_only(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}")
    rows = [(None, "a", "en", "v1", 10), (None, "a", "en", "v1", 10), (None, "b", None, None, 3), (None, "a", "en", "v1", None), (1, "a", "en", "v1", 5)]
    assert rollup.commit(1, spark.createDataFrame(rows, CHANGES), unnamed=True)
    expected = {("a", "en", "v1"): (3, 25), ("b", None, ""): (1, 3)}
    assert totals(rollup) == expected
    assert not rollup.commit(1, spark.createDataFrame(rows, CHANGES), unnamed=True) and totals(rollup) == expected
    assert rollup.commit(2, spark.createDataFrame([(None, None, None, "v1", None), (1, None, None, "v1", None)], CHANGES), unnamed=True)
    assert totals(rollup) == {("a", "en", "v1"): (2, 20), ("b", None, ""): (1, 3)}
