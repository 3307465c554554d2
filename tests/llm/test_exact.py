from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tarmac.llm import exact
from tests.llm.awkward import ROWS, documents


def test_decisions_equal_brute_force(spark):
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(i)
    expected = Counter()
    for i, text, *_ in ROWS:
        members = groups[text or ""]
        keep = max((m for m in members if m is not None), default=None)
        expected[(i, keep, len(members), i == keep, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact.decisions(documents(spark)).collect())) == expected


def test_deduplicate_keeps_one_row_of_every_text(spark):
    docs = documents(spark)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = [(row.doc_id, row.text or "") for row in kept.collect()]
    assert sorted(text for _, text in rows) == sorted({text or "" for _, text, *_ in ROWS})
    assert dict((text, i) for i, text in rows)["the cat sat on the mat with the hat"] == 2


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    expected = Counter(map(tuple, exact.decisions(documents(spark)).collect()))
    monkeypatch.setattr(exact, "MIN_SLOTS", 2)
    monkeypatch.setattr(exact, "MAX_SLOTS", 2)
    assert Counter(map(tuple, exact.decisions(documents(spark)).collect())) == expected


@pytest.mark.parametrize("operator", [exact.decisions, exact.deduplicate])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


def test_only_flagged_texts_are_shuffled(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id DIV IF(id < 200, 2, 1)) AS text")
    flagged = exact.with_flag(docs, "text", "flag").where("flag").count()
    assert 200 <= flagged < 1200
