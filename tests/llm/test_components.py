from __future__ import annotations

import random

from tarmac.llm import components
from tests.llm.awkward import components as brute


def _found(spark, labels, edges):
    nodes = spark.createDataFrame([(i, label, f"more {i}") for i, label in enumerate(labels)], "node bigint, label bigint, more string")
    return sorted(tuple(row) for row in components.connected(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect())


def test_components_chains_loops_and_repeats_keep_further_columns(spark):
    chance = random.Random(2)
    edges = [(i, i + 1) for i in range(40, 60)] + [(chance.randrange(40), chance.randrange(40)) for _ in range(25)]
    edges += [(b, a) for a, b in edges[::3]] + [(70, 70), (61, 61)]
    labels = [chance.randrange(100) for _ in range(75)]
    linked = {frozenset(edge) for edge in edges}
    roots = brute(range(75), lambda a, b: frozenset((a, b)) in linked)
    expected = [(i, min(labels[j] for j in range(75) if roots[j] == roots[i]), f"more {i}") for i in range(75)]
    assert _found(spark, labels, edges) == expected


def test_no_link(spark):
    assert _found(spark, [5, 4], []) == [(0, 5, "more 0"), (1, 4, "more 1")]


def test_only_links_between_different_components_go_on(spark, monkeypatch):
    written, stage = [], components.stage

    def counted(df, label):
        staged = stage(df, label)
        if label == "links":
            written.append(staged.count())
        return staged

    monkeypatch.setattr(components, "stage", counted)
    _found(spark, list(range(30)), [(a, b) for a in range(30) for b in range(30)])
    assert written == [30 * 29 // 2, 0]
