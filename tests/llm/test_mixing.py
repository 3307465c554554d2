from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.llm import mixing
from tests.llm.awkward import ROWS, documents


def highest_quotients(votes: dict, seats: int) -> dict:
    won = Counter()
    for _ in range(seats):
        won[min(votes, key=lambda name: (-votes[name] / (2 * won[name] + 1), name))] += 1
    return {name: won[name] for name in votes}


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1234])
def test_apportionment_equals_handing_out_one_by_one(spark, seats):
    votes = {f"p{i:02}": float(v) for i, v in enumerate([5000, 1, 17, 17, 900, 3, 0, 41, 2500, 2500, 8])}
    parties = spark.createDataFrame([("g", name, v, seats) for name, v in votes.items()], "g string, name string, votes double, seats bigint")
    found = {row["name"]: row["quota"] for row in mixing.apportion(parties, ["g"], ["name"], "votes", "seats").collect()}
    assert found == highest_quotients(votes, seats)


def fill(sizes: dict) -> dict:
    """Targets by filling up and sharing the excess again."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: mixing.WEIGHTS[i % 3] for i, name in enumerate(names)}
    left, open_names, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_names:
        level = left / sum(weight[n] for n in open_names)
        over = {n for n in open_names if level * weight[n] >= 2 * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in open_names}
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
        open_names -= over
    return target


def test_targets_and_takes(spark):
    rows = mixing.quotas(documents(spark)).join(documents(spark).select("doc_id", "source").distinct(), "doc_id", "left").collect()
    sizes = defaultdict(int)
    for _, text, _, source in ROWS:
        sizes[source] += len((text or "").split())
    expected = fill(sizes)
    assert len(rows) == len(ROWS)
    for row in rows:
        if row.doc_id is not None:
            assert row.target == pytest.approx(expected[row.source]) and row.source_size == sizes[row.source]
        assert 0 <= row.taken <= 2 * row.size


def test_takes_come_near_targets_and_repeat(spark):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 7) END AS source",
        "array_join(sequence(1, 20 + id % 90), ' ') AS text")
    first = mixing.quotas(docs)
    found = first.collect()
    assert sorted(found) == sorted(mixing.quotas(docs.repartition(13)).collect())
    joined = docs.select("doc_id", "source").join(first, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for row in joined.collect():
        assert abs(row.taken - row.target) <= 0.02 * row.target + 64


def test_mix_takes_the_words_that_quotas_say(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for row in mixed.collect():
        words[row.doc_id] += len(row.text.split())
        assert row.n_chars == len(row.text)
    taken = Counter()
    for row in mixing.quotas(docs).collect():
        taken[row.doc_id] += row.taken
    assert +words == +taken


@pytest.mark.parametrize("operator", [mixing.quotas, mixing.mix])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


def test_table_without_words(spark):
    assert [row.taken for row in mixing.quotas(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()] == [0, 0]
