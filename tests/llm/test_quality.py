from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import langid, quality, queries
from tests.llm.awkward import ROWS, documents


def words(chance, n):
    return ["".join(chance.choice(["the", "on", "er", "at", "ing", "re", "st", "ha"]) for _ in range(chance.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    chance = random.Random(4)
    rows = []
    for i in range(500):
        own = words(chance, chance.randint(5, 300))
        if i % 4 == 0:
            own = [w + chance.choice(["###", "$$$"]) for w in own] if i % 8 else own[:2] * (len(own) // 2)
        rows.append((i, " ".join(own), int(i % 4 > 0)))
    rows += [(900, None, 1), (901, "", 1), (902, "text", None), (None, "text", 1)]
    frame = spark.createDataFrame(rows, "key bigint, text string, label int")
    return quality.fit(frame.select("key", "text"), frame.select("key", "label"))


def plain_scores(model, texts):
    """Scores text by text and passage by passage, with all passages of a text at hand."""
    out = []
    for text in texts:
        w, hidden, attention = model.weights, [], []
        for part in quality.segments(text or ""):
            for row in quality.encode([part])[1].astype(float):
                h = np.tanh(np.clip((row - model.centre) / model.scale, -8, 8) @ w["in"] + w["in_bias"])
                hidden.append(h)
                attention.append(float(np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"]))) @ w["attend"]))
        shares = [math.exp(a - max(attention)) for a in attention]
        bag = sum(s / sum(shares) * h for s, h in zip(shares, hidden))
        out.append(1 / (1 + math.exp(-float(bag @ w["out"] + w["out_bias"][0]))))
    return out


def plain_facts(text):
    own = text.split()
    return len(set(own)) / len(own), max(map(own.count, own)) / len(own), sum(a == b for a, b in zip(own, own[1:])) / len(own)


def test_encoding_equals_plain_counts():
    chance = random.Random(2)
    texts = [" ".join(words(chance, 40) + ["again", "again", "Ümlaut", "12"]), "", "  \n ", "one"]
    part_of, rows = quality.encode(texts)
    assert part_of.tolist() == [0, 1, 2, 3] and not rows[1:3].any()
    assert rows[0, -quality.FACTS:-quality.FACTS + 3].tolist() == pytest.approx(plain_facts(texts[0]))
    kinds = [quality._class_of(char) for char in texts[0] + "\n"]
    assert rows[0, :quality.CLASSES].tolist() == pytest.approx([kinds.count(k) / len(kinds) for k in range(quality.CLASSES)])
    many, encoded = quality.encode([" ".join(words(chance, 64 * 5 + 1))])
    assert len(encoded) == 6 == len(many)


def test_gradients_equal_differences():
    random_ = np.random.default_rng(6)
    rows, starts = random_.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5])
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])
    shapes = {"in": (quality.WIDTH, 24), "in_bias": (24,), "tanh": (24, 12), "gate": (24, 12), "attend": (12,), "out": (24,), "out_bias": (1,)}
    w = {name: random_.normal(size=shape) * 0.2 for name, shape in shapes.items()}
    _, slopes = quality.gradients(w, rows, starts, labels, weights)
    for name in w:
        at = tuple(0 for _ in shapes[name])
        moved = [{**w, name: w[name].copy()} for _ in range(2)]
        moved[0][name][at] += 1e-5
        moved[1][name][at] -= 1e-5
        up, down = (quality.gradients(m, rows, starts, labels, weights)[0] for m in moved)
        assert (up - down) / 2e-5 == pytest.approx(slopes[name][at], abs=1e-6)


def test_passages_decide_and_long_texts_are_read_whole(model):
    chance = random.Random(11)
    clean = " ".join(words(chance, 200))
    bad = " ".join(w + "###" for w in words(chance, 200))
    long = " ".join(words(chance, 200_000))
    assert len(long) > 2 * quality.SEGMENT
    texts = [clean, bad, None, "", long, " ".join(words(chance, 20)), "x" * 3_000_000]
    scores = model.scores(texts)
    assert scores[0] > 0.9 and scores[1] < 0.3 and scores[4] > 0.9 and scores[5] > 0.9
    assert scores.tolist() == pytest.approx(plain_scores(model, texts), abs=1e-9)


def test_awkward_rows(spark, model):
    rows = quality.score(documents(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3) for row in rows)
    assert len({row.score for row in rows if row.doc_id == 10}) == 1
    assert quality.score(documents(spark, []), model).collect() == []


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1], [None]])
def test_one_sided_labels(spark, labels):
    rows = spark.createDataFrame([(i, "text", label) for i, label in enumerate(labels)], "key bigint, text string, label int")
    model = quality.fit(rows.select("key", "text"), rows.select("key", "label"))
    assert {row.predicted for row in quality.score(rows.select(F.col("key"), "text"), model).collect()} <= {int(labels != [0, 0])}


def test_op13_equals_a_plain_scorer_and_tells_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    rows = {row.doc_id: row for row in queries.QUERIES["op13_passage_quality"](spark, at).collect()}
    docs = spark.read.parquet(f"{at}/documents.parquet")
    texts = docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text")
    told = spark.read.parquet(f"{at}/labels.parquet").where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    fitted = quality.fit(texts, told)
    table = docs.select("doc_id", "text").collect()
    assert len(rows) == len(table)
    assert [rows[i].score for i, _ in table] == pytest.approx(plain_scores(fitted, [text for _, text in table]), abs=1e-6)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{at}/labels.parquet'").fetchall())
    good, bad = (np.array([row.score for i, row in rows.items() if row.held_out and labels.get(i) == value]) for value in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.95
