from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import toxicity
from tests.llm.awkward import ROWS, documents

INSULTS = ["blockhead", "nitwit", "scoundrel"]


@pytest.fixture(scope="module")
def model(spark):
    chance = random.Random(9)
    clean = ["".join(chance.choice(["the", "on", "er", "at", "ing", "re", "st", "ha"]) for _ in range(chance.randint(1, 3))) for _ in range(400)]
    rows = []
    for i in range(600):
        words = chance.choices(clean, k=30)
        if i % 4 == 0:
            words[7] = chance.choice(INSULTS)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(900, None, 0), (901, "", 0), (902, "text", None)]
    table = spark.createDataFrame(rows, "key bigint, text string, label int")
    return toxicity.fit(table.select("key", "text"), table.select("key", "label"))


def test_kernel_prefers_disguised_forms_over_other_words():
    words = ["blockhead", "blockxhead", "blokhead", "thestering", "heaterst"]
    table = toxicity.dense(words)
    values = table @ table[0]
    assert values[0] == pytest.approx(values.max()) and min(values[1:3]) > 0.3 > 0.1 > max(values[3:])
    assert np.allclose(toxicity.kernel_with(words, table[:2]), table @ table[:2].T, atol=1e-5)


@pytest.mark.parametrize("form", ["blockhead", "BLOCKHEAD!", "block-head", "b.l.o.c.k.h.e.a.d", "bl0ckhead", "b l o c k h e a d", "nitxwit", "scoundrrel"])
def test_disguised_insults_are_found(model, form):
    scorer = toxicity.Scorer(model.triples, model.bias)
    worst = scorer.worst([f"the onst ing {form} at reha", "the onst ing at reha"])
    chance = 1 / (1 + np.exp(-(worst @ model.slopes + model.offset)))
    assert chance[0] > 0.5 > chance[1]


def test_awkward_rows(spark, model):
    docs = documents(spark)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5) for row in rows)
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_every_part_of_a_long_chunk_is_scored(model):
    scorer = toxicity.Scorer(model.triples, model.bias)
    long = scorer.worst(["re" * 500 + "blockhead" + "re" * 500, "re" * 1000])
    assert long[0, 0] > long[1, 0]


def test_an_insult_behind_clean_letters_is_learned(spark):
    """In the training texts insults stand behind 40 letters of a chunk only; the clean letters before them must not count as toxic."""
    chance = random.Random(3)
    clean = ["".join(chance.choice(["the", "on", "er", "ing", "re", "ha"]) for _ in range(3)) for _ in range(200)]
    head, rows = "stonelaternrivermountainwindowgardenpaper", []
    for i in range(400):
        words = chance.choices(clean, k=20)
        words[5] = head + ("blockhead" if i % 4 == 0 else chance.choice(clean))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "key bigint, text string, label int")
    fitted = toxicity.fit(table.select("key", "text"), table.select("key", "label"))
    worst = toxicity.Scorer(fitted.triples, fitted.bias).worst(
        [f"{clean[0]} {head}blockhead", "blockhead", f"{clean[0]} {head}", f"{head}{clean[1]}"])
    scores = 1 / (1 + np.exp(-(worst @ fitted.slopes + fitted.offset)))
    assert scores[0] > 0.5 > max(scores[2:]) and scores[1] > max(scores[2:])


def test_scores_equal_a_plain_scorer(spark, model):
    """The three worst of all chunks, each by its own triples one by one."""
    def margin(chunk):
        best = model.bias - 1.0
        for word in toxicity.windows(toxicity.letters(chunk)):
            if word:
                codes = [toxicity._FIRST, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 3 for c in word), toxicity._LAST]
                found = [(toxicity.DECAY ** (k - i - 2), codes[i] << 10 | codes[j] << 5 | codes[k]) for i in range(len(codes))
                         for j in range(i + 1, min(len(codes), i + toxicity.SPAN)) for k in range(j + 1, min(len(codes), i + toxicity.SPAN))]
                norm = sum(weight ** 2 for weight, _ in found) ** 0.5 or 1.0
                best = max(best, sum(weight * model.triples[code] for weight, code in found) / norm + model.bias)
        return best

    for row in toxicity.score(documents(spark).where("length(text) < 2000"), model).collect():
        worst = sorted([*map(margin, toxicity.units(row.text or "")), *[toxicity.FLOOR] * 3])[-3:][::-1]
        logit = np.clip(worst, toxicity.FLOOR, toxicity.CEILING) @ model.slopes + model.offset
        assert row.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_sided_labels(spark, labels):
    rows = spark.createDataFrame([(i, "text", label) for i, label in enumerate(labels)], "key bigint, text string, label int")
    model = toxicity.fit(rows.select("key", "text"), rows.select("key", "label"))
    assert {row.predicted for row in toxicity.score(rows.select(F.col("key"), "text"), model).collect()} <= {int(bool(labels and labels[0]))}
