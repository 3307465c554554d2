from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarmac.llm import langid
from tests.llm.awkward import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the dog are here with that", "en", "a") for i in range(20)]
    rows += [(100 + i, "der hund und die katze sind hier mit dem", "de", "a") for i in range(20)]
    rows += [(300, None, "en", "a"), (301, "text", None, "a"), (302, "", "de", "a")]
    return langid.fit(documents(spark, rows).select(F.col("doc_id").alias("key"), "text", "lang"), PATH)


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"])
    table = np.random.default_rng(1).random((len(pieces), 2))
    table = langid._rows(table / table.sum(axis=0))
    place = {piece: i for i, piece in enumerate(pieces)}

    def total(word, language):
        if not word:
            return 1.0
        return sum(table[place[word[:n]], language] * total(word[n:], language) for n in range(1, len(word) + 1) if word[:n] in place)

    words = ["▁abab", "▁babb", "▁aaaa"]
    values = langid.forward(langid.Lattice(pieces).find(words), table)
    assert np.allclose(np.exp(values), [[total(word, k) for k in range(2)] for word in words])
    uses = langid.expected(langid.Lattice(pieces).find(words), table[:, 0], np.array([1.0, 2.0, 3.0]))
    lengths = np.array([len(piece) for piece in pieces])
    assert np.isclose(uses[:-2] @ lengths, 5 * 6.0)


def test_long_pieces_of_the_vocabulary_take_part():
    pieces = langid.vocabulary(PATH)
    long = max(pieces, key=len)
    assert len(long) > 12
    table = langid._rows(np.full((len(pieces), 1), 1e-9))
    table[pieces.index(long)] = 0.5
    assert langid.forward(langid.Lattice(pieces).find([long]), table)[0, 0] == pytest.approx(np.log(0.5), abs=1e-6)


def test_scores_equal_a_plain_scorer(model):
    """Sums over all segmentations word by word, with the fitted probabilities."""
    table = {piece: model.probabilities[i] for i, piece in enumerate(model.pieces)}
    unseen = model.probabilities[-1]

    def word_sum(word):
        sums = [np.ones(len(model.languages))]
        for end in range(1, len(word) + 1):
            total = np.zeros(len(model.languages))
            for start in range(end):
                total = total + sums[start] * table.get(word[start:end], unseen if end - start == 1 else 0.0)
            sums.append(total)
        return np.log(sums[-1])

    texts = ["the hund and that", "Internationale representatives, straßenbahn!", "qqq ñandú катя", "a", "12 und 13 the"]
    for text, (label, score) in zip(texts, langid.Scorer(model).predict(texts)):
        total = model.shares + sum(word_sum(langid.START + word) for word in langid.words_of(text))
        share = np.exp(total - total.max())
        share /= share.sum()
        assert label == model.languages[int(share.argmax())] and score == pytest.approx(share.max(), rel=1e-9)


def test_predictions_and_awkward_rows(spark, model):
    docs = documents(spark)
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for row in rows:
        letters = any(char.isalpha() for char in row.text or "")
        assert (row.lang_pred == langid.UNKNOWN) == (not letters)
        assert 0 <= row.score <= 1 and (letters or row.score == 0)
    found = {row.doc_id: row.lang_pred for row in rows}
    assert found[1] == "en" and found[4] == "de"


def test_very_long_words_are_scored(model):
    scorer = langid.Scorer(model)
    (label, score), = scorer.predict(["x" * 20_000])
    assert label in ("de", "en") and 0 <= score <= 1


def test_nothing_learned_and_empty_table(spark, model):
    empty = documents(spark, [])
    assert langid.predict(empty, model).collect() == []
    blank = langid.fit(empty.select(F.col("doc_id").alias("key"), "text", "lang"), PATH)
    assert {row.lang_pred for row in langid.predict(documents(spark), blank).collect()} == {langid.UNKNOWN}
