from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tarmac.llm import nearcopies
from tests.llm.awkward import ROWS, components, documents

SF = "/root/testdata/sf0.001"


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def alike(a, b, similarity=0.8):
    return a == b or len(a & b) / len(a | b) >= similarity


def expected_ids(rows):
    """Smallest id, null ids last, of each component under brute-force Jaccard."""
    sets = [plain_set(text) for _, text in rows]
    roots = components(range(len(rows)), lambda a, b: alike(sets[a], sets[b]))
    groups = {}
    for at, root in roots.items():
        groups.setdefault(root, []).append(rows[at][0])
    return sorted((min((i for i in ids if i is not None), default=None) for ids in groups.values()), key=str)


def varied(chance):
    """Copies with up to a quarter of their shingles changed, one large group of them, and texts that share a common line."""
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(chance.choices(vocabulary, k=20))
    texts = [" ".join(chance.choices(vocabulary, k=30)) + " " + line for _ in range(40)]
    for copies in [1] * 40 + [60]:
        base = chance.choices(vocabulary, k=chance.randrange(20, 200))
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(chance.randrange(1, 2 + len(words) // 30)):
                words[chance.randrange(len(words))] = chance.choice(vocabulary)
            texts.append(" ".join(words))
    chance.shuffle(texts)
    return list(enumerate(texts))


def test_shingles_are_the_distinct_five_word_runs():
    for _, text in varied(random.Random(3))[:50] + [(row[0], row[1]) for row in ROWS]:
        assert len(nearcopies.shingles(text)) == len(plain_set(text))
    assert (nearcopies.shingles("A b c\td e f") == nearcopies.shingles("a b c d e f")).all()


@pytest.mark.parametrize("options", [{}, {"pairwise": 0, "rounds": 0}, {"pairwise": 2, "rounds": 1}, {"pairwise": 1000}])
def test_keep_one_equals_brute_force_jaccard(spark, options):
    rows = varied(random.Random(7))
    kept = nearcopies.keep_one(documents(spark, [(i, t, "en", "a") for i, t in rows]), **options)
    found = sorted((row.doc_id for row in kept.collect()), key=str)
    assert found == expected_ids(rows)
    assert len(found) < len(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id for row in kept.collect()), key=str) == expected_ids([(row[0], row[1]) for row in ROWS])
    assert nearcopies.keep_one(documents(spark, [])).collect() == []


def test_the_stage_drops_copies_that_differ_in_many_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    single = spark.createDataFrame(docs.collect(), docs.schema)
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, single, SF).collect()
    assert sorted((row.doc_id for row in kept), key=str) == expected_ids(rows)
    assert len(kept) < len(rows)


def test_simhash_blocks_link_without_any_band(spark, monkeypatch):
    """The SimHash operator proposes pairs of its own: with sets that share no band, close fingerprints are still checked and linked."""
    text = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, text, "en", "a"), (2, f"{text} w1 w2 w3", "en", "a"), (3, " ".join(f"v{i}" for i in range(50)), "en", "a")]
    assert (nearcopies.simhash.fingerprint(rows[0][1], 5) ^ nearcopies.simhash.fingerprint(rows[1][1], 5)).bit_count() <= 2
    monkeypatch.setattr(nearcopies, "_sharing", lambda classes: classes.where("false").select(classes["print"].alias("node")))
    assert sorted(row.doc_id for row in nearcopies.keep_one(documents(spark, rows)).collect()) == [1, 3]


def test_a_large_group_near_the_limit_gives_few_pairs_to_check(spark, monkeypatch):
    """Edits that many texts share let these meet pair by pair; those too different to link are not checked."""
    chance = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        words = list(base)
        for place in chance.sample(range(0, 150, 5), chance.randrange(2, 9)):
            words[place] = f"x{place}"
        texts.append(" ".join(words))
    rows = list(enumerate(dict.fromkeys(texts)))
    checked, verified = [], nearcopies._verified

    def counted(pairs, sets, similarity):
        checked.append(pairs.distinct().count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    kept = nearcopies.keep_one(documents(spark, [(i, t, "en", "a") for i, t in rows]))
    assert sorted((row.doc_id for row in kept.collect()), key=str) == expected_ids(rows)
    assert sum(checked) < 5 * len(rows)


def test_parity_bits_differ_in_no_more_places_than_the_sets():
    rows = [text for _, text in varied(random.Random(5))][:60] + ["", "one", " ".join(f"w{i}" for i in range(5000))]
    for one in rows:
        for two in rows:
            a, b = nearcopies.shingles(one), nearcopies.shingles(two)
            differing = sum(int(x).bit_count() for x in (nearcopies.parities(a) ^ nearcopies.parities(b)).view("u8"))
            assert differing <= len(set(a.tolist()) ^ set(b.tolist()))
