from __future__ import annotations

import random

import pytest
import xxhash

from tarmac.llm import simhash
from tests.llm.awkward import ROWS, components, documents


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


@pytest.mark.parametrize("text", [row[1] for row in ROWS] + ["a b", "A B c d", "É é É é"])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    rows = simhash.components(documents(spark)).collect()
    prints = {int(row.fingerprint, 16) for row in rows}
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for row in rows:
        root = roots[int(row.fingerprint, 16)]
        if row.doc_id is not None:
            least[root] = min(row.doc_id, least.get(root, row.doc_id))
    assert len(rows) == len(ROWS)
    assert all(row.component_id == least.get(roots[int(row.fingerprint, 16)]) for row in rows)


@pytest.mark.parametrize("pairwise", [0, 2, 8, 1000])
def test_links_lose_no_component_at_any_bucket_limit(spark, pairwise):
    chance = random.Random(5)
    prints = set()
    for _ in range(40):
        at = chance.getrandbits(64)
        for _ in range(chance.choice([1, 2, 3, 30])):
            prints.add(at)
            at ^= (1 << chance.randrange(64)) | (1 << chance.randrange(64)) * chance.randrange(2)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    expected = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "print bigint"), pairwise=pairwise).collect()
    near = {}
    for row in edges:
        near.setdefault(row.a, set()).add(row.b)
        near.setdefault(row.b, set()).add(row.a)
    found = components(prints, lambda a, b: signed[b] in near.get(signed[a], ()))
    assert found == expected


def test_keep_one_leaves_one_document_of_each_component(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [row.doc_id for row in rows]
    every = simhash.components(docs).collect()
    assert sorted(i for i in ids if i is not None) == sorted({row.component_id for row in every if row.component_id is not None})
    assert ids.count(10) <= 1


@pytest.mark.parametrize("operator", [simhash.components, simhash.keep_one])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []
