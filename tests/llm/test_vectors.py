from __future__ import annotations

import math

import numpy as np
import pytest

from tarmac.llm import vectors
from tests.llm.awkward import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, node string, copies string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], SCHEMA)


def made():
    random = np.random.default_rng(6)
    rows = []
    for label in (1, 2):
        for _ in range(30):
            centre = random.standard_normal(64)
            for _ in range(random.integers(1, 5)):
                rows.append((len(rows), (centre + 0.1 * random.standard_normal(64)).astype(np.float32).tolist(), label))
    hot = random.standard_normal(64)
    rows += [(len(rows) + i, (hot + 0.05 * random.standard_normal(64)).astype(np.float32).tolist(), 2) for i in range(60)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(5)]
    rows += [(1100, [2 * x for x in rows[0][1]], 1), (1101, rows[0][1], 2), (1102, rows[0][1], None)]
    rows += [(1200, None, 1), (1201, [0.0] * 64, 1), (1202, [math.nan] * 64, 1), (1203, [1.0, None], 1), (1204, [], 1),
             (1205, [1.0, 0.0], 1), (1206, [2.0, 0.0], 1), (1207, [math.inf] * 64, 1)]
    return rows


@pytest.mark.parametrize("chunk", [8, 256])
def test_links_equal_brute_force(spark, chunk):
    rows = made()
    usable = {}
    for i, vector, label in rows:
        if label is not None and vector and None not in vector and np.isfinite(vector).all() and np.any(vector):
            v = np.array(vector, dtype=float)
            usable[i] = (label, v / np.linalg.norm(v))

    def linked(a, b):
        return (usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1])
                and usable[a][1] @ usable[b][1] >= vectors.COSINE)

    expected = {i: sum(linked(i, j) for j in usable if j != i) for i in usable}
    found = {row.vec_id: row for row in vectors.link_vectors(table(spark, rows), chunk=chunk).collect()}
    assert len(found) == len(rows)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in found if i not in usable)
    assert all(found[i].n_links <= n for i, n in expected.items())
    assert sum(found[i].n_links for i in expected) >= 0.99 * sum(expected.values())
    roots = components(usable, linked)
    assert sum(found[i].component_id == roots[i] for i in usable) >= 0.99 * len(usable)


def test_repeated_rows_null_ids_and_empty_table(spark):
    vector = [1.0] * 64
    rows = vectors.link_vectors(table(spark, [(3, vector, 1), (3, vector, 1), (None, vector, 1)])).collect()
    assert [row.n_links for row in rows] == [2, 2, 2] and {row.component_id for row in rows} == {3}
    assert vectors.link_vectors(table(spark, [])).collect() == []
