from __future__ import annotations

import math

import numpy as np
import pytest

from tarmac.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component string, key string, x string, index string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, *("x",) * 5) for i, v in rows], SCHEMA)


def plain(rows, components=16, kind=np.float32):
    """{(id, component): (n, deviation, |whitened|, explained)} by exact integers and one numpy eigh."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    widths = [len(v) for _, v in usable]
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    exact = [(i, tuple(math.floor(64 * float(kind(c))) + 1000000 for c in v)) for i, v in usable if len(v) == width]
    fit = sorted({x for _, x in exact})
    n, s = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    out = []
    for i, x in exact:
        distance = [n * a - b for a, b in zip(x, s)]
        place = np.array([d / n for d in distance]) @ vectors
        out += [(i, k + 1, n, sum(d * d for d in distance), abs(place[k] / np.sqrt(values[k])), values[k] / values.sum()) for k in range(kept)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def same(found, expected):
    rows = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[:4] for r in rows] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in rows], [r[4:] for r in expected], rtol=1e-7, atol=1e-7)
    assert all(r.identity_error <= 1e-4 for r in found)


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.QUERIES["op11_block_whitening"](spark, SF).collect()
    assert len(found) == 16 * len(rows)
    same(found, plain(rows))
    for component in (1, 16):  # one sign for all rows
        one = np.array([r.whitened for r in found if r.component == component])
        assert (one > 0).any() and (one < 0).any() and abs(one.mean()) < 0.01


def test_awkward_rows_and_many_small_blocks(spark):
    chance = np.random.default_rng(3)
    rows = [(i, [float(c) for c in chance.normal(size=5)]) for i in range(200)]
    rows += [(500 + i, rows[7][1]) for i in range(90)]  # one vector holds a third of the rows
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [math.nan] * 5),
             (904, [math.inf, 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [0.0] * 5)]
    found = whitening.whiten(table(spark, rows), block_bytes=8 * 5 * 9).collect()
    expected = plain(rows)
    assert {r.vec_id for r in found}.isdisjoint({900, 901, 902, 903, 904, 905}) and len(found) == len(expected)
    ordinary = [r for r in expected if r[0] is not None]
    same([r for r in found if r.vec_id is not None], ordinary)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_components(spark, rows):
    out = whitening.whiten(table(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_fewer_directions_than_components_and_clashing_names(spark):
    rows = [(i, [float(i % 7), float(i % 3), float(i % 7 + i % 3)]) for i in range(60)]
    found = whitening.whiten(table(spark, rows).drop("index").withColumnRenamed("vec_id", "index"), id_column="index")
    assert found.columns[0] == "index" and found.count() == 60 * 2


def test_values_beyond_a_long_sum_of_squares(spark):
    rows = [(i, [3e9 * (i % 11), -1e9 * (i % 5) + i, 2e10 if i == 4 else 0.0]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    same(whitening.whiten(frame).collect(), plain(rows, kind=float))
