"""Approximate neighbours: recall, exact scores, odd vectors."""

import math

import numpy as np
import pytest

from paperloom.llm import ann, entry
from paperloom.llm.ann import nearest_neighbours

VECTOR = "vec_id long, embedding array<float>, label int"


def exact(rows, asked, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, x in good:
        if q in asked:
            best = sorted(((-float((x * y).sum()), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def run(spark, rows, asked, k=5, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTOR).withColumnRenamed("label", "score")
    got = {}
    for r in nearest_neighbours(df, df.where(df.vec_id.isin(list(asked))), k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [3.0, 4.0]), (9, [0.5, 0.5])]
    got = run(spark, rows, set(range(10)))
    want = exact(rows, set(range(10)), 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_ties_go_to_the_smaller_id_within_a_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300)] + [(300 + k, rng.standard_normal(4).tolist()) for k in range(100)]
    got = run(spark, rows, {0, 7, 299}, k=5, block_rows=32, query_rows=2)
    assert [i for i, _ in got[7]][-5:] and all(len(v) == 5 for v in got.values())
    want = exact(rows, {0, 7, 299}, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_rows_and_none(spark):
    assert run(spark, [(1, [1.0, 0.0])], {1}) == {}
    df = spark.createDataFrame([], VECTOR)
    assert nearest_neighbours(df, df).count() == 0
    assert run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], {1}) == {1: [(2, 0.0)]}


@pytest.mark.parametrize("norms", ["unit", "any"])
def test_recall(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    if norms == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    asked = set(range(0, 4000, 40))
    got, want = run(spark, rows, asked, k=20, fit_rows=2000), exact(rows, asked, 20)
    hits = sum(s >= want[q][-1][1] - 1e-9 for q, v in got.items() for _, s in v)
    assert all(len(v) == 20 for v in got.values()) and hits / (20 * len(asked)) >= 0.9
    for q, v in got.items():
        assert v == sorted(v, key=lambda p: (-p[1], p[0]))


def test_rotation_keeps_products():
    turn = ann.rotation(16, 7)
    assert np.allclose(turn @ turn.T, np.eye(16))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = exact(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = {}
    for r in entry.op6_ann(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(s >= want[q][-1][1] - 1e-9 for q, v in got.items() for _, s in v)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("fit_rows", [16384, 64])
def test_repeated_ids_take_no_place_of_others(spark, fit_rows):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((60, 8)).tolist()
    rows = [(k, v) for k, v in enumerate(base) for _ in range(30)]
    asked = set(range(10))
    got = run(spark, rows, asked, k=20, fit_rows=fit_rows)
    assert all(len({i for i, _ in v}) == len(v) == 20 for v in got.values())
    want = exact(list(enumerate(base)), asked, 20)
    hits = sum(i in {j for j, _ in want[q]} for q, v in got.items() for i, _ in v)
    assert set(got) == asked and hits / (20 * len(asked)) >= 0.9
