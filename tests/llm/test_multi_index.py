import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import multi_index as m


def brute(rows, k, is_query):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if is_query(i):
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_a_walk_visits_cells_in_order_of_summed_cost():
    r = np.random.default_rng(4)
    for _ in range(20):
        one, two = r.normal(size=7), r.normal(size=5)
        sizes = r.integers(0, 3, (7, 5))
        index = m.Index(np.zeros((7, 1)), np.zeros((5, 1)), sizes)
        want = [divmod(int(c), 5) for c in np.argsort((one[:, None] + two).ravel(), kind="stable")]
        want = [(i, j) for i, j in want if sizes[i, j]]
        assert index.walk(one, two, 10**9) == want
        some = index.walk(one, two, 6)
        assert some == want[: len(some)] and sum(sizes[c] for c in some) >= min(6, sizes.sum()) and sum(sizes[c] for c in some[:-1]) < 6


def vectors(n, d=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    return [(k, [float(np.float32(v)) for v in centres[k % 12] + 0.4 * r.normal(size=d)]) for k in range(n)]


@pytest.mark.parametrize("tile", [4096, 40])
def test_recall_and_exact_scores(spark, tile):
    rows = vectors(1500)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = m.search(df, F.col("vec_id") % 10 == 0, m.Settings(neighbours=10, tile=tile)).collect()
    want = brute(rows, 10, lambda i: i % 10 == 0)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys() and all(len(x) == 10 for x in found.values())
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    table = dict(rows)
    for q, x in found.items():
        assert x == sorted(x, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(np.dot(table[q], table[v])), abs=1e-12) for v, s in x)


def test_copies_of_one_vector_are_ranked_by_id(spark):
    rows = [(k, [0.6, 0.8, 0.1, 0.3]) for k in range(300)] + [(1000 + k, [-0.5, 0.01 * k, 0.2, 0.3]) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = m.search(df, F.col("vec_id") == 100, m.Settings(neighbours=7, tile=50, recall=1.0)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(7))
    assert len({r.score for r in got}) == 1


def test_unusable_vectors_take_no_part(spark):
    rows = vectors(40, 4)
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [1.0]), (106, []), (None, [1.0] * 4)]
    repeated = [rows[0], (1, [9.0] * 4)]
    df = spark.createDataFrame(rows + odd + repeated, "vec_id long, embedding array<float>")
    got = m.search(df, F.lit(True), m.Settings(neighbours=100, recall=1.0)).collect()
    kept = {**dict(rows), 1: min(rows[1][1], [9.0] * 4)}
    assert {r.query_id for r in got} == set(kept) and {r.vec_id for r in got} == set(kept)
    assert len(got) == 40 * 39  # all candidates, as there are fewer than asked for
    want = brute(sorted(kept.items()), 100, lambda i: True)
    for q in want:
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [v for v, _ in want[q]]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, n in (([], 0), ([(0, None)], 0), ([(0, [1.0])], 0), ([(0, [1.0]), (20, [2.0])], 2)):
        assert m.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).count() == n
    assert m.search(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_outliers_beside_tight_clusters_get_all_their_rows(spark):
    r = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(r.normal(size=(20, 8)))
    x = np.concatenate([unit(centres[np.arange(2000) % 20] + 1e-4 * r.normal(size=(2000, 8))), unit(r.normal(size=(3, 8)))])
    rows = [(k, [float(v) for v in y]) for k, y in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = m.search(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") >= 2000)).groupBy("query_id").count().collect()
    assert {r.query_id for r in got} == {*range(0, 2000, 20), *range(2000, 2003)} and {r["count"] for r in got} == {20}


@pytest.mark.parametrize("n", [10, 15, 20])
def test_fewer_candidates_than_asked_for_are_all_found(spark, n):
    got = m.search(spark.createDataFrame(vectors(n), "vec_id long, embedding array<float>"), F.lit(True)).groupBy("query_id").count().collect()
    assert len(got) == n and {r["count"] for r in got} == {n - 1}
