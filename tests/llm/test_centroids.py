"""Clustering with bounds against plain rounds in integers."""

import hashlib

import numpy as np
import pytest

from weftline.llm import centroids as C


def plain(vectors, k, rounds, seed=3):
    """(assignment, centroids) by comparing all with all; vectors: (id, integers)."""
    first = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [list(v) for _, v in first]
    for turn in range(rounds + 1):
        near = [min(range(len(now)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, now[c])), c)) for _, v in vectors]
        if turn == rounds:
            return near, now
        for c in range(len(now)):
            if own := [v for (_, v), n in zip(vectors, near) if n == c]:
                now[c] = [sum(x) // len(own) for x in zip(*own)]


def rows_of(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, v array<int>").repartition(3)


@pytest.mark.parametrize(("k", "stored"), [(8, None), (8, 1), (5, 4), (3, 0), (1, None)])
def test_equal_to_plain_rounds(spark, k, stored):
    rng = np.random.default_rng(k)
    # few values, so distances tie; groups that shift for several rounds
    points = rng.integers(-3, 4, (150, 4)) + 6 * rng.integers(0, 3, (150, 1))
    vectors = [(int(i) if i % 11 else None, p.tolist()) for i, p in enumerate(points)] + [(7, points[7].tolist())] * 3
    near, now = plain(vectors, k, 6)
    made = C.cluster(rows_of(spark, vectors), k=k, rounds=6, stored=stored)
    assert made.centroids == now
    assert sorted((str(r["vec_id"]), r["v"], r["cluster"]) for r in made.assigned.collect()) == sorted((str(i), v, c) for (i, v), c in zip(vectors, near))


def test_bounds_save_comparisons(spark):
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(400, 16)) + 4 * rng.integers(0, 8, (400, 1))) * 100
    vectors = [(i, [int(x) for x in p]) for i, p in enumerate(points)]
    made = C.cluster(rows_of(spark, vectors))
    assert made.compared[0] == 8 * 400 and made.compared[-1] < 400
    assert [c for _, _, c in sorted(map(tuple, made.assigned.collect()))] == plain(vectors, 8, 10)[0]


def test_certified_rows_are_what_a_scan_gives():
    rng = np.random.default_rng(5)
    v, centroids = rng.integers(-50, 50, (300, 3)), rng.integers(-50, 50, (10, 3))
    x = C.scan(v, centroids, 4)
    for turn in range(12):
        after = centroids + rng.integers(-9 + turn // 2, 10 - turn // 2, centroids.shape)
        x = C.moved(x, after, np.sqrt(((after - centroids) ** 2).sum(axis=1)) * (1 + 1e-12), max(1, 4 - turn // 3))
        centroids = after
        exact = C.squared(v, centroids)
        assert (x.a == exact.argmin(axis=1)).all() and (x.upper**2 >= exact.min(axis=1)).all()
        assert (np.maximum(x.lower, 0) ** 2 <= np.take_along_axis(exact, x.near.astype(np.int64), axis=1)).all()
        others = np.ones(exact.shape, bool)
        np.put_along_axis(others, np.concatenate([x.a[:, None], x.near], axis=1).astype(np.int64), False, axis=1)
        assert (np.maximum(x.rest, 0) ** 2 <= np.where(others, exact, np.inf).min(axis=1)).all()


def test_which_vectors_are_kept(spark):
    good = [0.5] * 63 + [-0.00048828125]
    rows = [(1, good), (2, None), (3, [0.5] * 63), (4, good[:-1] + [None]), (5, good[:-1] + [float("nan")]), (6, good[:-1] + [float("-inf")]), (None, good), (1, good), (7, []), (8, [0.0] * 64)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, cluster string, v int")
    out = sorted(map(tuple, C.cluster_report(docs).collect()), key=str)
    assert [r[0] for r in out] == [1, 1, 8, None] and {r[2] for r in out} == {0} and {r[4] for r in out} == {0}
    digest = hashlib.sha256(",".join(["512"] * 63 + ["-1"]).encode()).hexdigest()
    assert {r[5] for r in out if r[0] != 8} == {digest}
    assert C.cluster_report(docs.limit(0)).collect() == [] and C.cluster_report(docs.filter("vec_id = 2")).collect() == []


def test_too_large_components_are_refused(spark):
    docs = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component beyond"):
        C.cluster_report(docs).collect()
