import numpy as np
import pytest

from weftline.llm import embedding_dedup
from tests.llm.test_dedup import group_minima


def reference(vectors, threshold=0.9):
    usable = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    links = []
    for i in range(len(vectors)):
        for j in range(i):
            if usable[i] and usable[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_and_components_agree_with_all_pairs(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    near = [(c + rng.standard_normal(24) * s).astype(np.float32).tolist() for c in centres for s in rng.uniform(0.1, 0.7, 14)]
    vectors = [*near, near[0], near[0], [x * 3 for x in near[1]], None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [1.0, 0.0], [1.0, 0.1], [float("inf"), 1.0], [-0.0, 1.0], [0.0, 1.0], [1e-30] * 24]
    links = reference(vectors)
    assert 50 < len(links)
    least = group_minima(range(len(vectors)), links)
    frame = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, size string")
    out = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(frame, tile=tile).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == least
    assert {i: r["n_links"] for i, r in out.items()} == {i: sum(i in link for link in links) for i in out}
    assert all(r["kept"] == (least[i] == i) for i, r in out.items())


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, 64)) * rng.uniform(1e-3, 1e3, (200, 1))
    codes, scales, errors = embedding_dedup.quantise(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    guess = (codes.astype(float) @ codes.T.astype(float)) * scales[:, None] * scales
    bound = errors[:, None] + errors + errors[:, None] * errors + 1e-12
    assert (np.abs(guess - unit @ unit.T) <= bound).all()


def test_null_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.0])]
    out = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in embedding_dedup.similar_vectors(spark.createDataFrame(rows, schema)).collect())
    assert out == [(-1, 0, -1, True), (2, 1, 2, True), (4, 1, 2, False)]
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], schema)).count() == 0


def test_long_vectors_close_to_the_threshold(spark):
    # 2,048 dimensions, large equal parts so that sums pass 2**24, pairs within 1e-7 of 0.9 on both sides
    rng = np.random.default_rng(7)
    vectors = []
    for k in range(24):
        u = np.sign(rng.standard_normal(2048)) * rng.uniform(0.9, 1, 2048)
        u /= np.linalg.norm(u)
        w = rng.standard_normal(2048)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        cosine = 0.9 + (1e-7, -1e-7, 1e-8, -1e-8, 3e-9, -3e-9)[k % 6]
        vectors += [u.tolist(), (cosine * u + np.sqrt(1 - cosine**2) * w).tolist()]
    out = {r["vec_id"]: r for r in embedding_dedup.similar_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    links = reference(vectors)
    assert len(links) == 12 and {i: r["n_links"] for i, r in out.items()} == {i: sum(i in link for link in links) for i in out}
    codes = embedding_dedup.quantise(np.array(vectors))[0]
    exact = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert exact.max() > 1 << 24 and (embedding_dedup._products_of(codes.astype(np.float32), codes.astype(np.float32)) == exact).all()
