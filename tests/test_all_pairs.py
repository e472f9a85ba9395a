"""All rows and vertices meet in the pairwise queries."""

import numpy as np
import pytest

from tessellar.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["pearson_pairwise_all", "pearson_cross_all", "spearman_pairwise_all", "euclidean_distmat_all"])
def test_every_pair(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 9, (12, 6)).astype(float)
    spark.createDataFrame([(i, i % 5, e[i].tolist()) for i in range(12)], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i % 3, float(i * i % 70)) for i in range(80)], "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.i, r.j): r[2] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    if name == "euclidean_distmat_all":
        v = np.array([(i % 40, i // 40, i * i % 70 / 100) for i in range(80)])
        expected = {(i, j): np.linalg.norm(v[i] - v[j]) for i in range(80) for j in range(i + 1, 80)}
    else:
        x = np.array([[np.mean(np.flatnonzero(np.sort(row) == c)) for c in row] for row in e]) if "spearman" in name else e
        r = np.corrcoef(x)
        pairs = [(i, j) for i in range(0, 12, 2) for j in range(1, 12, 2)] if "cross" in name else [(i, j) for i in range(12) for j in range(i + 1, 12)]
        expected = {p: r[p] for p in pairs}
    assert got.keys() == expected.keys() and all(got[p] == pytest.approx(expected[p], abs=2e-6) for p in expected)


def test_distances_of_all_vertices(spark, sf_dir):
    """No parcel is left out."""
    n = QUERIES["vertex_degrees"](spark, sf_dir).count()
    assert QUERIES["euclidean_distmat"](spark, sf_dir).count() == n * (n - 1) // 2
