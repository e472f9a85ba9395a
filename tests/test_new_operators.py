"""Point location, edge swaps, fingerprints and modularity by rounds of joins."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessellar.operators import composites, graphs, solvers, spatial, statistics
from tessellar.plans import catalogue
from tessellar.plans import fixtures as fx


def test_nearest_by_simplex(spark, sf_dir):
    mesh = fx.slab(spark, sf_dir)
    points = catalogue._probes(spark, sf_dir).where("v_id < 60")
    held = {r.v_id: r.f_id for r in spatial.locate(points, mesh).collect()}
    assert held and len(held) < 60
    xyz = {r.v_id: (r.x, r.y, r.z) for r in mesh.vertices.collect()}
    corners = {r.f_id: (r.a, r.b, r.c, r.d) for r in mesh.faces.collect()}
    at = {r.v_id: (r.x, r.y, r.z) for r in points.collect()}
    for radius in (None, 0.6):
        got = {r.v_id: r.ref_id for r in spatial.nearest_by_simplex(points, mesh, radius).collect()}
        for v, p in at.items():
            pool = [c for c in corners[held[v]] if radius is None or math.dist(p, xyz[c]) <= radius] if v in held else []
            assert got[v] == min(pool or xyz, key=lambda c: (math.dist(p, xyz[c]), c))


def _edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "i bigint, j bigint")


def test_swaps_keep_degrees(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)}
    out = [tuple(r) for r in graphs.rewire(_edges(spark, pairs), 4, 3).collect()]
    count = lambda es: Counter(v for e in es for v in e)
    assert len(set(out)) == len(out) == len(pairs) and all(i < j for i, j in out)
    assert count(out) == count(pairs)
    assert len(set(out) & pairs) < 0.6 * len(pairs)


def test_planted_rich_club(spark):
    hubs = list(range(8))
    pairs = {(a, b) for a in hubs for b in hubs if a < b} | {(h, 100 + 10 * h + k) for h in hubs for k in range(10)} | {(100 + k, 101 + k) for k in range(0, 79, 2)}
    row = graphs.normalized_rich_club(_edges(spark, pairs), 10, 4, 5).first()
    assert row.phi == 1 and row.random < 1 and row.ratio > 1.2


def test_modularity_by_rounds_of_joins(spark, monkeypatch):
    monkeypatch.setattr(solvers, "COARSE", 4)
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3), (6, 0), (7, 6), (8, 9), (9, 5)]
    a = np.zeros((10, 10))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    root = 1 / np.sqrt(a.sum(1))
    expected = np.linalg.eigvalsh(a - np.outer(root, root))[-1] / a.sum()
    got = graphs.modularity(spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i bigint, j bigint, w double"), "w").first()[0]
    assert got == pytest.approx(expected, abs=1e-9)


def test_svd_equals_dense(spark, sf_dir):
    data = fx.matrix(spark, sf_dir).where("pos < 8").select("i", "pos", "value")
    m = data.toPandas().pivot(index="i", columns="pos", values="value").to_numpy()
    u, s, v = np.linalg.svd(m, full_matrices=False)
    components, scores = statistics.svd(data, 5)
    c = components.toPandas()
    assert np.allclose(c.groupby("k")["s"].first().to_numpy(), s[:5])
    got = c.pivot(index="k", columns="pos", values="v").to_numpy()
    assert np.allclose(np.abs(got), np.abs(v[:5]), atol=1e-8)
    size = scores.groupBy("k").agg(F.sum(F.col("score") ** 2).alias("e")).toPandas().sort_values("k")["e"].to_numpy()
    assert np.allclose(size, s[:5] ** 2)


def test_fingerprints_project_copies_on_themselves(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((12, 9))
    rows = lambda ids, x: spark.createDataFrame([(int(i), p, float(v)) for i, r in zip(ids, x) for p, v in enumerate(r)], "i bigint, pos int, value double")
    gradient = spark.createDataFrame([(i, i * 10.0) for i in range(12)], "i bigint, value double")
    out = composites.fingerprint_projection(rows(range(12), m), rows(range(100, 112), 3 * m + 1), gradient)
    assert sorted((r.i, r.value) for r in out.collect()) == [(100 + i, i * 10.0) for i in range(12)]
