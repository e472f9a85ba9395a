"""Sparse solvers against dense algebra, with a coarsest level far below the size of the mesh."""

import numpy as np
import pytest
from tessellar.operators import solvers, spectral
from tessellar.plans import fixtures as fx


@pytest.fixture(scope="module")
def torus(spark, sf_dir):
    return fx.torus(spark, sf_dir, 1e-5)


def dense(entries, n):
    out = np.zeros((n, n))
    for i, j, w in entries.select("i", "j", "w").collect():
        out[i, j] += w
    return out


def test_eigenmodes_by_rounds_of_joins(spark, torus, monkeypatch):
    monkeypatch.setattr(solvers, "COARSE", 60)
    n = torus.vertices.count()
    k, m = dense(torus.fem_stiffness(), n), np.diag(dense(torus.fem_mass(), n))
    expected = np.linalg.eigvalsh(k / np.sqrt(np.outer(m, m)))[:4]
    modes = torus.eigenmodes(4, tol=1e-5).toPandas()
    assert np.allclose(modes.groupby("k")["lambda"].first().to_numpy(), expected, atol=1e-8)
    psi = modes.pivot(index="v_id", columns="k", values="psi").to_numpy()
    assert np.allclose(psi.T @ (m[:, None] * psi), np.eye(4), atol=1e-8)
    assert np.abs(k @ psi - m[:, None] * psi * expected).max() < 1e-4
    assert (psi[np.abs(psi).argmax(0), np.arange(4)] > 0).all()


def test_residuals(spark, torus):
    found = spectral.residuals(torus, torus.eigenmodes(5)).collect()
    assert len(found) == 5 and all(r.residual < 1e-9 and abs(r.mass - 1) < 1e-9 for r in found)


def test_heat_equals_dense_solves(spark, torus):
    n = torus.vertices.count()
    k, m = dense(torus.fem_stiffness(), n), dense(torus.fem_mass(), n)
    t = torus.average_edge_length().first()[0] ** 2
    heat = spectral.heat_diffusion(torus, torus.vertices.where("v_id IN (0, 77)").select("v_id")).toPandas()
    for source in (0, 77):
        got = heat[heat.source == source].sort_values("v_id")["value"].to_numpy()
        assert np.allclose(got, np.linalg.solve(m + t * k, np.eye(n)[source]), rtol=1e-6, atol=0)


def test_eigenmaps_equal_dense_ones(spark, sf_dir):
    graph = fx.similarity(spark, sf_dir)
    rows = graph.select("i", "j", "w").collect()
    ids = sorted({r.i for r in rows} | {r.j for r in rows})
    at = {v: p for p, v in enumerate(ids)}
    a = np.zeros((len(ids),) * 2)
    for i, j, w in rows:
        a[at[i], at[j]] = a[at[j], at[i]] = w
    d = a.sum(1)
    expected = np.linalg.eigvalsh((np.diag(d) - a) / np.sqrt(np.outer(d, d)))[1:4]
    out = spectral.laplacian_eigenmaps(graph, 3).toPandas()
    assert np.allclose(out.groupby("k")["lambda"].first().to_numpy(), expected, atol=1e-9)


def _path(spark, n, diagonal):
    a = np.diag(np.full(n, float(diagonal)))
    for i in range(n - 1):
        a[i, i + 1] = a[i + 1, i] = -1.0
        a[i, i] += 1
        a[i + 1, i + 1] += 1
    return a, spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i bigint, j bigint, w double")


def test_solutions_over_many_orders_of_magnitude(spark):
    n = 40
    a, entries = _path(spark, n, 2.0)
    b = np.zeros((2, n, 2))
    b[0, 0, 0] = b[0, 20, 1] = b[1, 39, 0] = 1.0  # the last column is zero
    rows = [(k, i, b[k, i].tolist()) for k in range(2) for i in range(n)]
    levels = solvers.Multilevel(entries, coarse=20)
    assert levels.levels
    out = solvers.decaying(levels.matrix, levels, spark.createDataFrame(rows, "blk bigint, i bigint, x array<double>")).collect()
    got = np.zeros_like(b)
    for k, i, x in out:
        got[k, i] = x
    expected = np.linalg.solve(a, b.transpose(1, 0, 2).reshape(n, 4)).reshape(n, 2, 2).transpose(1, 0, 2)
    assert np.abs(expected[0, :, 0]).min() < 1e-20 * np.abs(expected[0, :, 0]).max()
    assert np.allclose(got, expected, rtol=1e-2, atol=0)


def test_products_and_levels(spark):
    rng = np.random.default_rng(0)
    n = 90
    a = np.zeros((n, n))
    for i in range(n):  # a path with weak chords
        for j, w in ((i + 1, -1.0), (i + 7, -0.02)):
            if j < n:
                a[i, j] = a[j, i] = w
    a += np.diag(0.01 - a.sum(1))
    entries = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i bigint, j bigint, w double")
    x = rng.standard_normal((n, 4))
    block = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i bigint, x array<double>")
    got = np.array([r.x for r in solvers.product(entries, block).orderBy("i").collect()])
    assert np.allclose(got, a @ x)
    levels = solvers.Multilevel(entries, coarse=8)
    assert len(levels.levels) >= 2 and len(levels.ids) <= 8
    t = np.array([r.x for r in levels.apply(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.eye(n))], "i bigint, x array<double>")).orderBy("i").collect()])
    assert np.allclose(t, t.T) and np.linalg.eigvalsh((t + t.T) / 2).min() > 0
    spectrum = np.linalg.eigvals(t @ a).real
    assert spectrum.max() / spectrum.min() < 20 < np.linalg.cond(a) / 10


def test_written_tables_go(spark):
    import os

    from tessellar.operators.iteration import Tables

    tables = Tables(spark)
    one = tables.write(spark.range(3), "a")
    two = tables.write(one.selectExpr("id + 1 AS id"), "a")
    assert sorted(r.id for r in two.collect()) == [1, 2, 3]
    root = tables.root.removeprefix("file:")
    assert len([d for d in os.listdir(root) if not d.startswith(".")]) == 1
    tables.close()
    assert not [d for d in os.listdir(root) if not d.startswith(".")]
