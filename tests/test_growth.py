"""Plans that keep tables off the driver and work in many tasks."""

import re

import numpy as np
import pytest

from tessellar import mesh
from tessellar.operators import graphs, iteration, spatial, statistics
from tessellar.plans import fixtures as fx
from tessellar.plans.catalogue import QUERIES


def plans_of(monkeypatch, module, run):
    """Physical plans of the frames that a loop cuts."""
    seen, cut = [], module.cut  # the module that calls it
    monkeypatch.setattr(module, "cut", lambda df: seen.append(df._jdf.queryExecution().toString()) or cut(df))
    run()
    return seen


def test_components_broadcast_nothing(spark, sf_dir, monkeypatch):
    """Labels compress to less than the broadcast threshold at any size; the joins of a round have a strategy of their own."""
    plans = plans_of(monkeypatch, iteration, lambda: graphs.connected_components(fx.height_field(spark, sf_dir)))
    joined = [p for p in plans if "Join" in p]
    assert joined and all("strategy=merge" in p and "BroadcastHashJoin" not in p for p in joined)


@pytest.mark.parametrize("name", ["boundary_edges", "boundary_loops", "fem_stiffness", "fem_mass_consistent", "to_triangular", "refine_faces", "refine_vertices", "split_surface_any", "smooth_n"])
def test_tasks_grow_with_the_mesh(spark, sf_dir, monkeypatch, name):
    """The rows of a mesh are dealt to more tasks than the session's shuffle has, with the same result."""
    expected = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(mesh, "TASK_VERTICES", 20)
    df = QUERIES[name](spark, sf_dir)
    got = sorted(map(tuple, df.collect()))
    assert len(got) == len(expected) and all(x == pytest.approx(y, abs=2e-6) for x, y in zip(got, expected))
    plans = [df._jdf.queryExecution().toString()] if name not in ("boundary_loops", "smooth_n") else plans_of(monkeypatch, iteration if name == "boundary_loops" else graphs, lambda: QUERIES[name](spark, sf_dir))
    tasks = [int(n) for p in plans for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", p)]
    assert tasks and max(tasks) >= 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_decomposition_in_tasks_of_like_size(spark, sf_dir, monkeypatch):
    """Every cell comes back, from more tasks than the session's shuffle has."""
    monkeypatch.setattr(statistics, "SVD_CELLS", 2000)
    df = QUERIES["svd_reconstruction"](spark, sf_dir)
    got = {(r.i, r.pos): r.value for r in df.collect()}
    expected = {(r.i, r.pos): r.value for r in fx.matrix(spark, sf_dir).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=2e-6) for k in expected)
    assert "hashpartitioning(i" in df._jdf.queryExecution().toString() and ", 16), REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()


def test_neighbours_broadcast_nothing(spark, sf_dir, monkeypatch):
    """The copies of the points in the cells around them grow past what the driver holds."""
    plans = plans_of(monkeypatch, iteration, lambda: QUERIES["nearest_neighbor"](spark, sf_dir))
    joined = [p for p in plans if "Join" in p]
    assert joined and all("strategy=merge" in p and "BroadcastHashJoin" not in p for p in joined)


def test_neighbours_near_the_borders_of_cells(spark):
    """Points on and beside the borders of cells and of the radius, against all pairs."""
    rng = np.random.default_rng(0)
    at = np.unique(np.concatenate([rng.integers(-4, 5, (60, 3)) * 0.5, rng.uniform(-2, 2, (60, 3)), rng.integers(-2, 3, (20, 3)) + 1e-9]), axis=0)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "v_id bigint, x double, y double, z double")
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    for radius in (0.5, 0.25, 1.0):
        got = {(r.v_id, r.ref_id) for r in spatial.within(points, points, radius).collect()}
        assert got == {(i, j) for i, j in zip(*np.nonzero(d <= radius))}


def test_decimate_broadcasts_no_ids(spark, sf_dir):
    plan = QUERIES["decimate"](spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin [a" not in plan and "BroadcastHashJoin [v_id" not in plan and plan.count("SortMergeJoin") >= 5


def test_edge_weights_broadcast_no_faces(spark, sf_dir):
    plan = QUERIES["edge_weights"](spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
