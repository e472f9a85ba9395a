"""Closed-form meshes and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import scalars
from tessellar.mesh import Mesh
from tessellar.operators import composites, editing, graphs, matrices, metrics, spatial, spectral, statistics, topology, volumes

CUBE_V = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
CUBE_F = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def mesh_of(spark, vertices, faces):
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vertices)], "v_id bigint, x double, y double, z double")
    names = "abcd"[: len(faces[0])]
    return Mesh(v, spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "f_id bigint, " + ", ".join(f"{c} bigint" for c in names)))


@pytest.fixture(scope="module")
def cube(spark):
    return mesh_of(spark, CUBE_V, CUBE_F)


@pytest.fixture(scope="module")
def sphere(spark):
    """Icosahedron refined twice, pushed to the unit sphere."""
    g = (1 + 5**0.5) / 2
    v = [(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)]
    f = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    m = mesh_of(spark, v, f).refine(2)
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    out = m.vertices.withColumn("l", size)
    v = sorted(out.select("v_id", F.col("x") / F.col("l"), F.col("y") / F.col("l"), F.col("z") / F.col("l")).collect())
    f = sorted(m.faces.select("f_id", "a", "b", "c").collect())
    return mesh_of(spark, [r[1:] for r in v], [tuple(r[1:]) for r in f])


def one(df):
    return df.first()[0]


def test_cube_topology(cube):
    s = cube.topology_summary().first()
    assert (s.euler, s.is_closed, s.is_manifold, s.is_oriented) == (2, True, True, True)
    assert cube.edges.count() == 18
    assert one(cube.vertex_face_counts().agg(F.sum("n_faces"))) == 36
    assert cube.validated() is cube


def test_cube_metrics(cube):
    assert one(cube.area()) == pytest.approx(6)
    assert abs(one(cube.volume())) == pytest.approx(1)
    assert cube.centroid().first()[:3] == pytest.approx((0.5, 0.5, 0.5))
    assert one(cube.vertex_areas().agg(F.sum("area"))) == pytest.approx(6)
    moved = Mesh(cube.vertices.withColumn("x", F.col("x") + 10), cube.faces)
    assert one(moved.volume()) == pytest.approx(one(cube.volume()))
    assert one(cube.normalize("number").area()) == pytest.approx(6 / 4)
    assert one(cube.unit_normalize().area()) == pytest.approx(1)


def test_dangling_corner_is_refused(spark):
    with pytest.raises(ValueError):
        mesh_of(spark, CUBE_V[:3], [(0, 1, 7)]).validated()


def test_refine_keeps_area_and_euler(cube):
    fine = cube.refine()
    assert fine.faces.count() == 48 and fine.vertices.count() == 8 + 18
    assert one(fine.area()) == pytest.approx(6) and one(fine.euler()) == 2


def test_mask_renumbers(cube, spark):
    kept = cube.apply_mask(cube.vertices.select("v_id", (F.col("x") == 0).cast("int").alias("keep")))
    assert sorted(r.v_id for r in kept.vertices.collect()) == [0, 1, 2, 3] and kept.faces.count() == 2
    with pytest.raises(ValueError):
        cube.apply_mask(cube.vertices.select("v_id", F.lit(2).alias("keep")))


def test_components_and_threshold(cube, spark):
    two = cube.combine_surfaces(cube)
    assert two.connected_components().select("component").distinct().count() == 2
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 3.0), (0, 2, 4.0), (2, 3, 2.0)], "i bigint, j bigint, w double")
    assert editing.threshold_minimum(edges) == 2.0


def test_orient_repairs_turned_faces(cube):
    turned = Mesh(cube.vertices, cube.faces.select("f_id", F.when(F.col("f_id") < 5, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("f_id") < 5, F.col("a")).otherwise(F.col("b")).alias("b"), "c"))
    fixed = turned.orient()
    assert one(fixed.is_oriented()) and one(fixed.volume()) == pytest.approx(1)


def test_shortest_path(cube):
    hops = {r.v_id: r.distance for r in cube.shortest_path_length(0).collect()}
    assert hops[0] == 0 and hops[7] == 2 and len(hops) == 8


def test_tetrahedra(spark):
    tet = mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2, 3)])
    assert one(tet.volume()) == pytest.approx(1 / 6) and tet.to_triangular().faces.count() == 4
    assert one(tet.area()) == pytest.approx(1.5 + 3**0.5 / 2)
    fine = tet.refine()
    assert fine.faces.count() == 8 and one(fine.volume()) == pytest.approx(1 / 6)
    turned = Mesh(tet.vertices, tet.faces.selectExpr("f_id", "b AS a", "a AS b", "c", "d"))
    assert one(turned.orient().is_oriented())


def test_eigenmodes_of_the_sphere(sphere):
    modes = sphere.eigenmodes(9)
    values = [r["lambda"] for r in modes.select("k", "lambda").distinct().orderBy("k").collect()]
    assert values[0] == pytest.approx(0, abs=1e-8)
    assert np.allclose(values[1:4], 2, rtol=0.05) and np.allclose(values[4:9], 6, rtol=0.08)
    mass = sphere.vertex_areas()
    norm = modes.join(mass, "v_id").groupBy("k").agg(F.sum(F.col("psi") ** 2 * F.col("area")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norm)
    rows = sphere.fem_stiffness().groupBy("i").agg(F.sum("w").alias("s")).agg(F.max(F.abs("s")))
    assert one(rows) < 1e-9


def test_tetrahedral_elements(spark):
    """The energy of a linear function is its squared slope times the volume; masses add up to the volume."""
    mesh = mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2, 3)]).refine(1)
    k = mesh.fem_stiffness()
    f = mesh.vertices.select("v_id", (2 * F.col("x") - F.col("y") + 3 * F.col("z")).alias("f"))
    energy = k.join(f.withColumnRenamed("v_id", "i").withColumnRenamed("f", "p"), "i").join(f.withColumnRenamed("v_id", "j").withColumnRenamed("f", "q"), "j").agg(F.sum(F.col("w") * F.col("p") * F.col("q")))
    assert one(energy) == pytest.approx(14 / 6)
    for lump in (True, False):
        assert one(mesh.fem_mass(lump).agg(F.sum("w"))) == pytest.approx(1 / 6)
    assert mesh.eigenmodes(3).where("k = 0").first()["lambda"] == pytest.approx(0, abs=1e-9)


def test_geodesic_distance_of_the_sphere(sphere):
    far = sphere.geodesic_distance(sphere.vertices.where("v_id = 0").select("v_id"))
    p = sphere.vertices.where("v_id = 0").first()
    angle = F.acos(F.least(F.greatest(F.col("x") * p.x + F.col("y") * p.y + F.col("z") * p.z, F.lit(-1.0)), F.lit(1.0)))
    error = far.join(sphere.vertices, "v_id").agg(F.max(F.abs(F.col("value") - angle)), F.avg(F.abs(F.col("value") - angle))).first()
    assert error[0] < 0.35 and error[1] < 0.12
    near = sphere.geodesic_knn(0, 5).collect()
    assert len(near) == 5 and all(r.distance < 0.5 for r in near)


def test_curvature_of_the_sphere(sphere):
    k = sphere.curvature(1).agg(F.avg("k_mean"), F.stddev_pop("k_mean")).first()
    assert abs(abs(k[0]) - 1) < 0.1 and k[1] < 0.1


def test_reconstruction(spark):
    rng = np.random.default_rng(0)
    psi, beta = rng.normal(size=(30, 4)), np.array([2.0, -1.0, 0.5, 3.0])
    modes = spark.createDataFrame([(v, k, float(psi[v, k])) for v in range(30) for k in range(4)], "v_id bigint, k bigint, psi double")
    data = spark.createDataFrame([(v, float(psi[v] @ beta)) for v in range(30)], "v_id bigint, value double")
    got = spectral.eigen_decomposition(data, modes)
    assert np.allclose([r.beta for r in got.orderBy("k").collect()], beta)
    recon = {r.v_id: r.value for r in spectral.reconstruct_data(got, modes).collect()}
    assert np.allclose([recon[v] for v in range(30)], psi @ beta)
    assert spectral.incremental_recon(data, got, modes).orderBy("n").collect()[-1].r == pytest.approx(1)


def test_correlation_p_value():
    assert statistics._correlation_p(0.5, 20) == pytest.approx(0.0247, abs=2e-4)
    assert statistics._correlation_p(0.0, 10) == pytest.approx(1) and statistics._correlation_p(1.0, 10) == 0


def test_constant_map_has_no_correlation(spark):
    m = spark.createDataFrame([(i, 1.0) for i in range(5)], "v_id bigint, value double")
    assert statistics.compare_images(m, m).first().r is None


def test_nearest_equals_brute_force(spark):
    p = np.random.default_rng(1).normal(size=(60, 3))
    pts = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "v_id bigint, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.diag([np.inf] * 60)
    got = {r.v_id: r.ref_id for r in spatial.nearest_neighbor(pts, pts, exclude_self=True).collect()}
    assert got == dict(enumerate(d.argmin(1).tolist()))
    with pytest.raises(ValueError):
        spatial.find_vertex_correspondence(pts, pts.withColumn("x", F.col("x") + 50), 0.5)


def test_spherical_harmonics(spark):
    pts = spark.createDataFrame([(0, 0.3, 1.1)], "v_id bigint, theta double, phi double")
    r = spectral.spherical_harmonics(pts, 1, 0).first()
    assert r.re == pytest.approx(math.sqrt(3 / (4 * math.pi)) * math.cos(1.1)) and r.im == pytest.approx(0)


def test_volumes(spark):
    block = spark.createDataFrame([(x, y, z) for x in range(3) for y in range(3) for z in range(3)], "vx bigint, vy bigint, vz bigint")
    assert volumes.boundary_voxels(block).count() == 26 and volumes.dilate(block).count() == 125
    ring = volumes.smooth(block.withColumn("value", F.lit(1.0)), 1.0, (3, 3, 3), "wrap")
    assert one(ring.agg(F.min("value"))) == pytest.approx(1) and one(ring.agg(F.max("value"))) == pytest.approx(1)


def test_scalars(spark):
    row = spark.createDataFrame([("/data/x/lh.map.nii.gz", bytes([1, 0, 2]))], "p string, b binary").select(scalars.split_filename(F.col("p")).alias("s"), scalars.get_ext(F.col("p")).alias("e"), scalars.three_byte_int(F.col("b")).alias("n")).first()
    assert tuple(row.s) == ("/data/x", "lh.map", ".nii.gz") and row.e == "gz" and row.n == 65538


def test_symmetric_vector_round_trip(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0), (2, 3, 4.0)], "i bigint, j bigint, w double")
    back = matrices.unravel_symmetric(matrices.ravel_symmetric(m, 4), 4, part="upper")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))
    assert one(matrices.is_symmetric(matrices.make_symmetric(m))) and not one(matrices.is_symmetric(m))


def test_empty_mesh(spark):
    empty = Mesh(spark.createDataFrame([], "v_id bigint, x double, y double, z double"), spark.createDataFrame([], "f_id bigint, a bigint, b bigint, c bigint"))
    assert one(empty.euler()) == 0 and one(empty.is_closed()) and one(empty.area()) is None
    assert empty.vertex_areas().count() == 0 and topology.dense_ids(empty.vertices, "v_id").count() == 0


def test_facade_methods_that_take_frames(spark, cube):
    assert cube.cell_types().first().asDict() == {"types": [3], "n_types": 1, "unique_type": True, "only_vertex": False, "only_line": False, "only_triangle": True, "only_quad": False}
    named = Mesh(cube.vertices.withColumn("label", (F.col("v_id") % 3).cast("int")).withColumn("value", F.col("x") * 2), cube.faces)
    assert {r.label: r["mean"] for r in named.parcellate().collect()} == pytest.approx({1: 4 / 3, 2: 1.0})


def test_volume_needs_a_closed_oriented_surface(spark, cube):
    assert cube.volume().first().volume == pytest.approx(1)
    for broken in (CUBE_F[1:], [(1, 0, 3), *CUBE_F[1:]]):
        with pytest.raises(Exception, match="not defined"):
            mesh_of(spark, CUBE_V, broken).volume().collect()


def test_edge_flags_agree_with_the_single_tests(spark, cube):
    for faces in (CUBE_F, CUBE_F[1:], [(1, 0, 3), *CUBE_F[1:]], [*CUBE_F, (0, 1, 7)]):
        mesh = mesh_of(spark, CUBE_V, faces)
        flags = mesh.edge_flags().first()
        assert (flags.is_closed, flags.is_manifold, flags.is_oriented) == (mesh.is_closed().first()[0], mesh.is_manifold().first()[0], mesh.is_oriented().first()[0])
        assert mesh.topology_summary().first().euler == mesh.euler().first()[0]


def test_resels_and_commas(spark):
    assert scalars.resel_count((10, 20, 30), 2.0) == 5 * 10 * 15
    rows = spark.createDataFrame([("a,b,,c",), ("",), (None,)], "s string").select(scalars.split_commas(F.col("s"))).collect()
    assert [r[0] for r in rows] == [["a", "b", "", "c"], [""], None]


def test_random_names(spark):
    assert len(one(spark.range(1).select(scalars.random_column_name(12)))) == 12


def test_ellipsoid_axes(spark):
    rows = spectral.ellipsoid_axes(spark.createDataFrame([(0, 0.0), (1, 4.0)], "k bigint, lambda double")).orderBy("k").collect()
    assert [r.axis for r in rows] == [0.0, 2.0]


def test_distances_from_every_vertex(sphere):
    rows = spectral.geodesic_distmat(sphere).collect()
    n = sphere.vertices.count()
    assert len(rows) == n * n
    xyz = {r.v_id: np.array([r.x, r.y, r.z]) for r in sphere.vertices.collect()}
    d = {(r.source, r.v_id): r.value for r in rows}
    assert all(abs(d[v, v]) < 1e-9 for v in xyz)
    true = np.array([math.acos(np.clip(xyz[a] @ xyz[b], -1, 1)) for a, b in d])
    assert np.corrcoef(true, list(d.values()))[0, 1] > 0.99


def test_heat_cost_equals_dijkstra(sphere):
    source = 0
    heat = {r.v_id: r.value for r in spectral.heat_diffusion(sphere, sphere.vertices.where("v_id = 0").select("v_id")).collect()}
    links = [(r[0], r[1]) for r in sphere.edges.select("i", "j").collect()]
    links += [(b, a) for a, b in links]
    cost = {v: math.inf for v in heat} | {source: 0.0}
    for _ in heat:
        for a, b in links:
            cost[b] = min(cost[b], cost[a] + heat[b])
    want = sorted((c, v) for v, c in cost.items() if v != source)[:7]
    got = spectral.heat_cost_knn(sphere, source, 7).collect()
    assert np.allclose(sorted(r.cost for r in got), [c for c, _ in want], rtol=1e-9, atol=1e-15)


def test_surface_from_all_modes_is_the_surface(cube):
    modes = cube.eigenmodes(8)
    back = spectral.reconstruct_surface(cube, modes, 8)
    rows = back.vertices.join(cube.vertices.select("v_id", *[F.col(k).alias("o" + k) for k in "xyz"]), "v_id").collect()
    assert len(rows) == 8
    assert max(abs(r[k] - r["o" + k]) for r in rows for k in "xyz") < 1e-9


def test_swaps_never_lower_the_correlation(spark, cube):
    modes = cube.eigenmodes(4).select("k", "v_id", "psi")
    data = cube.vertices.select("v_id", (F.col("x") + 2 * F.col("y") + 5 * F.col("z") + F.col("v_id") % 3).alias("value"))
    _, start = composites.optimum_eigengroups(data, modes, rounds=0)
    order, best = composites.optimum_eigengroups(data, modes, rounds=4, seed=1)
    assert best >= start
    places = {r.k: r.place for r in order.collect()}
    assert sorted(places) == sorted(places.values()) == [0, 1, 2, 3]
    assert all(int(k**0.5) == int(p**0.5) for k, p in places.items())


def test_width_of_a_gaussian_profile(spark):
    profile = spark.range(-60, 61).select(F.col("id").alias("pos"), F.exp(-F.col("id") ** 2 / (2 * 25.0)).alias("value"))
    assert one(volumes.estimate_fwhm(profile)) == pytest.approx(5 * math.sqrt(8 * math.log(2)), rel=1e-6)


def test_grid_holds_the_nearest_value(spark):
    points = [(0, 0.0, 0.0, 1.0), (1, 3.0, 0.0, 2.0), (2, 0.0, 2.0, 3.0), (3, 3.0, 2.0, 4.0)]
    frame = spark.createDataFrame(points, "v_id bigint, x double, y double, value double").withColumn("z", F.lit(0.0))
    got = {(r.gx, r.gy): r.value for r in volumes.points_to_grid(frame).collect()}
    want = {(gx, gy): min(points, key=lambda p: ((p[1] - gx) ** 2 + (p[2] - gy) ** 2, p[0]))[3] for gx in range(4) for gy in range(3)}
    assert got == want


def test_masks_and_surfaces_of_volumes(spark):
    axes = list(volumes.AXES)
    volume = spark.createDataFrame([(i, j, 0, 10.0 * i + j) for i in range(3) for j in range(3)], ", ".join(f"{a} bigint" for a in axes) + ", value double")
    mask = volume.withColumn("value", (F.col(axes[0]) == 1).cast("double"))
    assert sorted(r.value for r in volumes.masked_matrix(volume, mask).collect()) == [10.0, 11.0, 12.0]
    points = spark.createDataFrame([(0, 0.2, 1.9, 0.0), (1, 9.0, 0.0, 0.0)], "v_id bigint, x double, y double, z double")
    assert {r.v_id: r.value for r in volumes.volume_to_surface(volume, points).collect()} == {0: 2.0, 1: None}


def test_vertex_data(spark, cube):
    named = cube.with_vertex_data("u", cube.vertices.select("v_id", F.col("x").alias("u")))
    assert named.data_columns == ["u"] and named.vertex_data("u").count() == 8
    assert named.drop_vertex_data("u").data_columns == []
    with pytest.raises(KeyError):
        cube.vertex_data("u")
    assert cube.transform(lambda m, n: m.vertices.limit(n), 2).count() == 2


def test_orient_takes_few_rounds_along_a_strip(spark):
    """A strip of 300 triangles, every third turned over: labels jump, they do not step from face to face."""
    from tessellar.operators import topology

    faces = [(f, f, f + 1, f + 2) if (f % 2 == 0) != (f % 3 == 0) else (f, f + 1, f, f + 2) for f in range(300)]
    mesh = Mesh(spark.createDataFrame([(v, float(v // 2), float(v % 2), 0.0) for v in range(302)], "v_id bigint, x double, y double, z double"), spark.createDataFrame(faces, "f_id bigint, a bigint, b bigint, c bigint"))
    assert not topology.is_oriented(mesh).first()[0]
    out = mesh.orient(max_rounds=16)
    assert topology.is_oriented(out).first()[0] and out.faces.count() == 300
