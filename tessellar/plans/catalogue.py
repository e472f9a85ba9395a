"""Registered queries and their DuckDB equivalents.

Each query runs an operator over a whole fixture. Floating values are rounded to
six places and the sign of zero is dropped, as engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import scalars
from tessellar.operators import composites, editing, graphs, matrices, metrics, spatial, spectral, statistics, topology, volumes
from tessellar.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def r(c: Column | str, places: int = 6) -> Column:
    return (F.round(c, places) + F.lit(0.0)).cast("double")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r(c))
    return df


def R(e: str, places: int = 6) -> str:
    return f"(round(CAST({e} AS DOUBLE), {places}) + 0e0)"


_CELL = """n AS (SELECT count(*) // 40 AS h FROM part), cell AS (
  SELECT p_partkey AS v_id, p_partkey % 40 AS gi, p_partkey // 40 AS gj, CAST(p_retailprice AS DOUBLE) AS w, p_size AS label, h FROM part, n WHERE p_partkey < 40 * h)"""
_TORUS_V = """v AS (SELECT v_id, (3 + cos(2 * pi() * gj / h)) * cos(2 * pi() * gi / 40) AS x, (3 + cos(2 * pi() * gj / h)) * sin(2 * pi() * gi / 40) AS y, sin(2 * pi() * gj / h) AS z, w, label FROM cell)"""
_TORUS_F = """f AS (SELECT 2 * v_id AS f_id, v_id AS a, gj * 40 + (gi + 1) % 40 AS b, ((gj + 1) % h) * 40 + (gi + 1) % 40 AS c FROM cell
  UNION ALL SELECT 2 * v_id + 1, v_id, ((gj + 1) % h) * 40 + (gi + 1) % 40, ((gj + 1) % h) * 40 + gi FROM cell)"""
_FIELD_V = """v AS (SELECT v_id, CAST(gi AS DOUBLE) AS x, CAST(gj AS DOUBLE) AS y, w / 100 AS z, w, label FROM cell)"""
_FIELD_F = """f AS (SELECT 2 * v_id AS f_id, v_id AS a, v_id + 1 AS b, v_id + 41 AS c FROM cell WHERE gi < 39 AND gj < h - 1
  UNION ALL SELECT 2 * v_id + 1, v_id, v_id + 41, v_id + 40 FROM cell WHERE gi < 39 AND gj < h - 1)"""
_SIDES = """he AS (SELECT f_id, a AS src, b AS dst FROM f UNION ALL SELECT f_id, b, c FROM f UNION ALL SELECT f_id, c, a FROM f),
e AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, count(*) AS n_faces FROM he GROUP BY 1, 2),
fv AS (SELECT f_id, unnest([a, b, c]) AS v_id FROM f),
nb AS (SELECT i AS v_id, j AS neighbor FROM e UNION ALL SELECT j, i FROM e)"""
_METRIC = """g AS (SELECT f_id, a, b, c, va.x AS ax, va.y AS ay, va.z AS az, vb.x AS bx, vb.y AS by_, vb.z AS bz, vc.x AS cx, vc.y AS cy, vc.z AS cz
  FROM f JOIN v va ON va.v_id = a JOIN v vb ON vb.v_id = b JOIN v vc ON vc.v_id = c),
g2 AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz,
  (bx - ax) ^ 2 + (by_ - ay) ^ 2 + (bz - az) ^ 2 AS q0, (cx - bx) ^ 2 + (cy - by_) ^ 2 + (cz - bz) ^ 2 AS q1, (ax - cx) ^ 2 + (ay - cy) ^ 2 + (az - cz) ^ 2 AS q2 FROM g),
g3 AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nn FROM g2),
va AS (SELECT unnest([a, b, c]) AS v_id, nn / 2 AS s, nx, ny, nz FROM g3),
area AS (SELECT v_id, sum(s) / 3 AS area FROM va GROUP BY v_id)"""
TORUS = f"WITH RECURSIVE {_CELL}, {_TORUS_V}, {_TORUS_F}, {_SIDES}, {_METRIC}"
FIELD = f"WITH RECURSIVE {_CELL}, {_FIELD_V}, {_FIELD_F}, {_SIDES}, {_METRIC}"
SLAB = f"""WITH {_CELL}, {_FIELD_V}, {_FIELD_F},
s AS (SELECT f_id, list_sort([a, b, c]) AS t, 40 * h AS m FROM f, n),
tet AS (SELECT 3 * f_id AS f_id, t[1] AS a, t[2] AS b, t[3] AS c, t[3] + m AS d FROM s UNION ALL SELECT 3 * f_id + 1, t[1], t[2], t[2] + m, t[3] + m FROM s UNION ALL SELECT 3 * f_id + 2, t[1], t[1] + m, t[2] + m, t[3] + m FROM s),
v3 AS (SELECT v_id, x, y, z FROM v UNION ALL SELECT v_id + 40 * h, x, y, z + 1 FROM v, n)"""
MATRIX = """WITH m AS (SELECT vec_id AS i, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
GRAPH = """WITH RECURSIVE d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))), 9) AS w FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
top AS MATERIALIZED (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM d) WHERE r <= 10),
e AS MATERIALIZED (SELECT least(i, j) AS i, greatest(i, j) AS j, max(w) AS w FROM top GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT i AS v_id, j AS neighbor, w FROM e UNION ALL SELECT j, i, w FROM e)"""
MAPS = """WITH maps AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'HC' ELSE 'P' END AS grp, user_id AS subject, CAST(hour(ts) AS INTEGER) AS v_id, avg(value) AS value FROM events GROUP BY ALL),
pair AS (SELECT v_id, avg(CASE WHEN grp = 'HC' THEN value END) AS x, avg(CASE WHEN grp = 'P' THEN value END) AS y FROM maps GROUP BY v_id)"""
VOLUME = """WITH vol AS (SELECT l_suppkey % 10 AS vx, CAST(l_quantity AS BIGINT) % 10 AS vy, CAST(l_linenumber AS BIGINT) AS vz, count(*) AS value FROM lineitem GROUP BY ALL),
roi AS (SELECT vx, vy, vz FROM vol WHERE value >= (SELECT avg(value) FROM vol))"""
_PEARSON = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_OFFSETS = "o AS (SELECT a.x AS ox, b.x AS oy, c.x AS oz FROM (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS x) b, (SELECT unnest([-1, 0, 1]) AS x) c WHERE NOT (a.x = 0 AND b.x = 0 AND c.x = 0))"


# topology


@query(
    "mesh_summary",
    f"""{TORUS} SELECT (SELECT count(DISTINCT v_id) FROM fv) - (SELECT count(*) FROM e) + (SELECT count(*) FROM f) AS euler,
(SELECT count(*) FILTER (n_faces = 1) = 0 FROM e) AS is_closed, (SELECT max(n_faces) <= 2 FROM e) AS is_manifold,
(SELECT max(c) <= 1 FROM (SELECT count(*) AS c FROM he GROUP BY src, dst)) AS is_oriented,
{R("(SELECT sum(nn) / 2 FROM g3)")} AS area, {R("(SELECT sum(ax * nx + ay * ny + az * nz) / 6 FROM g3)")} AS volume""",
)
def mesh_summary(spark, sf_dir):
    mesh = fx.torus(spark, sf_dir)
    return rounded(mesh.topology_summary().crossJoin(mesh.area()).crossJoin(mesh.volume()), "area", "volume")


@query("edges_adjacency", f"{FIELD} SELECT i, j, n_faces FROM e")
def edges_adjacency(spark, sf_dir):
    return fx.height_field(spark, sf_dir).edges


@query("half_edge_counts", f"{TORUS} SELECT src, dst, count(*) AS n FROM he GROUP BY src, dst")
def half_edge_counts(spark, sf_dir):
    return topology.half_edge_counts(fx.torus(spark, sf_dir))


@query("vertex_face_counts", f"{FIELD} SELECT v_id, count(*) AS n_faces FROM fv GROUP BY v_id")
def vertex_face_counts(spark, sf_dir):
    return fx.height_field(spark, sf_dir).vertex_face_counts()


@query("vertex_degrees", f"{FIELD} SELECT v_id, count(*) AS degree FROM nb GROUP BY v_id")
def vertex_degrees(spark, sf_dir):
    return fx.height_field(spark, sf_dir).vertex_degrees()


@query("vertex_neighbors", f"{FIELD} SELECT neighbor FROM nb WHERE v_id = 45")
def vertex_neighbors(spark, sf_dir):
    return fx.height_field(spark, sf_dir).vertex_neighbors(45)


def _holed(spark, sf_dir):
    """The height field without the faces of one grid row, so some vertices are free."""
    mesh = fx.height_field(spark, sf_dir)
    return type(mesh)(mesh.vertices, mesh.faces.where("a >= 80"))


_HOLED = FIELD.replace("WHERE gi < 39 AND gj < h - 1", "WHERE gi < 39 AND gj < h - 1 AND v_id >= 80")


@query("is_manifold_closed_oriented", f"{FIELD} SELECT (SELECT max(n_faces) <= 2 FROM e) AS is_manifold, (SELECT count(*) FILTER (n_faces = 1) = 0 FROM e) AS is_closed, (SELECT max(c) <= 1 FROM (SELECT count(*) AS c FROM he GROUP BY src, dst)) AS is_oriented")
def is_manifold_closed_oriented(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    return mesh.is_manifold().crossJoin(mesh.is_closed()).crossJoin(mesh.is_oriented())


@query("has_free_vertices", f"{_HOLED} SELECT count(*) > 0 AS has_free_vertices FROM v WHERE v_id NOT IN (SELECT v_id FROM fv)")
def has_free_vertices(spark, sf_dir):
    return _holed(spark, sf_dir).has_free_vertices()


_REINDEX = "ids AS (SELECT v_id, row_number() OVER (ORDER BY v_id) - 1 AS new_id FROM kept)"


@query(
    "remove_free_vertices",
    f"{_HOLED}, kept AS (SELECT DISTINCT v_id FROM fv), {_REINDEX} SELECT f_id, ia.new_id AS a, ib.new_id AS b, ic.new_id AS c FROM f JOIN ids ia ON ia.v_id = a JOIN ids ib ON ib.v_id = b JOIN ids ic ON ic.v_id = c",
)
def remove_free_vertices(spark, sf_dir):
    return _holed(spark, sf_dir).remove_free_vertices()[0].faces.select("f_id", "a", "b", "c")


@query("free_vertices_dropped", f"{_HOLED} SELECT v_id FROM v WHERE v_id NOT IN (SELECT v_id FROM fv)")
def free_vertices_dropped(spark, sf_dir):
    return _holed(spark, sf_dir).remove_free_vertices()[1]


@query("boundary_edges", f"{FIELD} SELECT src, dst FROM he JOIN e ON i = least(src, dst) AND j = greatest(src, dst) WHERE n_faces = 1")
def boundary_edges(spark, sf_dir):
    return fx.height_field(spark, sf_dir).boundary_edges()


@query(
    "boundary_loops",
    f"""{FIELD}, b AS (SELECT src, dst FROM he JOIN e ON i = least(src, dst) AND j = greatest(src, dst) WHERE n_faces = 1),
walk(v_id, here) AS (SELECT src, src FROM b UNION SELECT walk.v_id, dst FROM walk JOIN b ON here = src)
SELECT v_id, min(here) AS loop FROM walk GROUP BY v_id""",
)
def boundary_loops(spark, sf_dir):
    return fx.height_field(spark, sf_dir).boundary_loops()


@query("cell_types", f"{FIELD} SELECT count(DISTINCT 3) AS n_types, TRUE AS only_triangle, FALSE AS only_quad FROM f")
def cell_types(spark, sf_dir):
    cells = fx.height_field(spark, sf_dir).faces.select(F.array("a", "b", "c").alias("cell"))
    return topology.cell_types(cells).select("n_types", "only_triangle", "only_quad")


# metrics


@query("tria_areas", f"{FIELD} SELECT f_id, {R('nn / 2')} AS area FROM g3")
def tria_areas(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).tria_areas(), "area")


@query("tria_normals", f"{FIELD} SELECT f_id, {R('nx / nn')} AS nx, {R('ny / nn')} AS ny, {R('nz / nn')} AS nz FROM g3")
def tria_normals(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).tria_normals(), "nx", "ny", "nz")


@query("tria_qualities", f"{FIELD} SELECT f_id, {R('2 * sqrt(3) * nn / (q0 + q1 + q2)')} AS quality FROM g3")
def tria_qualities(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).tria_qualities(), "quality")


@query("vertex_areas", f"{FIELD} SELECT v_id, {R('area')} AS area FROM area")
def vertex_areas(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).vertex_areas(), "area")


@query("vertex_normals", f"{FIELD} SELECT v_id, {R('sx / l')} AS nx, {R('sy / l')} AS ny, {R('sz / l')} AS nz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM (SELECT v_id, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM va GROUP BY v_id))")
def vertex_normals(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).vertex_normals(), "nx", "ny", "nz")


@query("centroid", f"{FIELD} SELECT {R('sum(nn * (ax + bx + cx) / 3) / sum(nn)')} AS cx, {R('sum(nn * (ay + by_ + cy) / 3) / sum(nn)')} AS cy, {R('sum(nn * (az + bz + cz) / 3) / sum(nn)')} AS cz, {R('sum(nn) / 2')} AS area FROM g3")
def centroid(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).centroid(), "cx", "cy", "cz", "area")


@query("average_edge_length", f"{TORUS} SELECT {R('avg(sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2))')} AS average_edge_length FROM e JOIN v p ON p.v_id = i JOIN v q ON q.v_id = j")
def average_edge_length(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).average_edge_length(), "average_edge_length")


def _normalized(kind: str, divisor: str, factor: float | None = None):
    body = ", ".join(f"{R(f'{k} / ({divisor}) ^ (1e0 / 3)')} AS {k}" for k in "xyz")

    @query(f"normalize_{kind}", f"{TORUS} SELECT v_id, {body} FROM v")
    def run(spark, sf_dir):
        return rounded(fx.torus(spark, sf_dir).normalize(kind, factor).vertices.select("v_id", "x", "y", "z"), "x", "y", "z")


_normalized("area", "SELECT sum(nn) / 2 FROM g3")
_normalized("volume", "SELECT abs(sum(ax * nx + ay * ny + az * nz) / 6) FROM g3")
_normalized("number", "SELECT CAST(count(*) AS DOUBLE) FROM v")
_normalized("constant", "SELECT 8e0", 8.0)


@query("unit_normalize", f"{TORUS}, c AS (SELECT sum(nn * (ax + bx + cx) / 3) / sum(nn) AS mx, sum(nn * (ay + by_ + cy) / 3) / sum(nn) AS my, sum(nn * (az + bz + cz) / 3) / sum(nn) AS mz, sum(nn) / 2 AS s FROM g3) SELECT v_id, {R('(x - mx) / sqrt(s)')} AS x, {R('(y - my) / sqrt(s)')} AS y, {R('(z - mz) / sqrt(s)')} AS z FROM v, c")
def unit_normalize(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).unit_normalize().vertices.select("v_id", "x", "y", "z"), "x", "y", "z")


@query("euclidean_distmat", f"{FIELD} SELECT p.v_id AS i, q.v_id AS j, {R('sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2)')} AS distance FROM v p JOIN v q ON p.v_id < q.v_id")
def euclidean_distmat(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).euclidean_distmat(), "distance")


@query("euclidean_distmat_all", f"{FIELD} SELECT p.v_id AS i, q.v_id AS j, {R('sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2)')} AS distance FROM v p JOIN v q ON p.v_id < q.v_id")
def euclidean_distmat_all(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).euclidean_distmat(), "distance")


# masks, thresholds, parcels


@query(
    "apply_mask",
    f"{FIELD}, kept AS (SELECT v_id FROM v WHERE label % 3 <> 0), {_REINDEX} SELECT f_id, ia.new_id AS a, ib.new_id AS b, ic.new_id AS c FROM f JOIN ids ia ON ia.v_id = a JOIN ids ib ON ib.v_id = b JOIN ids ic ON ic.v_id = c",
)
def apply_mask(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    mask = mesh.vertices.select("v_id", (F.col("label") % 3 != 0).cast("int").alias("keep"))
    return mesh.apply_mask(mask).faces.select("f_id", "a", "b", "c")


@query("map_to_mask", f"{FIELD}, kept AS (SELECT v_id FROM v WHERE label % 3 <> 0), {_REINDEX} SELECT v.v_id, coalesce(CAST(new_id * 2 AS DOUBLE), -1e0) AS value FROM v LEFT JOIN ids USING (v_id)")
def map_to_mask(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    mask = mesh.vertices.select("v_id", (F.col("label") % 3 != 0).cast("int").alias("keep"))
    data = mesh.vertices.select(F.col("v_id").alias("pos"), (F.col("v_id") * 2).cast("double").alias("value"))
    return editing.map_to_mask(data, mask, -1.0)


@query(
    "threshold_surface",
    f"""{FIELD}, kept AS (SELECT DISTINCT unnest([i, j]) AS v_id FROM e WHERE n_faces >= 2), {_REINDEX}
SELECT f_id, ia.new_id AS a, ib.new_id AS b, ic.new_id AS c FROM f JOIN ids ia ON ia.v_id = a JOIN ids ib ON ib.v_id = b JOIN ids ic ON ic.v_id = c""",
)
def threshold_surface(spark, sf_dir):
    return fx.height_field(spark, sf_dir).threshold_surface(2)[0].faces.select("f_id", "a", "b", "c")


@query("threshold_edges_variance", f"{GRAPH} SELECT i, j, {R('w')} AS w FROM e WHERE w >= 5 * (SELECT var_pop(w) FROM e)")
def threshold_edges_variance(spark, sf_dir):
    return rounded(editing.threshold_edges(fx.similarity(spark, sf_dir), 5.0, "variance"), "w")


@query("threshold_data", f"{FIELD} SELECT v_id, CASE WHEN abs(w) >= 1000 THEN w ELSE 0e0 END AS value FROM v")
def threshold_data(spark, sf_dir):
    return fx.height_field(spark, sf_dir).threshold_data("w", 1000.0)


@query(
    "combine_surfaces",
    f"""WITH {_CELL}, {_TORUS_V.replace("v AS", "v1 AS", 1)}, {_TORUS_F.replace("f AS", "f1 AS", 1)}, {_FIELD_V.replace("v AS", "v2 AS", 1)}, {_FIELD_F.replace("f AS", "f2 AS", 1)},
o AS (SELECT (SELECT max(v_id) + 1 FROM v1) AS ov, (SELECT max(f_id) + 1 FROM f1) AS of_)
SELECT f_id, a, b, c FROM f1 UNION ALL SELECT f_id + of_, a + ov, b + ov, c + ov FROM f2, o""",
)
def combine_surfaces(spark, sf_dir):
    return fx.torus(spark, sf_dir).combine_surfaces(fx.height_field(spark, sf_dir)).faces.select("f_id", "a", "b", "c")


def _split(how: str, having: str):
    @query(f"split_surface_{how}", f"{FIELD} SELECT label, f_id, a, b, c FROM (SELECT f_id, label, count(*) AS k FROM fv JOIN v USING (v_id) GROUP BY ALL) JOIN f USING (f_id) WHERE {having}")
    def run(spark, sf_dir):
        mesh = fx.height_field(spark, sf_dir)
        return mesh.split_surface(mesh.vertex_data("label"), how)


_split("any", "k >= 1")
_split("all", "k = 3")


@query("parcellate_data", f"{MATRIX} SELECT label, pos, {R('avg(value)')} AS mean FROM m WHERE label > 0 GROUP BY label, pos")
def parcellate_data(spark, sf_dir):
    return rounded(editing.parcellate(fx.matrix(spark, sf_dir), "label", "value", "pos"), "mean")


for _criterion, _expr in (("x", "x"), ("y", "y"), ("z", "z"), ("norm", "sqrt(x ^ 2 + y ^ 2 + z ^ 2)"), ("w", "w")):

    @query(f"sort_verts_{_criterion}", f"{FIELD} SELECT v_id, row_number() OVER (ORDER BY {_expr}, v_id) - 1 AS position FROM v")
    def sort_verts(spark, sf_dir, _criterion=_criterion):
        return fx.height_field(spark, sf_dir).sort_verts(_criterion)


@query(
    "decimate",
    f"""{FIELD}, near AS (SELECT p.v_id, min(sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2)) AS d FROM v p JOIN v q ON p.v_id <> q.v_id GROUP BY p.v_id),
kept AS (SELECT v_id FROM near ORDER BY d, v_id LIMIT (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM v)), {_REINDEX}
SELECT f_id, ia.new_id AS a, ib.new_id AS b, ic.new_id AS c FROM f JOIN ids ia ON ia.v_id = a JOIN ids ib ON ib.v_id = b JOIN ids ic ON ic.v_id = c""",
)
def decimate(spark, sf_dir):
    return fx.height_field(spark, sf_dir).decimate(0.5).faces.select("f_id", "a", "b", "c")


_MIDDLES = "mid AS (SELECT i, j, (SELECT max(v_id) + 1 FROM v) + row_number() OVER (ORDER BY i, j) - 1 AS m FROM e)"


@query(
    "refine_faces",
    f"""{FIELD}, {_MIDDLES}, s AS (SELECT f.*, p.m AS ab, q.m AS bc, r.m AS ca FROM f JOIN mid p ON p.i = least(a, b) AND p.j = greatest(a, b) JOIN mid q ON q.i = least(b, c) AND q.j = greatest(b, c) JOIN mid r ON r.i = least(c, a) AND r.j = greatest(c, a))
SELECT 4 * f_id AS f_id, a, ab AS b, ca AS c FROM s UNION ALL SELECT 4 * f_id + 1, ab, b, bc FROM s UNION ALL SELECT 4 * f_id + 2, ca, bc, c FROM s UNION ALL SELECT 4 * f_id + 3, ab, bc, ca FROM s""",
)
def refine_faces(spark, sf_dir):
    return fx.height_field(spark, sf_dir).refine().faces


@query("refine_vertices", f"{FIELD}, {_MIDDLES} SELECT v_id, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM v UNION ALL SELECT m, {R('(p.x + q.x) / 2')}, {R('(p.y + q.y) / 2')}, {R('(p.z + q.z) / 2')} FROM mid JOIN v p ON p.v_id = i JOIN v q ON q.v_id = j")
def refine_vertices(spark, sf_dir):
    return rounded(fx.height_field(spark, sf_dir).refine().vertices.select("v_id", "x", "y", "z"), "x", "y", "z")


@query(
    "to_triangular",
    f"""{SLAB}, t AS (SELECT 4 * f_id AS f_id, c AS a, b, a AS c FROM tet UNION ALL SELECT 4 * f_id + 1, a, b, d FROM tet UNION ALL SELECT 4 * f_id + 2, b, c, d FROM tet UNION ALL SELECT 4 * f_id + 3, c, a, d FROM tet)
SELECT f_id, a, b, c FROM t WHERE list_sort([a, b, c]) IN (SELECT list_sort([a, b, c]) FROM t GROUP BY 1 HAVING count(*) = 1)""",
)
def to_triangular(spark, sf_dir):
    return fx.slab(spark, sf_dir).to_triangular().faces


@query(
    "tet_volume",
    f"""{SLAB}, g AS (SELECT f_id, d.x - a.x AS dx, d.y - a.y AS dy, d.z - a.z AS dz, b.x - a.x AS bx, b.y - a.y AS by_, b.z - a.z AS bz, c.x - a.x AS cx, c.y - a.y AS cy, c.z - a.z AS cz
FROM tet JOIN v3 a ON a.v_id = tet.a JOIN v3 b ON b.v_id = tet.b JOIN v3 c ON c.v_id = tet.c JOIN v3 d ON d.v_id = tet.d)
SELECT count(*) AS n, {R("sum(abs(dx * (by_ * cz - bz * cy) + dy * (bz * cx - bx * cz) + dz * (bx * cy - by_ * cx))) / 6")} AS volume FROM g""",
)
def tet_volume(spark, sf_dir):
    mesh = fx.slab(spark, sf_dir)
    return rounded(mesh.faces.agg(F.count("*").alias("n")).crossJoin(mesh.volume()), "volume")


# matching


@query("nearest_neighbor", f"{FIELD}, p AS (SELECT p.v_id, q.v_id AS ref_id, sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2) AS d FROM v p JOIN v q ON p.v_id <> q.v_id) SELECT v_id, {R('min(d)')} AS distance FROM p GROUP BY v_id")
def nearest_neighbor(spark, sf_dir):
    v = fx.height_field(spark, sf_dir).vertices
    return rounded(spatial.nearest_neighbor(v, v, exclude_self=True).select("v_id", "distance"), "distance")


@query("vertex_correspondence", f"{FIELD} SELECT v_id, v_id + 1000000 AS ref_id FROM v")
def vertex_correspondence(spark, sf_dir):
    v = fx.height_field(spark, sf_dir).vertices
    return spatial.find_vertex_correspondence(v, v.withColumn("v_id", F.col("v_id") + 1000000).withColumn("x", F.col("x") + 0.01), 0.1)


@query("get_indices", f"{FIELD} SELECT v_id + 7 AS v_id, v_id AS ref_id FROM v WHERE label > 10")
def get_indices(spark, sf_dir):
    v = fx.height_field(spark, sf_dir).vertices
    return spatial.get_indices(v, v.where("label > 10").withColumn("v_id", F.col("v_id") + 7))


@query("find_roi_index", f"{MATRIX} SELECT col, roi FROM (SELECT pos AS col, i AS roi, row_number() OVER (PARTITION BY pos ORDER BY value DESC, i) AS k FROM m) WHERE k = 1")
def find_roi_index(spark, sf_dir):
    return spatial.find_roi_index(fx.matrix(spark, sf_dir).select(F.col("pos").cast("bigint").alias("col"), F.col("i").alias("roi"), F.col("value").alias("cc")))


# graphs


@query("connected_components", f"{_HOLED.replace('v_id >= 80', 'v_id >= 80 AND gj <> h // 2')}, c AS (SELECT v_id, v_id AS l FROM nb), walk(v_id, l) AS (SELECT DISTINCT v_id, v_id FROM nb WHERE v_id IN (80, (SELECT (h // 2 + 1) * 40 FROM n)) UNION SELECT nb.neighbor, l FROM walk JOIN nb USING (v_id)) SELECT v_id, min(l) AS component FROM walk GROUP BY v_id")
def connected_components(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    height = mesh.vertices.count() // fx.WIDTH
    faces = mesh.faces.where("a >= 80").where(F.expr("a div 40") != height // 2)  # two pieces
    return type(mesh)(mesh.vertices, faces).connected_components()


@query("shortest_path_hops", f"{GRAPH}, walk(v_id, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT neighbor, d + 1 FROM walk JOIN nb USING (v_id) WHERE d < 12) SELECT v_id, CAST(min(d) AS DOUBLE) AS distance FROM walk GROUP BY v_id")
def shortest_path_hops(spark, sf_dir):
    return graphs.shortest_path_length(fx.similarity(spark, sf_dir), 0)


@query(
    "clustering_coefficient",
    f"""{GRAPH}, deg AS (SELECT v_id, count(*) AS d FROM nb GROUP BY v_id), tri AS (SELECT p.v_id, count(*) / 2 AS t FROM nb p JOIN nb q ON p.v_id = q.v_id AND p.neighbor <> q.neighbor JOIN nb s ON s.v_id = p.neighbor AND s.neighbor = q.neighbor GROUP BY p.v_id)
SELECT {R("avg(CASE WHEN d > 1 THEN coalesce(t, 0) * 2e0 / (d * (d - 1)) ELSE 0 END)")} AS clustering FROM deg LEFT JOIN tri USING (v_id)""",
)
def clustering_coefficient(spark, sf_dir):
    return rounded(graphs.clustering_coefficient(fx.similarity(spark, sf_dir)), "clustering")


@query("rich_club_k", f"{GRAPH}, rich AS (SELECT v_id FROM nb GROUP BY v_id HAVING count(*) > 12) SELECT {R('2e0 * (SELECT count(*) FROM e WHERE i IN (SELECT v_id FROM rich) AND j IN (SELECT v_id FROM rich)) / (count(*) * (count(*) - 1))')} AS phi FROM rich")
def rich_club_k(spark, sf_dir):
    return rounded(graphs.rich_club(fx.similarity(spark, sf_dir), 12), "phi")


@query(
    "smooth_n",
    f"""{FIELD}, k AS (SELECT nb.v_id, neighbor, area AS s FROM nb JOIN area ON area.v_id = neighbor UNION ALL SELECT v_id, v_id, area FROM area),
one AS (SELECT k.v_id, sum(s * w) / sum(s) AS value FROM k JOIN v ON v.v_id = neighbor GROUP BY k.v_id), two AS (SELECT k.v_id, sum(s * value) / sum(s) AS value FROM k JOIN one ON one.v_id = neighbor GROUP BY k.v_id) SELECT v_id, {R("value / 1000")} AS value FROM two""",
)
def smooth_n(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    smoothed = mesh.smooth(mesh.vertices.select("v_id", F.col("w").alias("value")), 2)
    return rounded(smoothed.withColumn("value", F.col("value") / 1000), "value")


@query("orient", f"{TORUS} SELECT count(*) AS n_faces, TRUE AS is_oriented, {R('(SELECT abs(sum(ax * nx + ay * ny + az * nz) / 6) FROM g3)')} AS volume FROM f")
def orient(spark, sf_dir):
    mesh = fx.torus(spark, sf_dir)
    turn = F.col("f_id") % 3 == 0  # a third of the faces turned over
    mixed = type(mesh)(mesh.vertices, mesh.faces.select("f_id", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), "c"))
    out = mixed.orient()
    return rounded(out.faces.agg(F.count("*").alias("n_faces")).crossJoin(out.is_oriented()).crossJoin(out.volume()), "volume")


@query("rewired_degrees", f"{GRAPH} SELECT v_id, count(*) AS degree FROM nb GROUP BY v_id")
def rewired_degrees(spark, sf_dir):
    """Degrees after ten rounds of edge swaps."""
    swapped = graphs.rewire(fx.similarity(spark, sf_dir), 10, 1)
    return graphs.both_ways(swapped).groupBy(F.col("src").alias("v_id")).agg(F.count("*").alias("degree"))


@query("modularity")
def modularity(spark, sf_dir):
    return rounded(graphs.modularity(fx.similarity(spark, sf_dir), "w"), "modularity")


# matrices


def _weights(spark, sf_dir):
    return fx.similarity(spark, sf_dir)


@query("dominant_set_k", f"{GRAPH} SELECT i, j, {R('w')} AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM e) WHERE r <= 3")
def dominant_set_k(spark, sf_dir):
    return rounded(matrices.dominant_set(_weights(spark, sf_dir), 3), "w")


@query("dominant_set_threshold", f"{GRAPH} SELECT i, j, {R('w / sum(w) OVER (PARTITION BY i)')} AS w FROM e WHERE w > 0.25")
def dominant_set_threshold(spark, sf_dir):
    return rounded(matrices.dominant_set(_weights(spark, sf_dir), 0.25, is_threshold=True, norm=True), "w")


@query("make_symmetric", f"{GRAPH} SELECT i, j, {R('sum(w) / 2')} AS w FROM (SELECT i, j, w FROM top UNION ALL SELECT j, i, w FROM top) GROUP BY i, j")
def make_symmetric(spark, sf_dir):
    return rounded(matrices.make_symmetric(fx.nearest(spark, sf_dir)), "w")


@query("is_symmetric", f"{GRAPH} SELECT FALSE AS is_symmetric")
def is_symmetric(spark, sf_dir):
    return matrices.is_symmetric(_weights(spark, sf_dir))


@query("ravel_upper", f"{GRAPH}, n AS (SELECT count(*) AS n FROM embeddings), cell AS (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (ORDER BY a.vec_id, b.vec_id) - 1 AS pos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT pos, {R('w')} AS w FROM e JOIN cell USING (i, j)")
def ravel_upper(spark, sf_dir):
    n = fx.table(spark, sf_dir, "embeddings").count()
    return rounded(matrices.ravel_symmetric(_weights(spark, sf_dir), n), "w")


@query("unravel_both", f"{GRAPH} SELECT i, j, {R('w')} AS w FROM e UNION ALL SELECT j, i, {R('w')} FROM e")
def unravel_both(spark, sf_dir):
    n = fx.table(spark, sf_dir, "embeddings").count()
    return rounded(matrices.unravel_symmetric(matrices.ravel_symmetric(_weights(spark, sf_dir), n), n), "w")


# statistics


@query("zscore_columns", f"{MATRIX} SELECT i, pos, {R('(value - avg(value) OVER (PARTITION BY pos)) / nullif(stddev_pop(value) OVER (PARTITION BY pos), 0)')} AS z FROM m")
def zscore_columns(spark, sf_dir):
    return rounded(statistics.normalize_data(fx.matrix(spark, sf_dir), "value", "pos").select("i", F.col("pos").cast("bigint").alias("pos"), "z"), "z")


@query("max_abs_normalize", f"{MATRIX} SELECT i, pos, {R('value / nullif(max(abs(value)) OVER (PARTITION BY i), 0)')} AS u FROM m")
def max_abs_normalize(spark, sf_dir):
    return rounded(statistics.max_abs_normalize(fx.matrix(spark, sf_dir), "value", "i").select("i", F.col("pos").cast("bigint").alias("pos"), "u"), "u")


def _rows(spark, sf_dir):
    return fx.matrix(spark, sf_dir).where("label = 3").select("i", "pos", "value")


@query("pearson_pairwise", f"{MATRIX} SELECT a.i, b.i AS j, {R(_PEARSON.format('a.value', 'b.value'))} AS r FROM m a JOIN m b USING (pos) WHERE a.label = 3 AND b.label = 3 AND a.i < b.i GROUP BY a.i, b.i")
def pearson_pairwise(spark, sf_dir):
    return rounded(statistics.pairwise_r(_rows(spark, sf_dir)), "r")


@query("pearson_cross", f"{MATRIX} SELECT a.i, b.i AS j, {R(_PEARSON.format('a.value', 'b.value'))} AS r FROM m a JOIN m b USING (pos) WHERE a.label = 3 AND b.label = 4 GROUP BY a.i, b.i")
def pearson_cross(spark, sf_dir):
    return rounded(statistics.pearsonr(_rows(spark, sf_dir), fx.matrix(spark, sf_dir).where("label = 4")), "r")


@query("spearman_pairwise", f"{MATRIX}, k AS (SELECT i, pos, rank() OVER (PARTITION BY i ORDER BY value) + (count(*) OVER (PARTITION BY i, value) - 1) / 2e0 AS v FROM m WHERE label = 3) SELECT a.i, b.i AS j, {R(_PEARSON.format('a.v', 'b.v'))} AS r FROM k a JOIN k b USING (pos) WHERE a.i < b.i GROUP BY a.i, b.i")
def spearman_pairwise(spark, sf_dir):
    return rounded(statistics.spearman_pairwise(_rows(spark, sf_dir)), "r")


def _all_rows(spark, sf_dir):
    return fx.matrix(spark, sf_dir).select("i", "pos", "value")


@query("pearson_pairwise_all", f"{MATRIX} SELECT a.i, b.i AS j, {R(_PEARSON.format('a.value', 'b.value'))} AS r FROM m a JOIN m b USING (pos) WHERE a.i < b.i GROUP BY a.i, b.i")
def pearson_pairwise_all(spark, sf_dir):
    return rounded(statistics.pairwise_r(_all_rows(spark, sf_dir)), "r")


@query("pearson_cross_all", f"{MATRIX} SELECT a.i, b.i AS j, {R(_PEARSON.format('a.value', 'b.value'))} AS r FROM m a JOIN m b USING (pos) WHERE a.i % 2 = 0 AND b.i % 2 <> 0 GROUP BY a.i, b.i")
def pearson_cross_all(spark, sf_dir):
    rows = _all_rows(spark, sf_dir)  # two halves that cover the table
    return rounded(statistics.pearsonr(rows.where("i % 2 = 0"), rows.where("i % 2 <> 0")), "r")


@query("spearman_pairwise_all", f"{MATRIX}, k AS (SELECT i, pos, rank() OVER (PARTITION BY i ORDER BY value) + (count(*) OVER (PARTITION BY i, value) - 1) / 2e0 AS v FROM m) SELECT a.i, b.i AS j, {R(_PEARSON.format('a.v', 'b.v'))} AS r FROM k a JOIN k b USING (pos) WHERE a.i < b.i GROUP BY a.i, b.i")
def spearman_pairwise_all(spark, sf_dir):
    return rounded(statistics.spearman_pairwise(_all_rows(spark, sf_dir)), "r")


def _pair(spark, sf_dir):
    maps = fx.subject_maps(spark, sf_dir)
    return maps.groupBy("v_id").agg(F.avg(F.when(F.col("grp") == "HC", F.col("value"))).alias("x"), F.avg(F.when(F.col("grp") == "P", F.col("value"))).alias("y"))


@query("compare_images", f"{MAPS} SELECT {R(_PEARSON.format('x', 'y'))} AS r, count(*) AS n FROM pair WHERE abs(x) > 1e-8 AND abs(y) > 1e-8")
def compare_images(spark, sf_dir):
    p = _pair(spark, sf_dir)
    return rounded(statistics.compare_images(p.select("v_id", F.col("x").alias("value")), p.select("v_id", F.col("y").alias("value"))), "r")


@query("compare_images_spearman", f"{MAPS}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS y FROM pair WHERE abs(x) > 1e-8 AND abs(y) > 1e-8) SELECT {R(_PEARSON.format('x', 'y'))} AS r, count(*) AS n FROM k")
def compare_images_spearman(spark, sf_dir):
    p = _pair(spark, sf_dir)
    return rounded(statistics.compare_images(p.select("v_id", F.col("x").alias("value")), p.select("v_id", F.col("y").alias("value")), metric="spearmanr"), "r")


_PERM = "perm AS (SELECT unnest(range(1, {0})) AS perm), place AS (SELECT perm, v_id, row_number() OVER (PARTITION BY perm ORDER BY md5('{1}-' || perm || '-' || v_id), v_id) - 1 AS place FROM pair, perm)"


@query(
    "permtest_metric",
    f"""{MAPS}, {_PERM.format(101, 7)}, pos AS (SELECT row_number() OVER (ORDER BY v_id) - 1 AS place, x FROM pair),
nulls AS (SELECT perm, {_PEARSON.format("x", "y")} AS n FROM place JOIN pos USING (place) JOIN (SELECT v_id, y FROM pair) USING (v_id) GROUP BY perm),
true_ AS (SELECT {_PEARSON.format("x", "y")} AS r FROM pair) SELECT {R("r")} AS r, {R("(1 + count(*) FILTER (abs(n) >= abs(r))) / 101e0")} AS p FROM nulls, true_ GROUP BY r""",
)
def permtest_metric(spark, sf_dir):
    return rounded(statistics.permtest_metric(_pair(spark, sf_dir), 100, 7), "r", "p")


@query("nonparp", f"{MAPS} SELECT v_id, {R('avg(CASE WHEN abs(value) > abs(x) THEN 1e0 ELSE 0e0 END)')} AS p FROM maps JOIN pair USING (v_id) WHERE grp = 'P' GROUP BY v_id")
def nonparp(spark, sf_dir):
    return rounded(statistics.nonparp(_pair(spark, sf_dir).select("v_id", F.col("x").alias("stat")), fx.subject_maps(spark, sf_dir).where("grp = 'P'")), "p")


@query("zscore_vs_nulls", f"{MAPS} SELECT v_id, {R('(x - avg(value)) / nullif(stddev_pop(value), 0)')} AS z FROM maps JOIN pair USING (v_id) WHERE grp = 'P' GROUP BY v_id, x")
def zscore_vs_nulls(spark, sf_dir):
    return rounded(statistics.zscore_vs_nulls(_pair(spark, sf_dir).select("v_id", F.col("x").alias("stat")), fx.subject_maps(spark, sf_dir).where("grp = 'P'")), "z")


@query(
    "perm_group_zmap",
    f"""{MAPS}, sub AS (SELECT DISTINCT subject, grp FROM maps), nf AS (SELECT count(*) AS nf FROM sub WHERE grp = 'HC'), perm AS (SELECT unnest(range(1, 21)) AS perm),
dealt AS (SELECT perm, subject, row_number() OVER (PARTITION BY perm ORDER BY md5('20-' || perm || '-' || subject), subject) - 1 < nf AS first FROM sub, perm, nf),
nulls AS (SELECT perm, v_id, avg(CASE WHEN first THEN value END) - avg(CASE WHEN NOT first THEN value END) AS n FROM maps JOIN dealt USING (subject) GROUP BY perm, v_id)
SELECT v_id, {R("x - y")} AS diff, {R("((x - y) - avg(n)) / nullif(stddev_pop(n), 0)")} AS z, {R("avg(CASE WHEN abs(n) >= abs(x - y) THEN 1e0 ELSE 0e0 END)")} AS p FROM nulls JOIN pair USING (v_id) GROUP BY v_id, x, y""",
)
def perm_group_zmap(spark, sf_dir):
    return rounded(statistics.perm_group_zmap(fx.subject_maps(spark, sf_dir), "HC", 20, 20), "diff", "z", "p")


@query("correlation_p_values")
def correlation_p_values(spark, sf_dir):
    m = fx.matrix(spark, sf_dir)
    a = m.where("label = 3").select(F.col("pos").alias("col"), F.expr("i div 10").alias("row"), "value").groupBy("col", "row").agg(F.avg("value").alias("value"))
    b = m.where("label = 4").select(F.col("pos").alias("col"), F.expr("i div 10").alias("row"), "value").groupBy("col", "row").agg(F.avg("value").alias("value"))
    return rounded(statistics.efficient_pearsonr(a, b, ["col"], ["row"]), "r", "p")


_EC = "(4 * ln(2) * (2 * pi()) ^ (-1.5))"


@query("euler_threshold", f"SELECT {R('z')} AS z, {R('ec')} AS ec FROM (SELECT *, row_number() OVER (ORDER BY z) AS k FROM (SELECT z, 100e0 * {_EC} * z * exp(-z * z / 2) AS ec FROM (SELECT i * (50e0 / 9999) AS z FROM range(10000) t(i))) WHERE ec <= 0.05) WHERE k = 2")
def euler_threshold(spark, sf_dir):
    return rounded(statistics.euler_threshold(100.0, 0.05)(spark), "z", "ec")


@query("expected_ec", f"{FIELD} SELECT v_id, {R(f'10e0 * {_EC} * (z / 10) * exp(-(z / 10) * (z / 10) / 2)')} AS ec FROM v")
def expected_ec(spark, sf_dir):
    return fx.height_field(spark, sf_dir).vertices.select("v_id", r(scalars.expected_ec(F.col("z") / 10, F.lit(10.0))).alias("ec"))


# volumes


def _roi(spark, sf_dir):
    vol = fx.volume(spark, sf_dir)
    return vol.crossJoin(vol.agg(F.avg("value").alias("m"))).where("value >= m").select("vx", "vy", "vz")


@query("roi_volume", f"{VOLUME} SELECT count(*) AS n_voxels, count(*) * 3e0 AS volume FROM roi")
def roi_volume(spark, sf_dir):
    return volumes.calc_volume(_roi(spark, sf_dir).withColumn("value", F.lit(1)), (1.0, 1.5, 2.0))


@query("boundary_voxels", f"{VOLUME}, {_OFFSETS} SELECT p.vx, p.vy, p.vz, count(q.vx) AS n_inside FROM roi p CROSS JOIN o LEFT JOIN roi q ON q.vx = p.vx + ox AND q.vy = p.vy + oy AND q.vz = p.vz + oz GROUP BY ALL HAVING count(q.vx) < 26")
def boundary_voxels(spark, sf_dir):
    return volumes.boundary_voxels(_roi(spark, sf_dir))


@query("dilate", f"{VOLUME}, {_OFFSETS} SELECT vx, vy, vz FROM roi UNION SELECT vx + ox, vy + oy, vz + oz FROM roi, o")
def dilate(spark, sf_dir):
    return volumes.dilate(_roi(spark, sf_dir))


@query("affine_ras", f"{VOLUME} SELECT vx, vy, vz, -1e0 * vx + 5 AS x, vz * 1e0 - 3.5 AS y, -1e0 * vy + 5 AS z FROM vol")
def affine_ras(spark, sf_dir):
    return volumes.affine_ras(fx.volume(spark, sf_dir).drop("value"), scalars.tkr_vox2ras((10, 10, 7)))


@query(
    "smooth_volume",
    f"""{VOLUME}, k AS (SELECT o, exp(-(o * o) / (2 * s * s)) / sum(exp(-(o * o) / (2 * s * s))) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS o, 1.2e0 / sqrt(8 * ln(2)) AS s)),
x AS (SELECT vx + o AS vx, vy, vz, sum(value * w) AS value FROM vol, k WHERE vx + o BETWEEN 0 AND 9 GROUP BY ALL), y AS (SELECT vx, vy + o AS vy, vz, sum(value * w) AS value FROM x, k WHERE vy + o BETWEEN 0 AND 9 GROUP BY ALL),
z AS (SELECT vx, vy, vz + o AS vz, sum(value * w) AS value FROM y, k WHERE vz + o BETWEEN 0 AND 7 GROUP BY ALL) SELECT vx, vy, vz, {R("value")} AS value FROM z""",
)
def smooth_volume(spark, sf_dir):
    return rounded(volumes.smooth(fx.volume(spark, sf_dir), 1.2, (10, 10, 8)), "value")


@query("grid_to_points", f"{FIELD}, p AS (SELECT v_id, x + 0.25 AS x, y + 0.5 AS y FROM v), c AS (SELECT v_id, gx, gy, w FROM (SELECT v_id, floor(x) AS x0, floor(y) AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM p), (SELECT 0 AS a UNION ALL SELECT 1) s, (SELECT 0 AS b UNION ALL SELECT 1) t, LATERAL (SELECT x0 + a AS gx, y0 + b AS gy, (CASE a WHEN 1 THEN fx ELSE 1 - fx END) * (CASE b WHEN 1 THEN fy ELSE 1 - fy END) AS w)) SELECT c.v_id, {R('CASE WHEN count(v.z) = count(*) THEN sum(c.w * v.z) END')} AS value FROM c LEFT JOIN v ON v.x = gx AND v.y = gy GROUP BY c.v_id")
def grid_to_points(spark, sf_dir):
    v = fx.height_field(spark, sf_dir).vertices
    grid = v.select(F.col("x").cast("bigint").alias("gx"), F.col("y").cast("bigint").alias("gy"), F.col("z").alias("value"))
    return rounded(volumes.grid_to_points(grid, v.select("v_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"))), "value")


# spectral


@query("fem_stiffness", f"{TORUS}, cot AS (SELECT b AS p, c AS q, ((bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay) + (bz - az) * (cz - az)) / nn / 2 AS h FROM g3 UNION ALL SELECT c, a, ((cx - bx) * (ax - bx) + (cy - by_) * (ay - by_) + (cz - bz) * (az - bz)) / nn / 2 FROM g3 UNION ALL SELECT a, b, ((ax - cx) * (bx - cx) + (ay - cy) * (by_ - cy) + (az - cz) * (bz - cz)) / nn / 2 FROM g3) SELECT i, j, {R('sum(w)')} AS w FROM (SELECT p AS i, q AS j, -h AS w FROM cot UNION ALL SELECT q, p, -h FROM cot UNION ALL SELECT p, p, h FROM cot UNION ALL SELECT q, q, h FROM cot) GROUP BY i, j")
def fem_stiffness(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).fem_stiffness(), "w")


@query("fem_mass_lumped", f"{TORUS} SELECT v_id AS i, v_id AS j, {R('area')} AS w FROM area")
def fem_mass_lumped(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).fem_mass(), "w")


@query("fem_mass_consistent", f"{TORUS}, t AS (SELECT unnest([a, b, c]) AS i, [a, b, c] AS l, nn / 2 AS s FROM g3) SELECT i, j, {R('sum(CASE WHEN i = j THEN s / 6 ELSE s / 12 END)')} AS w FROM (SELECT i, unnest(l) AS j, s FROM t) GROUP BY i, j")
def fem_mass_consistent(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).fem_mass(lump=False), "w")


@query("eigenmodes")
def eigenmodes(spark, sf_dir):
    modes = fx.torus(spark, sf_dir, 1e-5).eigenmodes(20)
    return rounded(modes.groupBy("k", "lambda").agg(F.count("*").alias("n_vertices")), "lambda")


@query("eigenmode_residuals", "SELECT CAST(k AS BIGINT) AS k, 0e0 AS residual, 1e0 AS mass FROM range(20) t(k)")
def eigenmode_residuals(spark, sf_dir):
    """|K x - lambda M x| and x'Mx of the modes: zero and one."""
    mesh = fx.torus(spark, sf_dir, 1e-5)
    return rounded(spectral.residuals(mesh, mesh.eigenmodes(20)).select("k", "residual", "mass"), "residual", "mass").withColumn("residual", r("residual", 4))


@query("heat_balance", "SELECT p_partkey AS source, 1e0 AS heat, (SELECT count(*) FROM part) AS n FROM part WHERE p_partkey % 100 = 0")
def heat_balance(spark, sf_dir):
    """Heat weighted by the mass stays what the source had."""
    mesh = fx.torus(spark, sf_dir, 1e-5)
    heat = mesh.heat_diffusion(mesh.vertices.where("v_id % 100 = 0").select("v_id"))
    mass = mesh.fem_mass().select(F.col("i").alias("v_id"), "w")
    return rounded(heat.join(mass, "v_id").groupBy("source").agg(F.sum(F.col("value") * F.col("w")).alias("heat"), F.count("*").alias("n")), "heat")


@query("heat_diffusion")
def heat_diffusion(spark, sf_dir):
    mesh = fx.torus(spark, sf_dir, 1e-5)
    return rounded(mesh.heat_diffusion(mesh.vertices.where("v_id < 3").select("v_id")), "value")


@query("geodesic_heat")
def geodesic_heat(spark, sf_dir):
    mesh = fx.torus(spark, sf_dir, 1e-5)
    return rounded(mesh.geodesic_distance(mesh.vertices.where("v_id < 3").select("v_id")), "value")


@query("geodesic_knn")
def geodesic_knn(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir, 1e-5).geodesic_knn(5, 25), "distance")


@query("curvature")
def curvature(spark, sf_dir):
    return rounded(fx.torus(spark, sf_dir).curvature(1).select("v_id", "k_min", "k_max", "k_mean", "k_gauss"), "k_min", "k_max", "k_mean", "k_gauss")


@query("laplacian_eigenmaps")
def laplacian_eigenmaps(spark, sf_dir):
    out = spectral.laplacian_eigenmaps(fx.similarity(spark, sf_dir), 5)
    return rounded(out.groupBy("k", "lambda").agg(F.count("*").alias("n")), "lambda")


def _modes(spark, sf_dir, n: int = 8):
    return fx.matrix(spark, sf_dir).where(F.col("pos") < n).select(F.col("i").alias("v_id"), F.col("pos").cast("bigint").alias("k"), F.col("value").alias("psi"))


_MODES = f"{MATRIX}, md AS (SELECT i AS v_id, pos AS k, value AS psi FROM m WHERE pos < 8)"


@query("gram", f"{_MODES} SELECT a.k, b.k AS l, {R('sum(a.psi * b.psi)')} AS g FROM md a JOIN md b USING (v_id) GROUP BY a.k, b.k")
def gram(spark, sf_dir):
    return rounded(spectral.gram(_modes(spark, sf_dir)), "g")


@query("eigen_decomposition")
def eigen_decomposition(spark, sf_dir):
    data = fx.matrix(spark, sf_dir).where("pos = 20").select(F.col("i").alias("v_id"), "value")
    return rounded(spectral.eigen_decomposition(data, _modes(spark, sf_dir)), "beta")


@query("reconstruct_pv", f"{_MODES} SELECT v_id, {R('sum((k + 1) * 0.5e0 * psi)')} AS value FROM md WHERE k < 5 GROUP BY v_id")
def reconstruct_pv(spark, sf_dir):
    betas = spark.range(8).select(F.col("id").alias("k"), ((F.col("id") + 1) * 0.5).alias("beta"))
    return rounded(spectral.reconstruct_data(betas, _modes(spark, sf_dir), 5), "value")


@query("incremental_recon", f"{_MODES}, t AS (SELECT v_id, k + 1 AS n, sum((k + 1) * 0.5e0 * psi) OVER (PARTITION BY v_id ORDER BY k) AS recon FROM md) SELECT n, {R(_PEARSON.format('recon', 'm.value'))} AS r FROM t JOIN m ON m.i = v_id AND m.pos = 20 GROUP BY n")
def incremental_recon(spark, sf_dir):
    betas = spark.range(8).select(F.col("id").alias("k"), ((F.col("id") + 1) * 0.5).alias("beta"))
    data = fx.matrix(spark, sf_dir).where("pos = 20").select(F.col("i").alias("v_id"), "value")
    return rounded(spectral.incremental_recon(data, betas, _modes(spark, sf_dir)), "r")


@query("eigengroups", "SELECT p_partkey AS k, CAST(floor(sqrt(p_partkey)) AS BIGINT) AS \"group\" FROM part")
def eigengroups(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("group", scalars.eigengroup(F.col("k")))


@query("spheroid_roundtrip", f"{_MODES} SELECT v_id, k, {R('psi / sqrt(k + 1)')} AS sphere, {R('psi')} AS back FROM md")
def spheroid_roundtrip(spark, sf_dir):
    modes = _modes(spark, sf_dir).withColumn("lambda", F.col("k") + 1.0)
    sphere = spectral.to_spheroid(modes)
    back = spectral.to_ellipsoid(sphere).select("v_id", "k", F.col("psi").alias("back"))
    return rounded(sphere.select("v_id", "k", F.col("psi").alias("sphere")).join(back, ["v_id", "k"]), "sphere", "back")


@query("resample_spheroid", f"{_MODES} SELECT v_id, k, {R('CASE WHEN k >= 1 THEN psi * cos(0.5e0) ELSE psi END')} AS psi FROM md")
def resample_spheroid(spark, sf_dir):
    return rounded(spectral.resample_spheroid(_modes(spark, sf_dir), 0.5), "psi")


# composites


@query("face_values", f"{FIELD} SELECT f_id, {R('sum(w) / 3')} AS value FROM fv JOIN v USING (v_id) GROUP BY f_id")
def face_values(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    return rounded(composites.face_values(mesh, mesh.vertices.select("v_id", F.col("w").alias("value"))), "value")


@query("edge_weights", f"{FIELD}, t AS (SELECT f_id, sum(w) / 3 AS value FROM fv JOIN v USING (v_id) GROUP BY f_id), s AS (SELECT src, dst, sum(value) AS w FROM he JOIN t USING (f_id) GROUP BY src, dst) SELECT least(src, dst) AS i, greatest(src, dst) AS j, {R('max(w)')} AS w FROM s GROUP BY 1, 2")
def edge_weights(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    return rounded(composites.edge_weights(mesh, composites.face_values(mesh, mesh.vertices.select("v_id", F.col("w").alias("value")))), "w")


@query("eta_squared", f"{MATRIX} SELECT a.i, b.i AS j, {R('1 - sum((a.value - b.value) ^ 2 / 2) / (sum(a.value ^ 2 + b.value ^ 2) - sum(a.value + b.value) ^ 2 / (2 * count(*)))')} AS w FROM m a JOIN m b USING (pos) WHERE a.label = 3 AND b.label = 3 AND a.i < b.i GROUP BY a.i, b.i")
def eta_squared(spark, sf_dir):
    return rounded(composites.eta_squared(_rows(spark, sf_dir)), "w")


@query("calc_gradients")
def calc_gradients(spark, sf_dir):
    return rounded(composites.calc_gradients(_rows(spark, sf_dir), 3), "value")


@query("cortical_projection", f"{MATRIX}, c AS (SELECT a.i, b.i AS j, {_PEARSON.format('a.value', 'b.value')} AS r FROM m a JOIN m b USING (pos) WHERE a.label = 3 AND b.label = 4 GROUP BY a.i, b.i), k AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY r DESC, i) AS q FROM c) SELECT k.j AS i, {R('value')} AS value FROM k JOIN m ON m.i = k.i AND pos = 0 WHERE q = 1")
def cortical_projection(spark, sf_dir):
    gradient = fx.matrix(spark, sf_dir).where("label = 3 AND pos = 0")
    return rounded(composites.cortical_projection(_rows(spark, sf_dir), fx.matrix(spark, sf_dir).where("label = 4"), gradient), "value")


@query("masked_eigenmodes")
def masked_eigenmodes(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    mask = mesh.vertices.select("v_id", (F.col("y") > 0).cast("int").alias("keep"))
    modes = composites.surface_eigenmodes(mesh, mask, 6)
    return rounded(modes.groupBy("k", "lambda").agg(F.count("*").alias("n_vertices"), F.count_if(F.col("psi") == 0).alias("n_zero")), "lambda")


@query("rft_threshold", f"""{FIELD}, z AS (SELECT z AS cut FROM (SELECT *, row_number() OVER (ORDER BY z) AS k FROM (SELECT z, (SELECT sum(nn) / 2 FROM g3) / 36 * {_EC} * z * exp(-z * z / 2) AS ec FROM (SELECT i * (50e0 / 9999) AS z FROM range(10000) t(i))) WHERE ec <= 0.05) WHERE k = 2)
SELECT v_id, {R("CASE WHEN v.z >= cut THEN v.z ELSE 0 END")} AS value FROM v, z""")
def rft_threshold(spark, sf_dir):
    mesh = fx.height_field(spark, sf_dir)
    return rounded(composites.rft_threshold(mesh, mesh.vertices.select("v_id", F.col("z").alias("value")), 6.0), "value")


_SUBJECTS = MAPS + ", md AS (SELECT subject % 5 AS subject, subject % 3 AS k, v_id, avg(value) AS psi FROM maps GROUP BY ALL)"


def _subject_modes(spark, sf_dir):
    return fx.subject_maps(spark, sf_dir).groupBy((F.col("subject") % 5).alias("subject"), (F.col("subject") % 3).alias("k"), "v_id").agg(F.avg("value").alias("psi"))


@query("mode_similarity", f"{_SUBJECTS}, c AS (SELECT a.k, a.subject, b.subject AS t, abs({_PEARSON.format('a.psi', 'b.psi')}) AS r FROM md a JOIN md b ON a.k = b.k AND a.v_id = b.v_id AND a.subject < b.subject GROUP BY ALL) SELECT k, {R('avg(r)')} AS mean, {R('avg(r) - 1.96e0 * stddev_pop(r) / sqrt(count(r))')} AS low, {R('avg(r) + 1.96e0 * stddev_pop(r) / sqrt(count(r))')} AS high FROM c GROUP BY k")
def mode_similarity(spark, sf_dir):
    return rounded(composites.mode_similarity(_subject_modes(spark, sf_dir)), "mean", "low", "high")


@query("betas_and_accuracy", f"{_SUBJECTS}, d AS (SELECT user_id % 7 AS subject, v_id, avg(value) AS value FROM (SELECT *, CAST(hour(ts) AS INTEGER) AS v_id FROM events) GROUP BY ALL), p AS (SELECT k, v_id, psi FROM md WHERE subject = 1), b AS (SELECT d.subject, k, sum(psi * value) AS beta FROM d JOIN p USING (v_id) GROUP BY ALL), q AS (SELECT b.subject, v_id, sum(beta * psi) AS recon FROM b JOIN p USING (k) GROUP BY ALL) SELECT subject, {R(_PEARSON.format('recon', 'value'))} AS r FROM q JOIN d USING (subject, v_id) GROUP BY subject")
def betas_and_accuracy(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    data = events.groupBy((F.col("user_id") % 7).alias("subject"), F.hour("ts").alias("v_id")).agg(F.avg("value").alias("value"))
    modes = _subject_modes(spark, sf_dir).where("subject = 1").select("k", "v_id", "psi")
    return rounded(composites.betas_and_accuracy(data, modes), "r")


@query("variogram", f"{FIELD}, p AS (SELECT sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2 + (p.z - q.z) ^ 2) AS d, (p.w - q.w) ^ 2 / 2 AS g FROM v p JOIN v q ON p.v_id < q.v_id) SELECT CAST(least(floor(d * 3 / 1.7), 2) AS BIGINT) AS bin, count(*) AS n, {R('avg(g)')} AS gamma FROM p WHERE d <= 1.7 GROUP BY 1")
def variogram(spark, sf_dir):
    v = fx.height_field(spark, sf_dir).vertices
    out = statistics.variogram(v, v.select("v_id", F.col("w").alias("value")), 3, 1.7)
    return rounded(out.select(F.col("bin").cast("bigint").alias("bin"), "n", "gamma"), "gamma")


# scalars


@query("cartesian_to_spherical", f"{TORUS} SELECT v_id, {R('sqrt(x * x + y * y + z * z)')} AS r, {R('CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END', 5)} AS theta, {R('acos(z / sqrt(x * x + y * y + z * z))')} AS phi FROM v")
def cartesian_to_spherical(spark, sf_dir):
    v = fx.torus(spark, sf_dir).vertices.select("v_id", scalars.cartesian_to_spherical(F.col("x"), F.col("y"), F.col("z")).alias("s"))
    return v.select("v_id", r("s.r").alias("r"), r("s.theta", 5).alias("theta"), r("s.phi").alias("phi"))


@query("pack_rgb", "SELECT p_partkey, (p_size % 256) + ((p_partkey % 256) << 8) + ((p_partkey // 7 % 256) << 16) AS packed FROM part")
def pack_rgb(spark, sf_dir):
    k = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select(k, scalars.pack_rgb((F.col("p_size") % 256).cast("bigint"), k % 256, F.expr("p_partkey div 7 % 256")).alias("packed"))


@query("get_ext", "SELECT page_id, regexp_extract(url, '\\.([^./]+)$', 1) AS ext FROM pages")
def get_ext(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", scalars.get_ext(F.col("url")).alias("ext"))


@query("gaussian", f"{FIELD} SELECT v_id, {R('2e0 * exp(-((x - 10) ^ 2) / (2 * 3e0 * 3e0))')} AS g FROM v")
def gaussian(spark, sf_dir):
    return fx.height_field(spark, sf_dir).vertices.select("v_id", r(scalars.gaussian(F.col("x"), 2.0, 10.0, 3.0)).alias("g"))


@query("svd_reconstruction", f"{MATRIX} SELECT i, pos, {R('value')} AS value FROM m")
def svd_reconstruction(spark, sf_dir):
    """Scores times right vectors over all components give the matrix again."""
    data = fx.matrix(spark, sf_dir).select("i", "pos", "value")
    components, scores = statistics.svd(data)
    return rounded(scores.join(components, "k").groupBy("i", "pos").agg(F.sum(F.col("score") * F.col("v")).alias("value")), "value")


@query("map_round_trip", "SELECT p_partkey AS v_id, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS value FROM part")
def map_round_trip(spark, sf_dir):
    """Prices as a morphometry file, written and read by the data sources."""
    from tessellar.operators.iteration import folder
    from tessellar.sources import connectors, formats

    formats.register(spark)
    path = f"{folder(spark).rstrip('/')}/maps-{uuid.uuid4().hex}"
    connectors.write_maps(fx.table(spark, sf_dir, "part").select(F.lit("price.curv").alias("path"), F.col("p_partkey").alias("v_id"), F.col("p_retailprice").alias("value")), path)
    return spark.read.format("vertexmap").load(path).select("v_id", "value")


@query("surface_round_trip", f"{TORUS} SELECT f_id, a, b, c FROM f")
def surface_round_trip(spark, sf_dir):
    """The torus as a surface file, written and read by the data sources."""
    from tessellar.operators.iteration import folder
    from tessellar.sources import formats

    path = f"{folder(spark).rstrip('/')}/surfaces-{uuid.uuid4().hex}/torus.gii"
    formats.write_surface(fx.torus(spark, sf_dir), path)
    return spark.read.format("surface").load(path).where("part = 'f'").select(F.col("id").alias("f_id"), "a", "b", "c")


def _det(u: str, v: str, w: str) -> str:
    """Determinant of three edges, each a pair of the letters of its ends."""
    e = lambda p, k: f"({p[1]}.{k} - {p[0]}.{k})"
    return "(" + " + ".join(f"{e(u, i)} * ({e(v, j)} * {e(w, k)} - {e(v, k)} * {e(w, j)})" for i, j, k in ("xyz", "yzx", "zxy")) + ")"


_SIX = _det("ab", "ac", "ad")


def _probes(spark, sf_dir) -> DataFrame:
    """Points beside the vertices of the height field, about half of them inside the slab."""
    return fx.height_field(spark, sf_dir).vertices.select("v_id", (F.col("x") + 0.31).alias("x"), (F.col("y") + 0.17).alias("y"), (F.col("z") + 0.5).alias("z"))


@query(
    "locate_points",
    f"""{SLAB}, p AS (SELECT v_id, x + 0.31e0 AS x, y + 0.17e0 AS y, z + 0.5e0 AS z FROM v),
k AS (SELECT f_id, least(qa.x, qb.x, qc.x, qd.x) AS lx, greatest(qa.x, qb.x, qc.x, qd.x) AS hx, least(qa.y, qb.y, qc.y, qd.y) AS ly, greatest(qa.y, qb.y, qc.y, qd.y) AS hy, qa AS a, qb AS b, qc AS c, qd AS d FROM tet t JOIN v3 qa ON qa.v_id = t.a JOIN v3 qb ON qb.v_id = t.b JOIN v3 qc ON qc.v_id = t.c JOIN v3 qd ON qd.v_id = t.d),
w AS (SELECT p.v_id, f_id, {_det("ap", "ac", "ad")} / {_SIX} AS wb, {_det("ab", "ap", "ad")} / {_SIX} AS wc, {_det("ab", "ac", "ap")} / {_SIX} AS wd FROM p JOIN k ON p.x BETWEEN lx AND hx AND p.y BETWEEN ly AND hy)
SELECT v_id, f_id, {R("1 - wb - wc - wd")} AS wa, {R("wb")} AS wb, {R("wc")} AS wc, {R("wd")} AS wd FROM w WHERE least(1 - wb - wc - wd, wb, wc, wd) >= -1e-9 QUALIFY row_number() OVER (PARTITION BY v_id ORDER BY f_id) = 1""",
)
def locate_points(spark, sf_dir):
    return rounded(spatial.locate(_probes(spark, sf_dir), fx.slab(spark, sf_dir)), "wa", "wb", "wc", "wd")
