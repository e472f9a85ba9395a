"""Edges, incidence counts and topological predicates, all as aggregations over half-edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.mesh import Mesh


def half_edges(mesh: Mesh) -> DataFrame:
    """(f_id, src, dst): directed sides of triangles, or the six sides of tetrahedra."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a")] if mesh.polyshape == 3 else [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    return mesh.faces.select(F.inline(F.array(*[F.struct(F.col("f_id"), F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in pairs])))


def edges(mesh: Mesh) -> DataFrame:
    """Adjacency (i, j, n_faces) with i < j; n_faces is 2 inside, 1 on the boundary, more where not manifold."""
    return mesh.spread(_sides(mesh), "i", "j").groupBy("i", "j").agg(F.count("*").alias("n_faces"))


def _sides(mesh: Mesh) -> DataFrame:
    return half_edges(mesh).select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "src", "dst")


def half_edge_counts(mesh: Mesh) -> DataFrame:
    """(src, dst, n): how often each directed side occurs."""
    return half_edges(mesh).groupBy("src", "dst").agg(F.count("*").alias("n"))


def face_corners(mesh: Mesh) -> DataFrame:
    """(f_id, v_id)"""
    return mesh.faces.select("f_id", F.explode(F.array(*mesh.corners)).alias("v_id"))


def vertex_face_counts(mesh: Mesh) -> DataFrame:
    """(v_id, n_faces): incident faces."""
    return face_corners(mesh).groupBy("v_id").agg(F.count("*").alias("n_faces"))


def neighbor_pairs(mesh: Mesh) -> DataFrame:
    """(v_id, neighbor): both directions of each edge."""
    return edges(mesh).select(F.inline(F.array(F.struct(F.col("i").alias("v_id"), F.col("j").alias("neighbor")), F.struct(F.col("j").alias("v_id"), F.col("i").alias("neighbor")))))


def vertex_degrees(mesh: Mesh) -> DataFrame:
    """(v_id, degree): distinct neighbours."""
    return neighbor_pairs(mesh).groupBy("v_id").agg(F.count("*").alias("degree"))


def vertex_neighbors(mesh: Mesh, vertex: int) -> DataFrame:
    """Vertices that share a face with `vertex`."""
    touching = half_edges(mesh).where((F.col("src") == vertex) | (F.col("dst") == vertex))
    return touching.select(F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src")).alias("neighbor")).distinct()


def is_closed(mesh: Mesh) -> DataFrame:
    """One row: no edge belongs to exactly one face."""
    return edges(mesh).agg((F.count_if(F.col("n_faces") == 1) == 0).alias("is_closed"))


def is_manifold(mesh: Mesh) -> DataFrame:
    """One row: no edge belongs to more than two faces."""
    return edges(mesh).agg((F.coalesce(F.max("n_faces"), F.lit(0)) <= 2).alias("is_manifold"))


def is_oriented(mesh: Mesh) -> DataFrame:
    """One row. Triangles: every directed side occurs once. Tetrahedra: all signed volumes are positive or all are negative."""
    if mesh.polyshape == 3:
        return half_edge_counts(mesh).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("is_oriented"))
    from tessellar.operators.metrics import tet_volumes

    return tet_volumes(mesh).agg(((F.min("signed_volume") > 0) | (F.max("signed_volume") < 0)).alias("is_oriented"))


def euler(mesh: Mesh) -> DataFrame:
    """One row: used vertices - edges + faces."""
    used = face_corners(mesh).select(F.count_distinct("v_id").alias("v"))
    counts = edges(mesh).agg(F.count("*").alias("e"))
    return used.crossJoin(counts).crossJoin(mesh.faces.agg(F.count("*").alias("f"))).select((F.col("v") - F.col("e") + F.col("f")).alias("euler"))


def has_free_vertices(mesh: Mesh) -> DataFrame:
    """One row: does any vertex belong to no face?"""
    free = mesh.vertices.join(face_corners(mesh).select("v_id").distinct(), "v_id", "left_anti")
    return free.agg((F.count("*") > 0).alias("has_free_vertices"))


def violations(mesh: Mesh) -> DataFrame:
    """One row: dangling (corners that name no vertex), repeated (vertex ids beyond the first)."""
    dangling = face_corners(mesh).join(mesh.vertices.select("v_id"), "v_id", "left_anti").agg(F.count("*").alias("dangling"))
    return dangling.crossJoin(mesh.vertices.agg((F.count("*") - F.count_distinct("v_id")).alias("repeated")))


def dense_ids(frame: DataFrame, column: str) -> DataFrame:
    """(column, new_id): the distinct ids numbered from 0 in order.

    Ids are counted per range of `BLOCK` ids, the ranges' counts are added up
    (one row per range), and only then numbered inside each range, so no window
    spans the table.
    """
    from pyspark.sql import Window

    ids = frame.select(column).distinct().withColumn("_block", F.floor(F.col(column) / BLOCK))
    totals = ids.groupBy("_block").agg(F.count("*").alias("_n"))
    base = totals.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(column)) - 1
    return ids.withColumn("_at", inside).join(base, "_block").select(column, (F.col("_base") + F.col("_at")).cast("bigint").alias("new_id"))


#: ids per numbering window; the driver-free prefix sum has one row per this many ids
BLOCK = 1 << 16


def reindexed(mesh: Mesh) -> Mesh:
    """Vertex ids renumbered from 0, faces likewise; faces with a corner that is gone are dropped."""
    ids = dense_ids(mesh.vertices, "v_id")
    vertices = mesh.spread(mesh.vertices, "v_id").join(ids.hint("merge"), "v_id").withColumn("v_id", F.col("new_id")).drop("new_id")
    faces = mesh.faces
    for c in mesh.corners:
        # ids are small beside the limit of a broadcast, and too many for the driver
        faces = mesh.spread(faces, c).join(ids.select(F.col("v_id").alias(c), F.col("new_id").alias(f"_{c}")).hint("merge"), c)
    rest = [c for c in mesh.faces.columns if c not in mesh.corners]
    return Mesh(vertices, faces.select(*rest, *[F.col(f"_{c}").alias(c) for c in mesh.corners]), mesh.tasks)


def remove_free_vertices(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """(mesh of the used vertices, renumbered; ids that were dropped)."""
    used = face_corners(mesh).select("v_id").distinct()
    kept = Mesh(mesh.vertices.join(used, "v_id", "left_semi"), mesh.faces)
    return reindexed(kept), mesh.vertices.join(used, "v_id", "left_anti").select("v_id")


def boundary_edges(mesh: Mesh) -> DataFrame:
    """(src, dst): sides whose edge has one face, in that face's direction."""
    sides = mesh.spread(_sides(mesh), "i", "j").groupBy("i", "j").agg(F.count("*").alias("n"), F.min("src").alias("src"), F.min("dst").alias("dst"))
    return sides.where("n = 1").select("src", "dst")


def boundary_loops(mesh: Mesh, max_rounds: int = 40) -> DataFrame:
    """(v_id, loop): boundary vertices with the least id of their loop, by pointer jumping (simple loops, D25)."""
    from tessellar.operators.iteration import settle

    start = boundary_edges(mesh).select(F.col("src").alias("v_id"), F.col("dst").alias("next"), F.least("src", "dst").alias("loop"))

    def jump(state: DataFrame) -> DataFrame:
        ahead = state.select(F.col("v_id").alias("next"), F.col("next").alias("after"), F.col("loop").alias("there"))
        return state.join(ahead, "next").select("v_id", F.col("after").alias("next"), F.least("loop", "there").alias("loop"))

    return settle(start, jump, lambda s: s.agg(F.sum("loop")).first()[0], max_rounds).select("v_id", "loop")


def cell_types(faces: DataFrame, column: str = "cell") -> DataFrame:
    """One row over ragged cells: distinct sizes, and whether all are points, lines, triangles or quads."""
    n = F.size(column)
    return faces.agg(
        F.sort_array(F.collect_set(n)).alias("types"),
        F.count_distinct(n).alias("n_types"),
        (F.count_distinct(n) == 1).alias("unique_type"),
        *[F.every(n == k).alias(f"only_{name}") for k, name in ((1, "vertex"), (2, "line"), (3, "triangle"), (4, "quad"))],
    )


def edge_flags(mesh: Mesh) -> DataFrame:
    """One row for triangles, by one aggregation of their sides: n_edges, is_closed, is_manifold, is_oriented."""
    forward = F.col("src") < F.col("dst")
    sides = half_edges(mesh).groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"), F.count_if(forward).alias("f"))
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    return sides.agg(F.count("*").alias("n_edges"), (F.count_if(F.col("n") == 1) == 0).alias("is_closed"), (most("n") <= 2).alias("is_manifold"), (most(F.greatest(F.col("f"), F.col("n") - F.col("f"))) <= 1).alias("is_oriented"))


def topology_summary(mesh: Mesh) -> DataFrame:
    """One row: euler, is_closed, is_manifold, is_oriented."""
    if mesh.polyshape == 3:
        used = face_corners(mesh).select(F.count_distinct("v_id").alias("v"))
        both = used.crossJoin(mesh.faces.agg(F.count("*").alias("f"))).crossJoin(edge_flags(mesh))  # one row each
        return both.select((F.col("v") - F.col("n_edges") + F.col("f")).alias("euler"), "is_closed", "is_manifold", "is_oriented")
    out = euler(mesh)
    for part in (is_closed(mesh), is_manifold(mesh), is_oriented(mesh)):
        out = out.crossJoin(part)
    return out
