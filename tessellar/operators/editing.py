"""Masking, thresholding, combining, splitting, sorting, decimation and subdivision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.mesh import Mesh
from tessellar.operators import topology
from tessellar.operators.ordering import global_rank


def apply_mask(mesh: Mesh, mask: DataFrame) -> Mesh:
    """Keep vertices with mask 1 of (v_id, keep 0/1), drop faces that lose a corner, renumber."""
    bad = mask.where(~F.col("keep").cast("int").isin(0, 1) | F.col("keep").isNull())
    if not bad.isEmpty():
        raise ValueError("a mask holds only 0 and 1")
    kept = mesh.vertices.join(mask.where(F.col("keep").cast("int") == 1).select("v_id").hint("merge"), "v_id", "left_semi")
    return topology.reindexed(Mesh(kept, mesh.faces, mesh.tasks))


def map_to_mask(data: DataFrame, mask: DataFrame, fill: float = 0.0) -> DataFrame:
    """Scatter compact values (pos from 0, value) to the places with mask 1, `fill` elsewhere."""
    places = topology.dense_ids(mask.where(F.col("keep").cast("int") == 1), "v_id").withColumnRenamed("new_id", "pos")
    return mask.select("v_id").join(places.join(data, "pos").select("v_id", "value"), "v_id", "left").select("v_id", F.coalesce("value", F.lit(float(fill))).alias("value"))


def threshold_data(mesh: Mesh, column: str, threshold: float) -> DataFrame:
    """(v_id, value): values of at least `threshold` in size, zero otherwise."""
    return mesh.vertices.select("v_id", F.when(F.abs(column) >= threshold, F.col(column)).otherwise(0.0).alias("value"))


def threshold_edges(edges: DataFrame, threshold: float, kind: str = "strength") -> DataFrame:
    """Edges (i, j, w) with w >= threshold, or >= threshold times the variance of all w (`variance`)."""
    if kind in ("strength", "distance"):
        return edges.where(F.col("w") >= threshold)
    if kind != "variance":
        raise ValueError("kind is strength, distance or variance")
    return edges.crossJoin(edges.agg(F.var_pop("w").alias("_v"))).where(F.col("w") >= threshold * F.col("_v")).drop("_v")  # one row


def threshold_surface(mesh: Mesh, threshold: float, kind: str = "strength", edges: DataFrame | None = None) -> tuple[Mesh, DataFrame]:
    """(mesh of the vertices that keep an edge, the edges kept) (D16). Weights are the face counts unless given."""
    edges = edges if edges is not None else mesh.edges.withColumnRenamed("n_faces", "w")
    kept = threshold_edges(edges, threshold, kind)
    touched = kept.where("w > 0").select(F.explode(F.array("i", "j")).alias("v_id")).distinct()
    return topology.reindexed(Mesh(mesh.vertices.join(touched, "v_id", "left_semi"), mesh.faces)), kept


def threshold_minimum(edges: DataFrame) -> float:
    """Largest threshold that leaves the graph (i, j, w) in as many components: by bisection over the distinct weights."""
    from tessellar.operators.graphs import component_count

    whole = component_count(edges, edges)
    weights = global_rank(edges.select("w").distinct(), ["w"], "p").select("w", (F.col("p") + 1).alias("r"))
    low, high = 1, weights.count()
    while low < high:
        middle = (low + high + 1) // 2
        cutoff = weights.where(F.col("r") == middle).first().w
        low, high = (middle, high) if component_count(edges.where(F.col("w") >= cutoff), edges) == whole else (low, middle - 1)
    return weights.where(F.col("r") == low).first().w


def combine_surfaces(*meshes: Mesh) -> Mesh:
    """One mesh of all (the first included, D18), ids offset by the vertices and faces before; missing data is null."""
    vertices, faces = None, None
    v_base, f_base = 0, 0
    for m in meshes:
        v = m.vertices.withColumn("v_id", F.col("v_id") + v_base)
        f = m.faces.withColumn("f_id", F.col("f_id") + f_base).select("f_id", *[(F.col(c) + v_base).alias(c) for c in m.corners])
        vertices = v if vertices is None else vertices.unionByName(v, allowMissingColumns=True)
        faces = f if faces is None else faces.unionByName(f)
        top = m.vertices.agg(F.max("v_id")).crossJoin(m.faces.agg(F.max("f_id"))).first()
        v_base, f_base = v_base + (top[0] if top[0] is not None else -1) + 1, f_base + (top[1] if top[1] is not None else -1) + 1
    return Mesh(vertices, faces)


def split_surface(mesh: Mesh, labels: DataFrame, how: str = "any") -> DataFrame:
    """Faces per label (label, f_id, corners): any corner has the label, or all have it."""
    hits = mesh.spread(mesh.spread(topology.face_corners(mesh), "v_id").join(labels.hint("merge"), "v_id"), "f_id").groupBy("f_id", "label").agg(F.count("*").alias("n"))
    wanted = hits if how == "any" else hits.where(F.col("n") == mesh.polyshape)
    return wanted.join(mesh.faces.hint("merge"), "f_id").select("label", "f_id", *mesh.corners)


def sort_verts(mesh: Mesh, criterion: str = "x") -> DataFrame:
    """(v_id, position): order by x, y, z, norm or a data column, ties by id."""
    key = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) if criterion == "norm" else F.col(criterion)
    return global_rank(mesh.vertices, [key, "v_id"]).select("v_id", "position")


def decimate(mesh: Mesh, factor: float = 0.1) -> Mesh:
    """The int(V * factor) vertices with the nearest neighbours, and the faces among them."""
    from tessellar.operators.spatial import nearest_neighbor

    keep = int(mesh.vertices.count() * factor)
    near = nearest_neighbor(mesh.vertices, mesh.vertices, exclude_self=True)
    chosen = global_rank(near, ["distance", "v_id"]).where(F.col("position") < keep).select("v_id")
    return topology.reindexed(Mesh(mesh.vertices.join(chosen.hint("merge"), "v_id", "left_semi"), mesh.faces, mesh.tasks))


def refine(mesh: Mesh, rounds: int = 1) -> Mesh:
    """Midpoint subdivision, each triangle into four (tetrahedra into eight), `rounds` times.

    New vertices are numbered after the old ones in the order of their edges
    (i, j); child k of face f is face 4 f + k (8 f + k).
    """
    for _ in range(rounds):
        mesh = _refined(mesh)
    return mesh


def _refined(mesh: Mesh) -> Mesh:
    first = mesh.vertices.agg(F.max("v_id")).first()[0] + 1
    keyed = mesh.spread(mesh.edges.select("i", "j"), "i")
    order = topology.dense_ids(mesh.edges.select("i"), "i")
    counts = keyed.groupBy("i").agg(F.count("*").alias("n")).join(order.hint("merge"), "i")
    base = counts.withColumn("_block", F.floor(F.col("new_id") / topology.BLOCK))
    blocks = base.groupBy("_block").agg(F.sum("n").alias("_n"))
    blocks = blocks.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "_block").select("i", (F.col("_before") + F.col("_in")).alias("_start"))
    among = F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1
    middles = keyed.withColumn("_k", among).join(mesh.spread(starts, "i").hint("merge"), "i").select("i", "j", (F.lit(first) + F.col("_start") + F.col("_k")).cast("bigint").alias("m"))
    ends = middles
    for c, k in (("i", "p"), ("j", "q")):
        ends = mesh.spread(ends, c).join(mesh.vertices.select(F.col("v_id").alias(c), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]).hint("merge"), c)
    new = ends.select(F.col("m").alias("v_id"), *[((F.col(f"p{x}") + F.col(f"q{x}")) / 2).alias(x) for x in "xyz"])
    vertices = mesh.vertices.unionByName(new, allowMissingColumns=True)
    faces = mesh.faces.select("f_id", *mesh.corners)
    pairs = ["ab", "bc", "ca"] if mesh.polyshape == 3 else ["ab", "ac", "ad", "bc", "bd", "cd"]
    for p, q in pairs:
        side = middles.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("m").alias(f"{p}{q}"))
        faces = mesh.spread(faces.withColumn("_i", F.least(p, q)).withColumn("_j", F.greatest(p, q)), "_i", "_j").join(mesh.spread(side, "_i", "_j").hint("merge"), ["_i", "_j"]).drop("_i", "_j")
    if mesh.polyshape == 3:
        children = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]
    else:
        children = [("a", "ab", "ac", "ad"), ("ab", "b", "bc", "bd"), ("ac", "bc", "c", "cd"), ("ad", "bd", "cd", "d"), ("ab", "ac", "ad", "bd"), ("ab", "bc", "ac", "bd"), ("ac", "cd", "bd", "ad"), ("ac", "bc", "bd", "cd")]
    n = len(children)
    out = faces.select(F.inline(F.array(*[F.struct((F.col("f_id") * n + k).alias("f_id"), *[F.col(x).alias(c) for x, c in zip(child, "abcd")]) for k, child in enumerate(children)])))
    return Mesh(vertices, out, mesh.tasks and mesh.tasks * n)


def to_triangular(mesh: Mesh) -> Mesh:
    """Boundary triangles of a tetrahedral mesh, in their own winding; f_id = 4 tet + side."""
    sides = [("c", "b", "a"), ("a", "b", "d"), ("b", "c", "d"), ("c", "a", "d")]
    every = mesh.faces.select(F.inline(F.array(*[F.struct((F.col("f_id") * 4 + k).alias("f_id"), *[F.col(x).alias(c) for x, c in zip(s, "abc")]) for k, s in enumerate(sides)])))
    keys = ["_p", "_q", "_r"]  # the corners in order; plain columns, as a sum over arrays would sort all rows
    every = every.withColumn("_p", F.least("a", "b", "c")).withColumn("_r", F.greatest("a", "b", "c")).withColumn("_q", F.col("a") + F.col("b") + F.col("c") - F.col("_p") - F.col("_r"))
    columns = ["f_id", "a", "b", "c"]
    alone = mesh.spread(every, *keys).groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in columns]).where("n = 1")
    return Mesh(mesh.vertices, alone.select(*columns), mesh.tasks)


def to_tetrahedral_triangles(mesh: Mesh) -> Mesh:
    """All four triangles of each tetrahedron (shared sides twice); f_id = 4 tet + side."""
    sides = [("c", "b", "a"), ("a", "b", "d"), ("b", "c", "d"), ("c", "a", "d")]
    return Mesh(mesh.vertices, mesh.faces.select(F.inline(F.array(*[F.struct((F.col("f_id") * 4 + k).alias("f_id"), *[F.col(x).alias(c) for x, c in zip(s, "abc")]) for k, s in enumerate(sides)]))))


def parcellate(data: DataFrame, by: str = "label", value: str = "value", *keys: str) -> DataFrame:
    """Mean per label > 0 (and `keys`), not-a-number left out; null where nothing is left."""
    return data.where(F.col(by) > 0).groupBy(by, *keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean"))
