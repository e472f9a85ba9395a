"""Areas, normals, qualities, volumes and rescaling: column arithmetic over faces joined with their corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.mesh import Mesh
from tessellar.operators.topology import edge_flags

Vector = tuple[Column, Column, Column]


def cornered(mesh: Mesh, *data: str) -> DataFrame:
    """Faces with the coordinates (and `data`) of their corners: columns ax, ay, az, bx, ..."""
    out = mesh.faces
    for c in mesh.corners:
        # vertices compress well and would be broadcast through the driver
        out = mesh.spread(out, c).join(mesh.vertices.select(F.col("v_id").alias(c), *[F.col(k).alias(f"{c}{k}") for k in ("x", "y", "z", *data)]).hint("merge"), c)
    return out


def point(c: str) -> Vector:
    return F.col(f"{c}x"), F.col(f"{c}y"), F.col(f"{c}z")


def minus(p: Vector, q: Vector) -> Vector:
    return tuple(u - v for u, v in zip(p, q))


def cross(p: Vector, q: Vector) -> Vector:
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def dot(p: Vector, q: Vector) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def norm(p: Vector) -> Column:
    return F.sqrt(dot(p, p))


def face_normal() -> Vector:
    """Cross product of two sides: twice the area long."""
    return cross(minus(point("b"), point("a")), minus(point("c"), point("a")))


def tria_areas(mesh: Mesh) -> DataFrame:
    """(f_id, area) by Heron's formula."""
    sides = [norm(minus(point(p), point(q))) for p, q in ("ba", "cb", "ac")]
    faces = cornered(mesh).select("f_id", *[s.alias(f"s{i}") for i, s in enumerate(sides)])
    half = (F.col("s0") + F.col("s1") + F.col("s2")) / 2
    return faces.select("f_id", F.sqrt(F.greatest(half * (half - F.col("s0")) * (half - F.col("s1")) * (half - F.col("s2")), F.lit(0.0))).alias("area"))


def tria_normals(mesh: Mesh) -> DataFrame:
    """(f_id, nx, ny, nz) of unit length; a degenerate face has the zero vector."""
    n = face_normal()
    faces = cornered(mesh).select("f_id", *[c.alias(k) for c, k in zip(n, ("nx", "ny", "nz"))])
    size = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return faces.withColumn("_l", F.when(size < 1e-300, 1.0).otherwise(size)).select("f_id", *[(F.col(k) / F.col("_l")).alias(k) for k in ("nx", "ny", "nz")])


def tria_qualities(mesh: Mesh) -> DataFrame:
    """(f_id, quality): 1 for an equilateral triangle; null where all corners coincide."""
    squares = [dot(minus(point(p), point(q)), minus(point(p), point(q))) for p, q in ("ba", "cb", "ac")]
    return cornered(mesh).select("f_id", F.try_divide(2 * F.sqrt(F.lit(3.0)) * norm(face_normal()), squares[0] + squares[1] + squares[2]).alias("quality"))


def vertex_areas(mesh: Mesh) -> DataFrame:
    """(v_id, area): a third of the areas of the incident triangles; of a tetrahedral mesh, of its boundary's."""
    if mesh.polyshape == 4:
        from tessellar.operators.editing import to_triangular

        mesh = to_triangular(mesh)
    corners = cornered(mesh).select(F.explode(F.array("a", "b", "c")).alias("v_id"), (norm(face_normal()) / 2).alias("area"))
    return mesh.spread(corners, "v_id").groupBy("v_id").agg((F.sum("area") / 3).alias("area"))


def vertex_normals(mesh: Mesh) -> DataFrame:
    """(v_id, nx, ny, nz): area-weighted mean direction of the incident faces."""
    n = face_normal()
    spread = cornered(mesh).select(F.explode(F.array("a", "b", "c")).alias("v_id"), *[c.alias(k) for c, k in zip(n, ("nx", "ny", "nz"))])
    total = spread.groupBy("v_id").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "nz")])
    size = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return total.withColumn("_l", F.when(size < 2.2e-16, 1.0).otherwise(size)).select("v_id", *[(F.col(k) / F.col("_l")).alias(k) for k in ("nx", "ny", "nz")])


def _surface(mesh: Mesh) -> Mesh:
    if mesh.polyshape == 3:
        return mesh
    from tessellar.operators.editing import to_triangular

    return to_triangular(mesh)


def area(mesh: Mesh) -> DataFrame:
    """One row: total (boundary) area."""
    return tria_areas(_surface(mesh)).agg(F.sum("area").alias("area"))


def tet_volumes(mesh: Mesh) -> DataFrame:
    """(f_id, signed_volume) of tetrahedra."""
    a = point("a")
    return cornered(mesh).select("f_id", (dot(minus(point("d"), a), cross(minus(point("b"), a), minus(point("c"), a))) / 6).alias("signed_volume"))


def volume(mesh: Mesh) -> DataFrame:
    """One row: signed volume inside a closed, oriented surface, or the sum of the tetrahedra's volumes.

    A surface that is open or not oriented fails when the row is computed: it encloses nothing.
    """
    if mesh.polyshape == 4:
        return tet_volumes(mesh).agg(F.sum(F.abs("signed_volume")).alias("volume"))
    inside = cornered(mesh).agg((F.sum(dot(point("a"), face_normal())) / 6).alias("volume"))
    flags = edge_flags(mesh).select((F.col("is_closed") & F.col("is_oriented")).alias("_solid"))
    return inside.crossJoin(flags).select(F.when(F.col("_solid"), F.col("volume")).otherwise(F.raise_error(F.lit("the volume of a surface that is open or not oriented is not defined")).cast("double")).alias("volume"))


def centroid(mesh: Mesh) -> DataFrame:
    """One row: area-weighted mean of the face centres (cx, cy, cz) and the total area."""
    faces = cornered(mesh).select((norm(face_normal()) / 2).alias("s"), *[((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(k) for k in "xyz"])
    return faces.agg(*[(F.sum(F.col("s") * F.col(k)) / F.sum("s")).alias(f"c{k}") for k in "xyz"], F.sum("s").alias("area"))


def average_edge_length(mesh: Mesh) -> DataFrame:
    """One row: mean length of the undirected edges."""
    ends = mesh.edges
    for c, k in (("i", "a"), ("j", "b")):
        ends = mesh.spread(ends, c).join(mesh.vertices.select(F.col("v_id").alias(c), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]).hint("merge"), c)
    return ends.agg(F.avg(norm(minus(point("a"), point("b")))).alias("average_edge_length"))


def normalize(mesh: Mesh, norm_type: str = "area", factor: float | None = None) -> Mesh:
    """Vertices over q**(1/3), or q**(1/4) for tetrahedra; q is the area, the volume, the number of vertices or a constant."""
    power = 1 / 3 if mesh.polyshape == 3 else 1 / 4
    measure = {
        "area": lambda: area(mesh).select(F.col("area").alias("_q")),
        "volume": lambda: volume(mesh).select(F.abs("volume").alias("_q")),
        "number": lambda: mesh.vertices.agg(F.count("*").cast("double").alias("_q")),
        "constant": lambda: mesh.vertices.sparkSession.range(1).select(F.lit(float(factor)).alias("_q")),
    }
    if norm_type not in measure:
        raise ValueError(f"norm_type is one of {sorted(measure)}")
    scaled = mesh.vertices.crossJoin(measure[norm_type]())  # one row
    for k in "xyz":
        scaled = scaled.withColumn(k, F.col(k) / F.pow("_q", F.lit(power)))
    return Mesh(scaled.drop("_q"), mesh.faces)


def unit_normalize(mesh: Mesh) -> Mesh:
    """(v - centroid) / sqrt(area)."""
    scaled = mesh.vertices.crossJoin(centroid(mesh).withColumnRenamed("area", "_area"))  # one row
    for k in "xyz":
        scaled = scaled.withColumn(k, (F.col(k) - F.col(f"c{k}")) / F.sqrt("_area"))
    return Mesh(scaled.drop("cx", "cy", "cz", "_area"), mesh.faces)


def euclidean_distmat(mesh: Mesh) -> DataFrame:
    """(i, j, distance) for i < j, met in pairs of blocks of vertices. The result itself has V (V - 1) / 2 rows."""
    from tessellar.operators.pairs import block_count, unordered_pairs

    n = block_count(mesh.vertices.count())
    pairs = unordered_pairs(mesh.vertices, {"v_id": "i", **{k: f"a{k}" for k in "xyz"}}, {"v_id": "j", **{k: f"b{k}" for k in "xyz"}}, n)
    return pairs.select("i", "j", norm(minus(point("a"), point("b"))).alias("distance"))
