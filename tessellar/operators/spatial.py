"""Nearest neighbours and point correspondence by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """(v_id, ref_id, distance) of all pairs at most `radius` apart: an equi-join on grid cells.

    Cells are a little wider than the diameter, so that a point's surroundings
    lie in its own cell and the one beside it on the nearer side, eight in all.
    """
    size = 2 * radius * (1 + 1e-6)
    at = {k: F.col(k) / size for k in "xyz"}
    near = {k: F.array(F.floor(v), F.floor(v) + F.when(v - F.floor(v) < 0.5, -1).otherwise(1)) for k, v in at.items()}
    p = points.select("v_id", "x", "y", "z", near["x"].alias("nx"), near["y"].alias("ny"), near["z"].alias("nz"))
    for k in "xyz":
        p = p.withColumn(f"c{k}", F.explode(f"n{k}")).drop(f"n{k}")
    q = reference.select(F.col("v_id").alias("ref_id"), *[F.col(k).alias(f"r{k}") for k in "xyz"], *[F.floor(at[k]).alias(f"c{k}") for k in "xyz"])
    d = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 + (F.col("z") - F.col("rz")) ** 2)
    # neither side grows in the estimates as its rows do, and either would be broadcast through the driver
    return p.join(q.hint("merge"), ["cx", "cy", "cz"]).select("v_id", "ref_id", d.alias("distance")).where(F.col("distance") <= radius)


def nearest_neighbor(points: DataFrame, reference: DataFrame, *, exclude_self: bool = False, max_rounds: int = 64) -> DataFrame:
    """(v_id, ref_id, distance): exact nearest reference point, ties to the least id.

    Searches within a radius that starts at the mean spacing of the reference's
    bounding box and doubles for the points that found none.
    """
    from tessellar.operators.iteration import cut

    box = reference.agg(*[F.min(k).alias(f"l{k}") for k in "xyz"], *[F.max(k).alias(f"h{k}") for k in "xyz"], F.count("*").alias("n")).first()
    if not box.n:
        return points.select("v_id", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    sides = [max(box[f"h{k}"] - box[f"l{k}"], 0.0) for k in "xyz"]
    live = [s for s in sides if s > 0] or [1.0]
    volume = 1.0
    for s in live:
        volume *= s
    radius = (volume / box.n) ** (1 / len(live)) or 1.0
    pending, found = points.select("v_id", "x", "y", "z"), None
    for _ in range(max_rounds):
        pairs = within(pending, reference, radius)
        if exclude_self:
            pairs = pairs.where("v_id <> ref_id")
        best = cut(pairs.groupBy("v_id").agg(F.min(F.struct("distance", "ref_id")).alias("b")).select("v_id", "b.ref_id", "b.distance"))
        found = best if found is None else found.unionByName(best)
        pending = cut(pending.join(best.hint("merge"), "v_id", "left_anti"))
        if pending.isEmpty() or (exclude_self and box.n < 2):
            return found
        radius *= 2
    raise RuntimeError(f"points without a neighbour after {max_rounds} doublings")


def locate(points: DataFrame, mesh, eps: float = 1e-9, spacing: float | None = None) -> DataFrame:
    """(v_id, f_id, wa, wb, wc, wd): the tetrahedron that holds each point, of least id where several do, and the point's weights in it.

    Tetrahedra are listed in the grid cells that their boxes touch, points in
    the cell that they lie in; cells are as large as the mean box, so a typical
    tetrahedron has eight. Points in none have no row.
    """
    from tessellar.operators.metrics import cornered, cross, dot, minus, point

    if mesh.polyshape != 4:
        raise ValueError("points are located in tetrahedra")
    corners = cornered(mesh)
    low = {k: F.least(*[F.col(f"{c}{k}") for c in "abcd"]) for k in "xyz"}
    high = {k: F.greatest(*[F.col(f"{c}{k}") for c in "abcd"]) for k in "xyz"}
    if spacing is None:
        sides = corners.agg(F.avg(F.greatest(*[high[k] - low[k] for k in "xyz"]))).first()[0]
        spacing = sides or 1.0
    cells = corners
    for k in "xyz":
        cells = cells.withColumn(f"g{k}", F.explode(F.sequence(F.floor((low[k] - eps) / spacing), F.floor((high[k] + eps) / spacing))))
    p = points.select("v_id", *[F.col(k).cast("double").alias(f"p{k}") for k in "xyz"], *[F.floor(F.col(k) / spacing).alias(f"g{k}") for k in "xyz"])
    both = p.join(cells, ["gx", "gy", "gz"])
    a, b, c, d, q = (point(k) for k in "abcdp")
    det = lambda u, v, w: dot(u, cross(v, w))
    six = det(minus(b, a), minus(c, a), minus(d, a))
    parts = {"wb": det(minus(q, a), minus(c, a), minus(d, a)), "wc": det(minus(b, a), minus(q, a), minus(d, a)), "wd": det(minus(b, a), minus(c, a), minus(q, a))}
    weighed = both.select("v_id", "f_id", *[F.try_divide(v, six).alias(k) for k, v in parts.items()]).withColumn("wa", 1 - F.col("wb") - F.col("wc") - F.col("wd"))
    inside = weighed.where(F.least("wa", "wb", "wc", "wd") >= -eps)
    names = ["f_id", "wa", "wb", "wc", "wd"]
    return inside.groupBy("v_id").agg(F.min(F.struct(*names)).alias("b")).select("v_id", *[f"b.{n}" for n in names])


def nearest_by_simplex(points: DataFrame, mesh, radius: float | None = None) -> DataFrame:
    """(v_id, ref_id, distance): the nearest corner, within `radius` if given, of the tetrahedron that holds the point; else the nearest vertex of all."""
    held = locate(points, mesh).select("v_id", "f_id").join(mesh.faces, "f_id").select("v_id", F.explode(F.array(*mesh.corners)).alias("ref_id"))
    at = points.select("v_id", "x", "y", "z")
    ends = mesh.vertices.select(F.col("v_id").alias("ref_id"), *[F.col(k).alias(f"r{k}") for k in "xyz"])
    d = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 + (F.col("z") - F.col("rz")) ** 2)
    near = held.join(at, "v_id").join(ends, "ref_id").select("v_id", "ref_id", d.alias("distance"))
    if radius is not None:
        near = near.where(F.col("distance") <= radius)
    from tessellar.operators.iteration import cut

    best = cut(near.groupBy("v_id").agg(F.min(F.struct("distance", "ref_id")).alias("b")).select("v_id", "b.ref_id", "b.distance"))
    rest = at.join(best, "v_id", "left_anti")
    return best.unionByName(nearest_neighbor(rest, mesh.vertices))


def find_vertex_correspondence(points: DataFrame, reference: DataFrame, eps: float = 0.0) -> DataFrame:
    """(v_id, ref_id): equal coordinates if eps is 0, else the nearest within eps; raises if a vertex has none."""
    if eps == 0:
        ref = reference.groupBy("x", "y", "z").agg(F.min("v_id").alias("ref_id"))
        out = points.join(ref, ["x", "y", "z"], "left").select("v_id", "ref_id")
    else:
        best = within(points, reference, eps).groupBy("v_id").agg(F.min(F.struct("distance", "ref_id")).alias("b")).select("v_id", "b.ref_id")
        out = points.select("v_id").join(best, "v_id", "left")
    if not out.where("ref_id IS NULL").isEmpty():
        raise ValueError("a vertex has no counterpart within eps")
    return out


def get_indices(original: DataFrame, new: DataFrame) -> DataFrame:
    """(v_id of `new`, ref_id in `original`) by equal coordinates; the least id of repeated points, none where absent."""
    ref = original.groupBy("x", "y", "z").agg(F.min("v_id").alias("ref_id"))
    return new.join(ref, ["x", "y", "z"]).select("v_id", "ref_id")


def find_roi_index(correlations: DataFrame) -> DataFrame:
    """(col, roi): region with the largest correlation per column of (col, roi, cc), the least on ties."""
    return correlations.groupBy("col").agg(F.min(F.struct((-F.col("cc")).alias("c"), "roi")).alias("b")).select("col", "b.roi")
