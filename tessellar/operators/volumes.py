"""Voxel volumes as (vx, vy, vz, value) rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions.scalars import affine

AXES = ("vx", "vy", "vz")


def _offsets(reach: int = 1) -> Column:
    r = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy"), F.lit(c).alias("oz")) for a in r for b in r for c in r if (a, b, c) != (0, 0, 0)])


def calc_volume(volume: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row: voxels (non-zero) and their volume."""
    return volume.agg(F.count_if(F.col("value") != 0).alias("n_voxels")).select("n_voxels", (F.col("n_voxels") * math.prod(voxel)).alias("volume"))


def boundary_voxels(roi: DataFrame) -> DataFrame:
    """Voxels of a region with any of the 26 neighbours outside it (or outside the volume)."""
    around = roi.select(*AXES, F.explode(_offsets()).alias("o")).select(*AXES, *[(F.col(v) + F.col(f"o.o{k}")).alias(f"n{k}") for v, k in zip(AXES, "xyz")])
    inside = roi.select(*[F.col(v).alias(f"n{k}") for v, k in zip(AXES, "xyz")], F.lit(1).alias("_in"))
    return around.join(inside, ["nx", "ny", "nz"], "left").groupBy(*AXES).agg(F.count("_in").alias("n_inside")).where("n_inside < 26")


def dilate(roi: DataFrame) -> DataFrame:
    """The region and all 26-neighbours of its voxels."""
    grown = roi.select(F.explode(_offsets()).alias("o"), *AXES).select(*[(F.col(v) + F.col(f"o.o{k}")).alias(v) for v, k in zip(AXES, "xyz")])
    return roi.select(*AXES).unionByName(grown).distinct()


def affine_ras(volume: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Voxels with their coordinates under a 4 x 4 matrix."""
    return volume.withColumn("_p", affine(matrix, *[F.col(v).cast("double") for v in AXES])).select(*volume.columns, *[F.col(f"_p.{k}").alias(k) for k in "xyz"])


def smooth(volume: DataFrame, fwhm: float, shape: tuple[int, int, int], mode: str = "constant") -> DataFrame:
    """Separable Gaussian filter of the given full width at half maximum (D36); `wrap` takes the axes as rings.

    One pass per axis: every voxel sends its weighted value to the places in
    reach, which add up before the shuffle.
    """
    sigma = fwhm / math.sqrt(8 * math.log(2))
    reach = max(1, math.ceil(4 * sigma))
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-reach, reach + 1), raw)])
    out = volume.select(*AXES, F.col("value").cast("double").alias("value"))
    for axis, n in zip(AXES, shape):
        place = F.col(axis) + F.col("k.o")
        sent = out.withColumn("k", F.explode(kernel)).withColumn(axis, F.pmod(place, F.lit(n)) if mode == "wrap" else place)
        sent = sent.withColumn("value", F.col("value") * F.col("k.w")).drop("k")
        if mode != "wrap":
            sent = sent.where(F.col(axis).between(0, n - 1))
        out = sent.groupBy(*AXES).agg(F.sum("value").alias("value"))
    return out


def grid_to_points(grid: DataFrame, points: DataFrame) -> DataFrame:
    """(v_id, value): bilinear interpolation of a unit grid (gx, gy, value) at points (v_id, x, y); null outside."""
    base = points.select("v_id", F.floor("x").alias("gx0"), F.floor("y").alias("gy0"), (F.col("x") - F.floor("x")).alias("fx"), (F.col("y") - F.floor("y")).alias("fy"))
    corners = F.array(*[F.struct((F.col("gx0") + a).alias("gx"), (F.col("gy0") + b).alias("gy"), ((F.col("fx") if a else 1 - F.col("fx")) * (F.col("fy") if b else 1 - F.col("fy"))).alias("w")) for a in (0, 1) for b in (0, 1)])
    spread = base.select("v_id", F.inline(corners)).where("w > 0")
    joined = spread.join(grid, ["gx", "gy"], "left")
    return joined.groupBy("v_id").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def points_to_grid(points: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(gx, gy, value): value of the nearest point (v_id, x, y, z, value) at each grid node inside the bounding box; ties to the least id."""
    from tessellar.operators.spatial import nearest_neighbor

    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    # one row, exploded axis by axis
    nodes = box.select("y0", "y1", "x0", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / spacing).cast("int"))).alias("gx"))
    nodes = nodes.select("gx", (F.col("x0") + F.col("gx") * spacing).alias("x"), "y0", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / spacing).cast("int"))).alias("gy"))
    nodes = nodes.select((F.col("gx").cast("bigint") * (1 << 31) + F.col("gy")).alias("v_id"), "gx", "gy", "x", (F.col("y0") + F.col("gy") * spacing).alias("y"), F.lit(0.0).alias("z"))
    near = nearest_neighbor(nodes, points.withColumn("z", F.lit(0.0)))
    return nodes.join(near, "v_id").join(points.select(F.col("v_id").alias("ref_id"), "value"), "ref_id").select("gx", "gy", "value")


def masked_matrix(volume: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels of `volume` inside `mask` (value <> 0)."""
    return volume.join(mask.where("value <> 0").select(*AXES), list(AXES), "left_semi")


def volume_to_surface(volume: DataFrame, points: DataFrame) -> DataFrame:
    """(v_id, value): value of the voxel that holds each point (v_id, x, y, z in voxel units), null outside."""
    at = points.select("v_id", *[F.round(k).cast("bigint").alias(v) for k, v in zip("xyz", AXES)])
    return at.join(volume, list(AXES), "left").select("v_id", "value")


def estimate_fwhm(profile: DataFrame) -> DataFrame:
    """One row: full width at half maximum of (pos, value), from the moments of a Gaussian profile."""
    m = profile.agg((F.sum(F.col("pos") * F.col("value")) / F.sum("value")).alias("m"), (F.sum(F.col("pos") ** 2 * F.col("value")) / F.sum("value")).alias("q"))
    return m.select((F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0))) * math.sqrt(8 * math.log(2))).alias("fwhm"))
