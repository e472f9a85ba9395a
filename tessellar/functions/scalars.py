"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """r + 256 g + 65536 b"""
    return r + F.shiftleft(g, 8) + F.shiftleft(b, 16)


def unpack_rgb(packed: Column) -> Column:
    return F.struct(packed.bitwiseAND(255).alias("r"), F.shiftright(packed, 8).bitwiseAND(255).alias("g"), F.shiftright(packed, 16).bitwiseAND(255).alias("b"))


def three_byte_int(data: Column, position: int = 1) -> Column:
    """Big-endian three-byte integer of a binary column."""
    return F.conv(F.hex(F.substring(data, position, 3)), 16, 10).cast("int")


def get_ext(path: Column) -> Column:
    """Extension without the dot; empty if none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def split_filename(path: Column) -> Column:
    """(folder, base, ext): `.nii.gz` and its like count as one extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"((?:\.[A-Za-z0-9]+)?\.gz|\.[^.]*)$", 1)
    return F.struct(F.regexp_replace(F.regexp_extract(path, r"^(.*/)", 1), "(?<=.)/$", "").alias("folder"), F.substring(name, F.lit(1), F.length(name) - F.length(ext)).alias("base"), ext.alias("ext"))


def split_commas(value: Column) -> Column:
    return F.split(value, ",")


def gaussian(x: Column, amplitude: float, mean: float, sd: float) -> Column:
    return amplitude * F.exp(-((x - mean) ** 2) / (2 * sd * sd))


def resel_count(shape: tuple[int, ...], fwhm: float) -> float:
    return math.prod(n / fwhm for n in shape)


def expected_ec(z: Column, resels: Column) -> Column:
    """Expected Euler characteristic of a two-dimensional Gaussian field above z."""
    return resels * (4 * math.log(2) * (2 * math.pi) ** -1.5) * z * F.exp(-z * z / 2)


def cartesian_to_spherical(x: Column, y: Column, z: Column) -> Column:
    """(r, theta in [0, 2 pi), phi in [0, pi])"""
    r = F.sqrt(x * x + y * y + z * z)
    angle = F.atan2(y, x)
    return F.struct(r.alias("r"), F.when(angle < 0, angle + 2 * math.pi).otherwise(angle).alias("theta"), F.acos(F.try_divide(z, r)).alias("phi"))


def tkr_vox2ras(dim: tuple[int, int, int], res: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[list[float]]:
    """4 x 4 voxel-to-surface matrix of a volume."""
    (nc, nr, ns), (dc, dr, ds) = dim, res
    return [[-dc, 0.0, 0.0, dc * nc / 2], [0.0, 0.0, ds, -ds * ns / 2], [0.0, -dr, 0.0, dr * nr / 2], [0.0, 0.0, 0.0, 1.0]]


def affine(matrix: list[list[float]], x: Column, y: Column, z: Column) -> Column:
    """(x, y, z) after a 4 x 4 affine map."""
    return F.struct(*[(m[0] * x + m[1] * y + m[2] * z + m[3]).alias(k) for m, k in zip(matrix, "xyz")])


def eigengroup(k: Column) -> Column:
    """Group of mode k (from 0): groups hold 1, 3, 5, ... modes."""
    return F.floor(F.sqrt(k.cast("double"))).cast("bigint")


def random_column_name(size: int = 20) -> Column:
    return F.randstr(size)
