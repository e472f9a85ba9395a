"""Jobs: python -m tessellar eigenmodes|threshold|gradients|convert ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def eigenmodes(spark: SparkSession, args: argparse.Namespace) -> None:
    """Modes of a surface or tetrahedral file, masked by a 0/1 text file if given, as Parquet."""
    from tessellar.operators import composites
    from tessellar.sources import formats

    mesh = formats.read_surface(spark, args.surface)
    if args.normalize:
        mesh = mesh.normalize(args.normalize, args.factor)
    if args.mask:
        mask = formats.read_data(spark, args.mask).select("v_id", F.col("value").cast("int").alias("keep"))
        modes = composites.surface_eigenmodes(mesh, mask, args.modes)
    else:
        modes = mesh.eigenmodes(args.modes)
    modes.write.mode("overwrite").parquet(args.out)


def threshold(spark: SparkSession, args: argparse.Namespace) -> None:
    """A map above the random-field threshold of its surface, as text."""
    from tessellar.operators import composites
    from tessellar.sources import formats

    values = formats.read_data(spark, args.map).select("v_id", "value")
    formats.write_data(composites.rft_threshold(formats.read_surface(spark, args.surface), values, args.fwhm, args.q), args.out)


def gradients(spark: SparkSession, args: argparse.Namespace) -> None:
    """Connectopic gradients of a Parquet table (i, pos, value), as Parquet."""
    from tessellar.operators import composites

    composites.calc_gradients(spark.read.parquet(args.maps), args.components, not args.plain).write.mode("overwrite").parquet(args.out)


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    """A surface file in another format."""
    from tessellar.sources import formats

    formats.convert_surface(spark, args.source, args.target)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessellar", description=__doc__)
    jobs = top.add_subparsers(required=True)
    job = jobs.add_parser("eigenmodes", help=eigenmodes.__doc__)
    job.add_argument("surface")
    job.add_argument("out")
    job.add_argument("--mask")
    job.add_argument("--modes", type=int, default=200)
    job.add_argument("--normalize", choices=["area", "volume", "number", "constant"])
    job.add_argument("--factor", type=float)
    job.set_defaults(run=eigenmodes)
    job = jobs.add_parser("threshold", help=threshold.__doc__)
    job.add_argument("surface")
    job.add_argument("map")
    job.add_argument("out")
    job.add_argument("--fwhm", type=float, required=True)
    job.add_argument("-q", type=float, default=0.05)
    job.set_defaults(run=threshold)
    job = jobs.add_parser("gradients", help=gradients.__doc__)
    job.add_argument("maps")
    job.add_argument("out")
    job.add_argument("--components", type=int, default=5)
    job.add_argument("--plain", action="store_true", help="Laplacian without normalisation")
    job.set_defaults(run=gradients)
    job = jobs.add_parser("convert", help=convert.__doc__)
    job.add_argument("source")
    job.add_argument("target")
    job.set_defaults(run=convert)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
