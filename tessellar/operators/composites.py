"""Pipelines composed of the other operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.mesh import Mesh
from tessellar.operators import editing, krylov, metrics, pairs, solvers, spectral, statistics, topology, volumes


def surface_eigenmodes(mesh: Mesh, mask: DataFrame, n_modes: int) -> DataFrame:
    """(k, lambda, v_id, psi) over all vertices: modes of the masked surface, zero outside the mask."""
    ids = topology.dense_ids(mask.where("keep = 1"), "v_id")
    modes = editing.apply_mask(mesh, mask).eigenmodes(n_modes)
    inside = modes.join(ids.select(F.col("new_id").alias("v_id"), F.col("v_id").alias("full")), "v_id").select("k", "lambda", F.col("full").alias("v_id"), "psi")
    outside = mask.where("keep = 0").select("v_id").crossJoin(modes.select("k", "lambda").distinct())  # one row per mode
    return inside.unionByName(outside.select("k", "lambda", "v_id", F.lit(0.0).alias("psi")))


def eta_squared(maps: DataFrame) -> DataFrame:
    """(i, j, w) for i < j: eta squared between rows of (i, pos, value), by pairs of blocks of rows."""
    return pairs.eta_squared(maps)


def _similar_eigenmaps(maps: DataFrame, n_components: int) -> DataFrame | None:
    """`spectral.laplacian_eigenmaps` of `eta_squared`, whose entries are never written; None if a row's similarities do not add up to more than 0, or too many rounds are needed."""
    tables = solvers.Tables(maps.sparkSession)
    n = pairs.block_count(maps.select("i").distinct().count())
    product = pairs.EtaProduct(tables.write(pairs.packed(maps, n), "packed"), n)
    layout = tables.write(product.degrees(), "layout")
    sums = [np.frombuffer(r.m) for r in krylov.each(layout.select("m"), lambda v: {"m": np.array([np.frombuffer(v["m"]).min(), np.frombuffer(v["m"]).sum()]).tobytes()}, "m binary").collect()]  # a row per block
    if min(s[0] for s in sums) <= 0:
        tables.close()
        return None
    found = krylov.lowest(layout, product.grow(layout), n_components + 1, shift=1 / sum(s[1] for s in sums), width=16, max_rounds=30, tables=tables)
    return spectral._pairs(*found, first=1).select("k", "lambda", "i", "value") if found else None


def calc_gradients(maps: DataFrame, n_components: int, norm_laplacian: bool = True) -> DataFrame:
    """(k, i, value): connectopic gradients: eta-squared similarity, eigenmaps, z-scores per gradient, shifted to a least value of 0."""
    embedded = _similar_eigenmaps(maps, n_components) if norm_laplacian and maps.select("i").distinct().count() > solvers.COARSE else None
    if embedded is None:
        embedded = spectral.laplacian_eigenmaps(eta_squared(maps), n_components, norm_laplacian)
    scored = statistics.normalize_data(embedded, "value", "k").select("k", "i", F.col("z").alias("value"))
    return scored.crossJoin(scored.agg(F.min("value").alias("_m"))).select("k", "i", (F.col("value") - F.col("_m")).alias("value"))  # one row


def cortical_projection(roi: DataFrame, cortex: DataFrame, gradient: DataFrame) -> DataFrame:
    """(i, value): each cortical row takes the gradient value of the region row (i, pos, value) it correlates with most, the least id on ties."""
    r = statistics.pearsonr(roi, cortex)
    best = r.where("r IS NOT NULL").groupBy("j").agg(F.min(F.struct((-F.col("r")).alias("c"), "i")).alias("b")).select(F.col("j"), F.col("b.i").alias("i"))
    return best.join(gradient.select("i", "value"), "i").select(F.col("j").alias("i"), "value")


def fingerprint_projection(roi: DataFrame, cortex: DataFrame, gradient: DataFrame, n_components: int | None = None) -> DataFrame:
    """`cortical_projection` by fingerprints: rows (i, pos, value) of both, standardised, are compared by their scores on the cortex's singular vectors.

    The last component is left out, as all of them together are the data again.
    """
    scaled = lambda d: statistics.normalize_data(d.select("i", "pos", "value"), "value", "i").where("z IS NOT NULL").select("i", "pos", F.col("z").alias("value"))
    whole = scaled(cortex)
    components, scores = statistics.svd(whole)
    last = components.agg(F.max("k")).first()[0] or 0
    kept = components.where((F.col("k") < last) & (F.col("k") < (n_components or last)))
    of_roi = scaled(roi).join(kept, "pos").groupBy("i", "k").agg(F.sum(F.col("value") * F.col("v")).alias("value"))
    of_cortex = scores.join(kept.select("k").distinct(), "k", "left_semi").withColumnRenamed("score", "value")
    return cortical_projection(of_roi.withColumnRenamed("k", "pos"), of_cortex.withColumnRenamed("k", "pos"), gradient)


def face_values(mesh: Mesh, values: DataFrame) -> DataFrame:
    """(f_id, value): mean of the corner values."""
    corners = mesh.spread(topology.face_corners(mesh), "v_id").join(values.hint("merge"), "v_id")
    return mesh.spread(corners, "f_id").groupBy("f_id").agg((F.sum("value") / mesh.polyshape).alias("value"))


def edge_weights(mesh: Mesh, faces: DataFrame) -> DataFrame:
    """(i, j, w): sum of the values of an edge's faces, the larger of both directions."""
    # a value per face is small beside the limit of a broadcast, and too many for the driver
    directed = mesh.spread(mesh.spread(topology.half_edges(mesh), "f_id").join(faces.hint("merge"), "f_id"), "src", "dst").groupBy("src", "dst").agg(F.sum("value").alias("w"))
    either = directed.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "w")
    return mesh.spread(either, "i", "j").groupBy("i", "j").agg(F.max("w").alias("w"))


def rft_threshold(mesh: Mesh, values: DataFrame, fwhm: float, q: float = 0.05) -> DataFrame:
    """(v_id, value): the map above the random-field threshold of its surface, zero below."""
    spark = mesh.vertices.sparkSession
    resels = metrics.area(mesh).first()[0] / fwhm**2
    z = statistics.euler_threshold(resels, q)(spark)
    return values.crossJoin(z).select("v_id", F.when(F.col("value") >= F.col("z"), F.col("value")).otherwise(0.0).alias("value"))  # one row


def mode_similarity(modes: DataFrame) -> DataFrame:
    """(k, mean, low, high): correlation of mode k (subject, k, v_id, psi) between all pairs of subjects, mean and 1.96 standard errors, signs aside."""
    a = modes.select("k", "v_id", F.col("subject").alias("s"), F.col("psi").alias("x"))
    b = modes.select("k", "v_id", F.col("subject").alias("t"), F.col("psi").alias("y"))
    r = a.join(b, ["k", "v_id"]).where("s < t").groupBy("k", "s", "t").agg(F.abs(statistics.pearson("x", "y")).alias("r"))
    half = 1.96 * F.stddev_pop("r") / F.sqrt(F.count("r"))
    return r.groupBy("k").agg(F.avg("r").alias("mean"), (F.avg("r") - half).alias("low"), (F.avg("r") + half).alias("high"))


def betas_and_accuracy(data: DataFrame, modes: DataFrame) -> DataFrame:
    """(subject, r): correlation of each subject's map with its projection on the modes (inner-product betas), L-infinity normalised."""
    betas = data.join(modes, "v_id").groupBy("subject", "k").agg(F.sum(F.col("psi") * F.col("value")).alias("beta"))
    recon = betas.join(modes, "k").groupBy("subject", "v_id").agg(F.sum(F.col("beta") * F.col("psi")).alias("recon"))
    scaled = statistics.max_abs_normalize(recon, "recon", "subject")
    return scaled.join(data, ["subject", "v_id"]).groupBy("subject").agg(statistics.pearson("u", "value").alias("r"))


def combined_region(labels: DataFrame, wanted: list[int], grow: int = 0) -> DataFrame:
    """Voxels of any wanted label, dilated `grow` times."""
    region = labels.where(F.col("value").isin(wanted)).select(*volumes.AXES)
    for _ in range(grow):
        region = volumes.dilate(region)
    return region


def optimum_eigengroups(data: DataFrame, modes: DataFrame, rounds: int = 10, seed: int = 0, tol: float = 1e-9) -> tuple[DataFrame, float]:
    """(order: k, place; r): within eigengroups, swap two modes of a truncated reconstruction while the correlation rises by more than tol.

    Reconstruction keeps the first mode of each group; one aggregate per round.
    """
    from tessellar.functions.scalars import eigengroup
    import numpy as np

    ks = [row.k for row in modes.select("k").distinct().orderBy("k").collect()]
    betas = spectral.eigen_decomposition(data, modes)
    spark, rng = data.sparkSession, np.random.default_rng(seed)
    place = {k: i for i, k in enumerate(ks)}

    def frame(p: dict) -> DataFrame:
        return spark.createDataFrame([(k, i) for k, i in p.items()], "k bigint, place bigint")

    def score(p: dict) -> float:
        leading = frame(p).withColumn("g", eigengroup(F.col("place"))).groupBy("g").agg(F.min(F.struct("place", "k")).alias("b")).select(F.col("b.k").alias("k"))
        recon = spectral.reconstruct_data(betas, modes.join(leading, "k", "left_semi"))
        return recon.withColumnRenamed("value", "recon").join(data, "v_id").agg(statistics.pearson("recon", "value")).first()[0] or 0.0

    best = score(place)
    for _ in range(rounds):
        a, b = rng.choice(len(ks), 2, replace=False)
        a, b = ks[a], ks[b]
        if int(place[a] ** 0.5) != int(place[b] ** 0.5):
            continue
        trial = place | {a: place[b], b: place[a]}
        now = score(trial)
        if now > best + tol:
            place, best = trial, now
    return frame(place), best
