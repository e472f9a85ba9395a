"""Finite elements, eigenmodes, heat, curvature, reconstruction and embeddings.

Assembly is joins and aggregates. Linear solves eliminate domains of the matrix
(`tessellar.operators.direct`), or are rounds of joins on its entries, as
eigenmodes are (`tessellar.operators.solvers`); a mesh of at most
`solvers.COARSE` vertices is solved as a dense matrix in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.scalars import eigengroup
from tessellar.mesh import Mesh
from tessellar.operators import direct, metrics, solvers
from tessellar.operators.solvers import Cells, mapped
from tessellar.operators.metrics import cornered, cross, dot, minus, norm, point


def fem_stiffness(mesh: Mesh) -> DataFrame:
    """(i, j, w): linear stiffness matrix, of triangles from the cotangents of the angles, of tetrahedra from the shape gradients."""
    faces = cornered(mesh)
    if mesh.polyshape == 4:
        return _tet_stiffness(faces)
    parts = []
    for apex, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        u, v = minus(point(p), point(apex)), minus(point(q), point(apex))
        parts.append(F.struct(F.col(p).alias("p"), F.col(q).alias("q"), F.try_divide(dot(u, v), norm(cross(u, v))).alias("cot")))
    cots = faces.select(F.inline(F.array(*parts)))
    half = F.coalesce(F.col("cot"), F.lit(0.0)) / 2
    entries = F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (s * half).alias("w")) for i, j, s in (("p", "q", -1), ("q", "p", -1), ("p", "p", 1), ("q", "q", 1))])
    return mesh.spread(cots.select(F.inline(entries)), "i", "j").groupBy("i", "j").agg(F.sum("w").alias("w"))


def _tet_stiffness(tets: DataFrame) -> DataFrame:
    """Gradient of a corner's shape function: the opposite side's normal over six volumes."""
    a, b, c, d = (point(k) for k in "abcd")
    normals = {"a": cross(minus(d, b), minus(c, b)), "b": cross(minus(c, a), minus(d, a)), "c": cross(minus(d, a), minus(b, a)), "d": cross(minus(b, a), minus(c, a))}
    six = dot(minus(d, a), cross(minus(b, a), minus(c, a)))
    columns = [F.abs(six).alias("_six")] + [x.alias(f"_{k}{i}") for k, n in normals.items() for i, x in enumerate(n)]
    flat = tets.select(*"abcd", *columns)
    grad = {k: tuple(F.col(f"_{k}{i}") for i in range(3)) for k in "abcd"}
    entries = F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j"), F.try_divide(dot(grad[p], grad[q]), 6 * F.col("_six")).alias("w")) for p in "abcd" for q in "abcd"])
    return flat.select(F.inline(entries)).groupBy("i", "j").agg(F.sum("w").alias("w"))


def fem_mass(mesh: Mesh, lump: bool = True) -> DataFrame:
    """(i, j, w): lumped (diagonal) or consistent mass matrix."""
    if mesh.polyshape == 4:
        tets = metrics.tet_volumes(mesh).select("f_id", F.abs("signed_volume").alias("v")).join(mesh.faces, "f_id")
        pairs = [(p, p, 4) for p in "abcd"] if lump else [(p, q, 10 if p == q else 20) for p in "abcd" for q in "abcd"]
        parts = F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (F.col("v") / k).alias("w")) for p, q, k in pairs])
        return tets.select(F.inline(parts)).groupBy("i", "j").agg(F.sum("w").alias("w"))
    if lump:
        return metrics.vertex_areas(mesh).select(F.col("v_id").alias("i"), F.col("v_id").alias("j"), F.col("area").alias("w"))
    faces = cornered(mesh).withColumn("area", norm(metrics.face_normal()) / 2)
    entries = F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j"), (F.col("area") / (6 if p == q else 12)).alias("w")) for p in "abc" for q in "abc"])
    return mesh.spread(faces.select(F.inline(entries)), "i", "j").groupBy("i", "j").agg(F.sum("w").alias("w"))


def _tagged(stiffness: DataFrame, mass: DataFrame) -> DataFrame:
    return stiffness.withColumn("kind", F.lit("k")).unionByName(mass.withColumn("kind", F.lit("m")))


def _dense(entries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.unique(entries["i"].to_numpy())
    n = len(ids)
    out = []
    for kind in ("k", "m"):
        part = entries[entries["kind"] == kind]
        m = np.zeros((n, n))
        np.add.at(m, (np.searchsorted(ids, part["i"]), np.searchsorted(ids, part["j"])), part["w"].to_numpy())
        out.append(m)
    return ids, *out


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its entry of largest size positive."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def eigenmodes(mesh: Mesh, n_modes: int = 200, lump: bool = True, tol: float = 1e-6) -> DataFrame:
    """(k, lambda, v_id, psi): the n smallest pairs of K x = lambda M x, mass-orthonormal.

    Up to `solvers.COARSE` vertices one dense kernel; beyond, and always with a
    lumped mass, LOBPCG by joins (`solvers.lowest`) after the shifted inverse. Each mode's entry of largest
    size is positive.
    """
    stiffness, mass = fem_stiffness(mesh), fem_mass(mesh, lump)
    if mesh.vertices.count() <= solvers.COARSE:
        return eigenmodes_by(_tagged(stiffness, mass).withColumn("mesh_id", F.lit(0)), n_modes).drop("mesh_id")
    if not lump:
        raise ValueError(f"a consistent mass matrix is taken up to {solvers.COARSE} vertices")
    return _pairs(*solvers.lowest(stiffness, mass.select("i", F.col("w").alias("m")), n_modes, tol=tol)).withColumnRenamed("i", "v_id").withColumnRenamed("value", "psi")


def _pairs(block: DataFrame, values: np.ndarray, first: int = 0) -> DataFrame:
    """(k, lambda, i, value) of a block of eigenvectors from column `first` on, each with its entry of largest size positive."""
    n = len(values)
    flat = block.select("i", F.posexplode("x").alias("k", "value")).where(F.col("k").between(first, n - 1)).withColumn("k", F.col("k").cast("bigint"))
    signs = flat.groupBy("k").agg(F.signum(F.max_by("value", F.struct(F.abs("value"), -F.col("i")))).alias("sign"))
    table = block.sparkSession.createDataFrame([(k, float(values[k])) for k in range(first, n)], "k bigint, lambda double")  # a row per mode
    return flat.join(F.broadcast(table), "k").join(F.broadcast(signs), "k").select("k", "lambda", "i", (F.col("value") * F.col("sign")).alias("value"))


def residuals(mesh: Mesh, modes: DataFrame) -> DataFrame:
    """(k, lambda, residual, mass): |K x - lambda M x| over |x|, both in norms of the mass, and x'Mx, of modes with a lumped mass."""
    m = fem_mass(mesh).select(F.col("i").alias("v_id"), F.col("w").alias("m"))
    kx = fem_stiffness(mesh).join(modes.select("k", F.col("v_id").alias("j"), "psi"), "j").groupBy("k", F.col("i").alias("v_id")).agg(F.sum(F.col("w") * F.col("psi")).alias("kx"))
    rows = modes.join(kx, ["k", "v_id"]).join(m, "v_id").withColumn("r", F.col("kx") - F.col("lambda") * F.col("m") * F.col("psi"))
    return rows.groupBy("k", "lambda").agg(F.sqrt(F.sum(F.col("r") ** 2 / F.col("m")) / F.sum(F.col("m") * F.col("psi") ** 2)).alias("residual"), F.sum(F.col("m") * F.col("psi") ** 2).alias("mass"))


def eigenmodes_by(entries: DataFrame, n_modes: int) -> DataFrame:
    """`eigenmodes` of many meshes at once: entries (mesh_id, kind k or m, i, j, w), one task per mesh."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, k, m = _dense(pdf)
        root = np.linalg.inv(np.linalg.cholesky(m))
        values, vectors = np.linalg.eigh(root @ k @ root.T)
        n = min(n_modes, len(ids))
        psi = _signed(root.T @ vectors[:, :n])
        return pd.DataFrame({"mesh_id": pdf["mesh_id"].iloc[0], "k": np.repeat(np.arange(n), len(ids)), "lambda": np.repeat(values[:n], len(ids)), "v_id": np.tile(ids, n), "psi": psi.T.reshape(-1)})

    return entries.groupBy("mesh_id").applyInPandas(solve, "mesh_id bigint, k bigint, lambda double, v_id bigint, psi double")


#: sources that are columns of one block
SOURCES = 16


def _blocks(mesh: Mesh, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((blk, c, source), (blk, i, x)): sources dealt to columns of blocks, and their unit vectors over all vertices."""
    from tessellar.operators.iteration import cut
    from tessellar.operators.ordering import global_rank

    ranked = global_rank(sources.select("v_id").distinct(), ["v_id"], "place")
    places = cut(ranked.select(F.floor(F.col("place") / SOURCES).alias("blk"), (F.col("place") % SOURCES).alias("c"), F.col("v_id").alias("source")))
    ones = places.select("blk", F.col("source").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(SOURCES - 1)), lambda k: (k == F.col("c")).cast("double")).alias("u"))
    # every vertex of every block is a row of the result
    rows = mesh.vertices.select(F.col("v_id").alias("i")).join(places.select("blk").distinct())
    return places, rows.join(ones, ["blk", "i"], "left").select("blk", "i", F.coalesce("u", F.array_repeat(F.lit(0.0), SOURCES)).alias("x"))


def _by_source(places: DataFrame, block: DataFrame) -> DataFrame:
    return block.select("blk", "i", F.posexplode("x").alias("c", "value")).join(places, ["blk", "c"]).select("source", F.col("i").alias("v_id"), "value")


def _heat(mesh: Mesh, b: DataFrame, m: float) -> DataFrame:
    """(blk, i, x): (M + t K) x = b, t being m times the squared mean edge length, accurate relative to each entry."""
    t = m * metrics.average_edge_length(mesh).first().average_edge_length ** 2
    entries = fem_stiffness(mesh).select("i", "j", (t * F.col("w")).alias("w")).unionByName(fem_mass(mesh)).groupBy("i", "j").agg(F.sum("w").alias("w"))
    levels, kept = direct.inverse_of(entries), solvers.Tables(b.sparkSession)
    if isinstance(levels, direct.Substructures):
        # elimination from so dominant a diagonal is right to each entry
        out = kept.write(levels.apply(kept.write(b, "b"), "blk"), "heat")
        kept.close("heat")
    else:
        out = solvers.decaying(levels.matrix, levels, b)
    levels.close()
    return out


def heat_diffusion(mesh: Mesh, sources: DataFrame, m: float = 1.0) -> DataFrame:
    """(source, v_id, value): heat after time m times the squared mean edge length."""
    places, b = _blocks(mesh, sources)
    return _by_source(places, _heat(mesh, b, m))


def _downhill(v: Cells) -> Cells:
    """Per face and source: integrated divergence, at each corner, of the unit field against the gradient of the heat."""
    p, q, r = (v["xyz"][:, 3 * c : 3 * c + 3] for c in range(3))
    heat = [v[f"x{k}"] for k in "abc"]
    normal = np.cross(q - p, r - p)
    double = np.maximum(np.linalg.norm(normal, axis=1), 1e-300)
    unit = normal / double[:, None]
    turned = [np.cross(unit, e) for e in (r - q, p - r, q - p)]
    # only the direction counts: heat relative to the face's largest
    top = np.maximum(np.maximum(np.maximum(np.abs(heat[0]), np.abs(heat[1])), np.abs(heat[2])), 1e-300)
    grad = sum((h / top)[:, :, None] * t[:, None, :] for h, t in zip(heat, turned))
    size = np.linalg.norm(grad, axis=2, keepdims=True)
    field = -np.divide(grad, size, out=np.zeros_like(grad), where=size > 0)
    out, corners = {"blk": v["blk"]}, (p, q, r)
    for c, k in enumerate("abc"):
        o, u, w = corners[c], corners[(c + 1) % 3], corners[(c + 2) % 3]
        cot_u = ((o - u) * (w - u)).sum(1) / np.maximum(np.linalg.norm(np.cross(o - u, w - u), axis=1), 1e-300)
        cot_w = ((o - w) * (u - w)).sum(1) / np.maximum(np.linalg.norm(np.cross(o - w, u - w), axis=1), 1e-300)
        out[k] = v[k]
        out[f"d{k}"] = 0.5 * (cot_w[:, None] * np.einsum("fd,fsd->fs", u - o, field) + cot_u[:, None] * np.einsum("fd,fsd->fs", w - o, field))
    return out


def geodesic_distance(mesh: Mesh, sources: DataFrame, m: float = 1.0) -> DataFrame:
    """(source, v_id, value): geodesic distance by the heat method.

    Heat, its direction per face and the distance whose gradient is opposite:
    two solves with the sources as columns, sixteen to a block, joined on vertex
    and block; the matrices are never copied.
    """
    places, b = _blocks(mesh, sources)
    heat = _heat(mesh, b, m)
    corners = cornered(mesh)
    faces = corners.select("a", "b", "c", F.array(*[x for k in "abc" for x in point(k)]).alias("xyz"))
    for k in "abc":
        of = heat.select("blk", F.col("i").alias(k), F.col("x").alias(f"x{k}"))
        faces = faces.join(of, k if k == "a" else ["blk", k])
    flows = mapped(faces.select("blk", "a", "b", "c", "xyz", "xa", "xb", "xc"), _downhill, "blk bigint, a bigint, da array<double>, b bigint, db array<double>, c bigint, dc array<double>")
    parts = [flows.select("blk", F.col(k).alias("i"), F.lit(-1.0).alias("w"), F.col(f"d{k}").alias("x")) for k in "abc"]
    divergence = solvers._summed(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("blk",))
    every = b.select("blk", "i").join(divergence, ["blk", "i"], "left").select("blk", "i", F.coalesce("x", F.array_repeat(F.lit(0.0), SOURCES)).alias("x"), F.array_repeat(F.lit(1.0), SOURCES).alias("live"))
    kept = solvers.Tables(every.sparkSession)
    stiffness, mass = kept.write(fem_stiffness(mesh), "stiffness"), kept.write(fem_mass(mesh), "mass")
    shift = 1 / mass.agg(F.sum("w")).first()[0]
    shifted = lambda by: stiffness.unionByName(mass.withColumn("w", by * F.col("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))
    try:
        levels = direct.Substructures(shifted(1e-5 * shift))  # all but the inverse of the stiffness
    except direct.Unfit:
        levels = solvers.Multilevel(shifted(shift))
    solved = solvers.solve(stiffness, levels, every, tol=1e-9)
    levels.close()
    kept.close()
    flat = _by_source(places, solved)
    least = flat.groupBy("source").agg(F.min("value").alias("least"))
    return flat.join(least, "source").select("source", "v_id", (F.col("value") - F.col("least")).alias("value"))


def geodesic_distmat(mesh: Mesh, m: float = 1.0) -> DataFrame:
    """`geodesic_distance` from every vertex."""
    return geodesic_distance(mesh, mesh.vertices.select("v_id"), m)


def geodesic_knn(mesh: Mesh, source: int, k: int = 100, m: float = 1.0) -> DataFrame:
    """(v_id, distance): the k vertices closest to `source` along the surface."""
    near = geodesic_distance(mesh, mesh.vertices.where(F.col("v_id") == source).select("v_id"), m)
    return near.where(F.col("v_id") != source).orderBy("value", "v_id").limit(k).select("v_id", F.col("value").alias("distance"))


def heat_cost_knn(mesh: Mesh, source: int, k: int = 100, m: float = 1.0) -> DataFrame:
    """(v_id, cost): least accumulated cost where stepping to a vertex costs its heat."""
    from tessellar.operators.graphs import both_ways, shortest_path_length

    heat = heat_diffusion(mesh, mesh.vertices.where(F.col("v_id") == source).select("v_id"), m).select("v_id", "value")
    links = both_ways(mesh.edges).join(heat.withColumnRenamed("v_id", "dst"), "dst")
    from tessellar.operators.iteration import cut

    steps = cut(links.select(F.col("src"), F.col("dst"), F.col("value").alias("c")))
    known = mesh.vertices.sparkSession.range(1).select(F.lit(source).cast("bigint").alias("v_id"), F.lit(0.0).alias("cost"))
    frontier = known
    while True:
        reached = steps.join(frontier, F.col("src") == F.col("v_id")).groupBy("dst").agg(F.min(F.col("cost") + F.col("c")).alias("d"))
        better = reached.join(known, F.col("dst") == F.col("v_id"), "left").where(F.col("cost").isNull() | (F.col("d") < F.col("cost")))
        frontier = cut(better.select(F.col("dst").alias("v_id"), F.col("d").alias("cost")))
        if frontier.isEmpty():
            return known.where(F.col("v_id") != source).orderBy("cost", "v_id").limit(k)
        known = cut(known.unionByName(frontier).groupBy("v_id").agg(F.min("cost").alias("cost")))


def curvature(mesh: Mesh, smoothing: int = 3) -> DataFrame:
    """Principal curvatures and directions per vertex from the edge-based tensor: k_min, k_max, k_mean, k_gauss, and unit vectors.

    Tensor of an edge: its dihedral angle times length times the outer product
    of its direction; summed over a vertex's edges, divided by area, smoothed.
    """
    n = metrics.face_normal()
    size = norm(n)
    faces = cornered(mesh).select("f_id", "a", "b", "c", *[F.try_divide(x, size).alias(k) for x, k in zip(n, ("nx", "ny", "nz"))])
    sides = faces.select(F.inline(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), "nx", "ny", "nz") for p, q in ("ab", "bc", "ca")])))
    other = sides.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col(k).alias(f"m{k[1]}") for k in ("nx", "ny", "nz")])
    pairs = sides.where("src < dst").join(other, ["src", "dst"])
    for c, k in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(mesh.vertices.select(F.col("v_id").alias(c), *[F.col(x).alias(f"{k}{x}") for x in "xyz"]), c)
    e = minus(point("b"), point("a"))
    p, q = (F.col("nx"), F.col("ny"), F.col("nz")), (F.col("mx"), F.col("my"), F.col("mz"))
    length = norm(e)
    angle = F.atan2(F.try_divide(dot(cross(p, q), e), length), dot(p, q))
    weight = F.try_divide(angle, length)
    tensor = {f"t{i}{j}": weight * e[i] * e[j] for i in range(3) for j in range(i, 3)}
    spread = pairs.select(F.explode(F.array("src", "dst")).alias("v_id"), *[v.alias(k) for k, v in tensor.items()])
    sums = spread.groupBy("v_id").agg(*[(F.sum(k) / 2).alias(k) for k in tensor])
    areas = metrics.vertex_areas(mesh)
    state = sums.join(areas, "v_id").select("v_id", *[F.try_divide(k, "area").alias(k) for k in tensor])
    if smoothing:
        from tessellar.operators.graphs import smooth
        from tessellar.operators.iteration import cut

        out = None
        for k in tensor:
            one = smooth(mesh, state.select("v_id", F.col(k).alias("value")), smoothing).withColumnRenamed("value", k)
            out = one if out is None else out.join(one, "v_id")
        state = cut(out)
    state = state.join(metrics.vertex_normals(mesh), "v_id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = np.zeros((len(pdf), 3, 3))
            for i in range(3):
                for j in range(i, 3):
                    t[:, i, j] = t[:, j, i] = pdf[f"t{i}{j}"].to_numpy()
            values, vectors = np.linalg.eigh(np.nan_to_num(t))
            normal = pdf[["nx", "ny", "nz"]].to_numpy()
            along = np.abs(np.einsum("vd,vdk->vk", normal, vectors))
            keep = np.argsort(along, 1)[:, :2]
            # bending along one direction shows as the eigenvalue of the other
            pair = np.take_along_axis(values, keep, 1)
            order = np.argsort(pair, 1)
            low, high = np.take_along_axis(pair, order, 1).T if len(pdf) else (np.empty(0), np.empty(0))
            index = np.take_along_axis(keep, order, 1)
            rows = np.arange(len(pdf))
            d_min, d_max = vectors[rows, :, index[:, 1]], vectors[rows, :, index[:, 0]]
            out = pd.DataFrame({"v_id": pdf["v_id"], "k_min": low, "k_max": high, "k_mean": (low + high) / 2, "k_gauss": low * high})
            for name, d in (("u_min", d_min), ("u_max", d_max)):
                for c, k in enumerate("xyz"):
                    out[f"{name}_{k}"] = d[:, c] if len(pdf) else []
            yield out

    schema = "v_id bigint, k_min double, k_max double, k_mean double, k_gauss double, " + ", ".join(f"{u}_{k} double" for u in ("u_min", "u_max") for k in "xyz")
    return state.mapInPandas(solve, schema)


def gram(modes: DataFrame) -> DataFrame:
    """(k, l, g): inner products of modes (v_id, k, psi) by a self-join on the vertex."""
    return modes.select("v_id", "k", F.col("psi").alias("p")).join(modes.select("v_id", F.col("k").alias("l"), F.col("psi").alias("q")), "v_id").groupBy("k", "l").agg(F.sum(F.col("p") * F.col("q")).alias("g"))


def eigen_decomposition(data: DataFrame, modes: DataFrame) -> DataFrame:
    """(k, beta): least squares of (v_id, value) on the modes; only the k x k normal equations leave the plan."""
    right = modes.join(data, "v_id").groupBy("k").agg(F.sum(F.col("psi") * F.col("value")).alias("r"))
    system = gram(modes).select("k", "l", F.col("g").alias("w")).unionByName(right.select("k", F.lit(-1).cast("bigint").alias("l"), F.col("r").alias("w"))).withColumn("one", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ks = np.sort(pdf.loc[pdf["l"] >= 0, "k"].unique())
        a, b = np.zeros((len(ks), len(ks))), np.zeros(len(ks))
        left = pdf[pdf["l"] >= 0]
        a[np.searchsorted(ks, left["k"]), np.searchsorted(ks, left["l"])] = left["w"]
        r = pdf[pdf["l"] < 0]
        b[np.searchsorted(ks, r["k"])] = r["w"]
        return pd.DataFrame({"k": ks, "beta": np.linalg.lstsq(a, b, rcond=None)[0]})

    return system.groupBy("one").applyInPandas(solve, "k bigint, beta double")  # modes squared rows


def reconstruct_data(betas: DataFrame, modes: DataFrame, n_modes: int | None = None) -> DataFrame:
    """(v_id, value): sum of beta times mode over the first n modes."""
    joined = modes.join(betas, "k")
    if n_modes is not None:
        joined = joined.where(F.col("k") < n_modes)
    return joined.groupBy("v_id").agg(F.sum(F.col("beta") * F.col("psi")).alias("value"))


def reconstruct_surface(mesh: Mesh, modes: DataFrame, n_modes: int, **normalise) -> Mesh:
    """The mesh with x, y and z rebuilt from their first n modes."""
    vertices = mesh.vertices.drop("x", "y", "z")
    for k in "xyz":
        betas = eigen_decomposition(mesh.vertices.select("v_id", F.col(k).alias("value")), modes.where(F.col("k") < n_modes))
        vertices = vertices.join(reconstruct_data(betas, modes, n_modes).withColumnRenamed("value", k), "v_id")
    out = Mesh(vertices, mesh.faces)
    return metrics.normalize(out, **normalise) if normalise else out


def incremental_recon(data: DataFrame, betas: DataFrame, modes: DataFrame, direction: str = "up") -> DataFrame:
    """(n, r): correlation of the map with its reconstruction from n modes, counted up from the first or down from the last."""
    from tessellar.operators.statistics import pearson

    order = F.col("k") if direction == "up" else F.desc("k")
    terms = modes.join(betas, "k").select("v_id", "k", (F.col("beta") * F.col("psi")).alias("term"))
    running = Window.partitionBy("v_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = terms.withColumn("recon", F.sum("term").over(running)).withColumn("n", F.count("*").over(running))
    return rows.join(data, "v_id").groupBy("n").agg(pearson("recon", "value").alias("r"))


def eigengroups(evals: DataFrame) -> DataFrame:
    """(k, lambda, group)"""
    return evals.withColumn("group", eigengroup(F.col("k")))


def ellipsoid_axes(evals: DataFrame) -> DataFrame:
    return evals.select("k", F.sqrt("lambda").alias("axis"))


def to_spheroid(modes: DataFrame) -> DataFrame:
    """Modes (k, lambda, v_id, psi) over the root of their eigenvalue; the constant mode stays."""
    return modes.withColumn("psi", F.when(F.col("lambda") > 1e-12, F.col("psi") / F.sqrt("lambda")).otherwise(F.col("psi")))


def to_ellipsoid(modes: DataFrame) -> DataFrame:
    return modes.withColumn("psi", F.when(F.col("lambda") > 1e-12, F.col("psi") * F.sqrt("lambda")).otherwise(F.col("psi")))


def resample_spheroid(modes: DataFrame, angle: float) -> DataFrame:
    """All modes but the first times cos(angle)."""
    return modes.withColumn("psi", F.when(F.col("k") >= 1, F.col("psi") * F.cos(F.lit(angle))).otherwise(F.col("psi")))


def laplacian_eigenmaps(graph: DataFrame, n_components: int, norm_laplacian: bool = True) -> DataFrame:
    """(k, lambda, i, value): the n smallest nontrivial eigenvectors of the (normalised) Laplacian of edges (i, j, w)."""
    from tessellar.operators.graphs import both_ways

    links = both_ways(graph, "w").select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    degree = links.groupBy("i").agg(F.sum("w").alias("d"))
    if degree.count() > solvers.COARSE:
        laplacian = links.select("i", "j", -F.col("w")).toDF("i", "j", "w").unionByName(degree.select("i", F.col("i").alias("j"), F.col("d").alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))
        mass = degree.select("i", (F.col("d") if norm_laplacian else F.lit(1.0)).alias("m"))
        found = solvers.lowest_of_graph(laplacian, mass, n_components + 1)
        if found:
            return _pairs(*found, first=1).select("k", "lambda", "i", "value")
        return _pairs(*solvers.lowest(laplacian, mass, n_components + 1), first=1).select("k", "lambda", "i", "value")
    links = links.withColumn("one", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"].to_numpy())
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])] = pdf["w"]
        degree = a.sum(1)
        scale = np.sqrt(degree) if norm_laplacian else np.ones(len(ids))
        values, vectors = np.linalg.eigh((np.diag(degree) - a) / np.outer(scale, scale))
        n = min(n_components, len(ids) - 1)
        out = _signed(vectors[:, 1 : n + 1] / scale[:, None])
        return pd.DataFrame({"k": np.repeat(np.arange(1, n + 1), len(ids)), "lambda": np.repeat(values[1 : n + 1], len(ids)), "i": np.tile(ids, n), "value": out.T.reshape(-1)})

    return links.groupBy("one").applyInPandas(solve, "k bigint, lambda double, i bigint, value double")


class LaplacianEigenmaps:
    """Estimator form of `laplacian_eigenmaps`."""

    def __init__(self, n_components: int = 2, norm_laplacian: bool = True):
        self.n_components, self.norm_laplacian = n_components, norm_laplacian
        self.embedding: DataFrame | None = None

    def fit(self, graph: DataFrame) -> "LaplacianEigenmaps":
        self.embedding = laplacian_eigenmaps(graph, self.n_components, self.norm_laplacian)
        return self

    def fit_transform(self, graph: DataFrame) -> DataFrame:
        return self.fit(graph).embedding


def spherical_harmonics(points: DataFrame, l: int, m: int) -> DataFrame:
    """(v_id, re, im) of Y_lm at (v_id, theta azimuth, phi polar)."""
    from math import factorial, pi, sqrt

    def legendre(x: np.ndarray) -> np.ndarray:
        order = abs(m)
        p = np.ones_like(x)
        for i in range(1, order + 1):
            p *= -(2 * i - 1) * np.sqrt(np.maximum(1 - x * x, 0))
        before, current = np.zeros_like(x), p
        for n in range(order + 1, l + 1):
            before, current = current, ((2 * n - 1) * x * current - (n + order - 1) * before) / (n - order)
        return current

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = sqrt((2 * l + 1) / (4 * pi) * factorial(l - abs(m)) / factorial(l + abs(m)))
        for pdf in batches:
            p = size * legendre(np.cos(pdf["phi"].to_numpy()))
            y = p * np.exp(1j * abs(m) * pdf["theta"].to_numpy())
            if m < 0:
                y = (-1) ** abs(m) * np.conj(y)
            yield pd.DataFrame({"v_id": pdf["v_id"], "re": y.real, "im": y.imag})

    return points.select("v_id", "theta", "phi").mapInPandas(solve, "v_id bigint, re double, im double")
