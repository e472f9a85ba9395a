"""Iterative graph operators over (i, j) edge frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.mesh import Mesh
from tessellar.operators.iteration import cut, settle


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), *keep).unionByName(edges.select(F.col("j").alias("src"), F.col("i").alias("dst"), *keep))


def _edges_of(graph: Mesh | DataFrame) -> DataFrame:
    return graph.edges if isinstance(graph, Mesh) else graph


def connected_components(graph: Mesh | DataFrame, max_rounds: int = 100) -> DataFrame:
    """(v_id, component): least id of the component, by alternately taking the neighbours' least label and jumping to its label."""
    links = cut(both_ways(_edges_of(graph)).distinct())
    start = links.select(F.col("src").alias("v_id")).distinct().withColumn("component", F.col("v_id"))

    def step(state: DataFrame) -> DataFrame:
        # sides that shrink when compressed would be broadcast through the driver
        near = links.join(state.hint("merge"), F.col("dst") == F.col("v_id")).groupBy("src").agg(F.min("component").alias("m"))
        low = state.join(near.hint("merge"), F.col("v_id") == F.col("src")).select("v_id", F.least("component", "m").alias("component"))
        jump = low.select(F.col("v_id").alias("component"), F.col("component").alias("root"))
        return low.join(jump.hint("merge"), "component").select("v_id", F.col("root").alias("component"))

    return settle(start, step, lambda s: s.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0], max_rounds)


def component_count(edges: DataFrame, whole: DataFrame) -> int:
    """Components of the vertices of `whole` under `edges`; a vertex without an edge is one."""
    every = whole.select(F.explode(F.array("i", "j")).alias("v_id")).distinct()
    joined = connected_components(edges) if not edges.isEmpty() else every.select("v_id", F.col("v_id").alias("component")).limit(0)
    alone = every.join(joined, "v_id", "left_anti").count()
    return joined.agg(F.count_distinct("component")).first()[0] + alone


def shortest_path_length(graph: Mesh | DataFrame, source: int, target: int | None = None, weight: str | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(v_id, distance) from `source`; hops, or sums of `weight` (D12). Unreachable vertices have no row; `target` keeps one."""
    edges = _edges_of(graph)
    cost = F.col(weight).cast("double") if weight else F.lit(1.0)
    links = cut(both_ways(edges.withColumn("_c", cost), "_c").groupBy("src", "dst").agg(F.min("_c").alias("c")))
    known = edges.sparkSession.range(1).select(F.lit(source).cast("bigint").alias("v_id"), F.lit(0.0).alias("distance"))
    frontier = known
    for _ in range(max_rounds):
        reached = links.join(frontier, F.col("src") == F.col("v_id")).groupBy("dst").agg(F.min(F.col("distance") + F.col("c")).alias("d"))
        better = reached.join(known, F.col("dst") == F.col("v_id"), "left").where(F.col("distance").isNull() | (F.col("d") < F.col("distance")))
        frontier = cut(better.select(F.col("dst").alias("v_id"), F.col("d").alias("distance")))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier).groupBy("v_id").agg(F.min("distance").alias("distance")))
    return known if target is None else known.where(F.col("v_id") == target)


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(v_id, degree, triangles): each edge points to its end of higher degree, so wedges stay few."""
    links = both_ways(edges).distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    d = degree.select(F.col("src").alias("v"), "degree")
    ordered = edges.select("i", "j").distinct().join(d.select(F.col("v").alias("i"), F.col("degree").alias("di")), "i").join(d.select(F.col("v").alias("j"), F.col("degree").alias("dj")), "j")
    up = ordered.select(F.when((F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j"))), F.struct(F.col("i").alias("s"), F.col("j").alias("t"))).otherwise(F.struct(F.col("j").alias("s"), F.col("i").alias("t"))).alias("e")).select("e.s", "e.t")
    wedges = up.select("s", F.col("t").alias("p")).join(up.select("s", F.col("t").alias("q")), "s").where("p < q")
    closed = wedges.join(edges.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).distinct(), ["p", "q"])
    per = closed.select(F.explode(F.array("s", "p", "q")).alias("v_id")).groupBy("v_id").agg(F.count("*").alias("t"))
    return d.join(per, d["v"] == per["v_id"], "left").select(F.col("v").alias("v_id"), "degree", F.coalesce("t", F.lit(0)).alias("triangles"))


def clustering_coefficient(graph: Mesh | DataFrame) -> DataFrame:
    """One row: mean local clustering, vertices of degree below 2 counting 0."""
    local = F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))
    return triangle_counts(_edges_of(graph)).agg(F.avg(local).alias("clustering"))


def rich_club(graph: Mesh | DataFrame, k: int) -> DataFrame:
    """One row: phi(k) = density among vertices of degree above k, null for fewer than two (D27, not normalised)."""
    edges = _edges_of(graph)
    rich = both_ways(edges).distinct().groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") > k)
    inside = edges.join(rich.select(F.col("src").alias("i")), "i", "left_semi").join(rich.select(F.col("src").alias("j")), "j", "left_semi").agg(F.count("*").alias("e"))
    return inside.crossJoin(rich.agg(F.count("*").alias("n"))).select(F.try_divide(2.0 * F.col("e"), F.col("n") * (F.col("n") - 1)).alias("phi"))


def smooth(mesh: Mesh, values: DataFrame, rounds: int = 1) -> DataFrame:
    """(v_id, value): `rounds` times the mean over the vertex and its neighbours, weighted by vertex area."""
    from tessellar.operators.metrics import vertex_areas

    areas = vertex_areas(mesh)
    links = both_ways(mesh.edges)
    weights = cut(links.join(areas.select(F.col("v_id").alias("dst"), F.col("area").alias("w")).hint("merge"), "dst").select("src", "dst", "w").unionByName(areas.select(F.col("v_id").alias("src"), F.col("v_id").alias("dst"), F.col("area").alias("w"))))
    for _ in range(rounds):
        values = weights.join(values.select(F.col("v_id").alias("dst"), "value").hint("merge"), "dst").groupBy("src").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value")).withColumnRenamed("src", "v_id")
        if rounds > 3:
            values = cut(values)
    return values


def orient(mesh: Mesh, max_rounds: int = 1000) -> Mesh:
    """Triangles turned alike across shared sides, outward if that makes the volume positive; tetrahedra of negative volume swap two corners."""
    from tessellar.operators import metrics, topology

    if mesh.polyshape == 4:
        signed = metrics.tet_volumes(mesh)
        faces = mesh.faces.join(signed, "f_id")
        turn = F.col("signed_volume") < 0
        return Mesh(mesh.vertices, faces.select("f_id", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), "c", "d"))
    sides = topology.half_edges(mesh).withColumn("i", F.least("src", "dst")).withColumn("j", F.greatest("src", "dst")).withColumn("up", F.col("src") < F.col("dst"))
    left, right = sides.select("i", "j", F.col("f_id").alias("f"), "up"), sides.select("i", "j", F.col("f_id").alias("g"), F.col("up").alias("vp"))
    # neighbours in the same direction along a side disagree
    pairs = cut(left.join(right, ["i", "j"]).where("f <> g").select("f", "g", (F.col("up") == F.col("vp")).cast("int").alias("flip")))
    state = mesh.faces.select("f_id", F.col("f_id").alias("root"), F.lit(0).alias("turn"))

    def step(s: DataFrame) -> DataFrame:
        told = pairs.join(s.hint("merge"), F.col("f") == F.col("f_id")).select(F.col("g").alias("f_id"), "root", ((F.col("turn") + F.col("flip")) % 2).alias("turn"))
        low = s.unionByName(told).groupBy("f_id").agg(F.min(F.struct("root", "turn")).alias("b")).select("f_id", "b.root", "b.turn")
        # a root is a face whose own root is known too: turns add up along the jump
        jump = low.select(F.col("f_id").alias("root"), F.col("root").alias("next"), F.col("turn").alias("more"))
        return low.join(jump.hint("merge"), "root").select("f_id", F.col("next").alias("root"), ((F.col("turn") + F.col("more")) % 2).alias("turn"))

    state = settle(state, step, lambda s: s.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0], max_rounds)
    faces = mesh.faces.join(state.select("f_id", "turn"), "f_id").select("f_id", F.when(F.col("turn") == 1, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turn") == 1, F.col("a")).otherwise(F.col("b")).alias("b"), "c")
    out = Mesh(mesh.vertices, cut(faces))
    if topology.is_closed(out).first()[0] and metrics.volume(out).first()[0] < 0:
        out = Mesh(out.vertices, out.faces.select("f_id", F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    return out


def modularity(graph: Mesh | DataFrame, weight: str = "n_faces") -> DataFrame:
    """One row: quadratic form of A - d^-1/2 d^-1/2' in its leading eigenvector over the sum of A.

    A graph of at most `solvers.COARSE` vertices is one dense kernel; beyond, the
    vector is found by LOBPCG, A being joined and the rank-one part two sums.
    """
    from tessellar.operators import solvers

    links = both_ways(_edges_of(graph).withColumn("w", F.col(weight).cast("double")), "w")
    degree = links.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("d"))
    if degree.count() > solvers.COARSE:
        negative = links.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
        found = solvers.lowest_of_graph(negative, degree.select("i", F.lit(1.0).alias("m")), 1, rank_one=degree.select("i", (1 / F.sqrt("d")).alias("u")))
        if found:
            whole = degree.agg(F.sum("d")).first()[0]
            return links.sparkSession.createDataFrame([(float(-found[1][0] / whole),)], "modularity double")
        tables = solvers.Tables(links.sparkSession)
        minus = tables.write(links.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("w")), "minus")
        root = tables.write(degree.select("i", (1 / F.sqrt("d")).alias("u")), "root")

        def operator(x: DataFrame) -> DataFrame:
            parts = solvers.mapped(x.join(root, "i"), lambda v: {"s": (v["x"] * v["u"][:, None]).sum(0, keepdims=True)}, "s array<double>").collect()  # a row per batch
            total = np.sum([r.s for r in parts], axis=0)
            return solvers.mapped(solvers.product(minus, x).join(root, "i"), lambda v: {"i": v["i"], "x": v["x"] + v["u"][:, None] * total}, "i bigint, x array<double>")

        _, values = solvers.lowest(operator, degree.select("i", F.lit(1.0).alias("m")), 1, guard=3)
        whole = degree.agg(F.sum("d")).first()[0]
        tables.close()
        return links.sparkSession.createDataFrame([(float(-values[0] / whole),)], "modularity double")
    links = links.withColumn("one", F.lit(1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["src"].to_numpy())
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = pdf["w"]
        root = 1 / np.sqrt(a.sum(1))
        return pd.DataFrame({"modularity": [np.linalg.eigvalsh(a - np.outer(root, root))[-1] / a.sum()]})

    return links.groupBy("one").applyInPandas(solve, "modularity double")


def rewire(edges: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(i, j), i < j: the edges after rounds of degree-preserving double swaps.

    In a round every edge falls into a random bucket and meets one other edge
    there at most; the pair exchanges ends, unless that gives a loop, an edge
    that exists or one that another pair gives too. So the swaps of a round
    never touch each other, and a round moves a large part of all edges.
    """
    from tessellar.operators.iteration import Tables

    tables = Tables(edges.sparkSession)
    state = tables.write(edges.where("i <> j").select(F.least("i", "j").cast("bigint").alias("i"), F.greatest("i", "j").cast("bigint").alias("j")).distinct(), "edges")
    buckets = max(state.count() // 2, 1)
    for n in range(rounds):
        key = F.xxhash64(F.lit(seed), F.lit(n), "i", "j")
        turned = F.xxhash64(F.lit("turn"), F.lit(seed), F.lit(n), "i", "j") % 2 == 0
        dealt = state.withColumn("h", key).withColumn("bucket", F.pmod("h", F.lit(buckets))).withColumn("p", F.when(turned, F.col("i")).otherwise(F.col("j"))).withColumn("q", F.when(turned, F.col("j")).otherwise(F.col("i")))
        e = F.struct("h", "i", "j", "p", "q")
        # the two edges of least and largest hash of a bucket
        pair = dealt.groupBy("bucket").agg(F.min(e).alias("x"), F.max(e).alias("y")).where("x <> y")
        a, b = (F.col("x.p"), F.col("y.q")), (F.col("y.p"), F.col("x.q"))
        new = lambda v: F.struct(F.least(*v).alias("i"), F.greatest(*v).alias("j"))
        offered = pair.where((a[0] != a[1]) & (b[0] != b[1])).select("bucket", F.struct("x.i", "x.j").alias("x"), F.struct("y.i", "y.j").alias("y"), new(a).alias("u"), new(b).alias("v")).where("u <> v")
        made = offered.select("bucket", F.inline(F.array("u", "v")))
        taken = made.join(state, ["i", "j"], "left_semi").select("bucket").unionByName(made.join(made.groupBy("i", "j").agg(F.count("*").alias("c")).where("c > 1"), ["i", "j"], "left_semi").select("bucket"))
        done = offered.join(taken.distinct(), "bucket", "left_anti")
        gone, come = done.select(F.inline(F.array("x", "y"))), done.select(F.inline(F.array("u", "v")))
        state = tables.write(state.join(gone, ["i", "j"], "left_anti").unionByName(come), "edges")
    return state


def normalized_rich_club(graph: Mesh | DataFrame, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """One row (phi, random, ratio): rich-club density beside that of the graph with its edges swapped."""
    edges = _edges_of(graph)
    swapped = rich_club(rewire(edges, rounds, seed), k).withColumnRenamed("phi", "random")
    return rich_club(edges, k).crossJoin(swapped).select("phi", "random", F.try_divide("phi", "random").alias("ratio"))  # one row each


def newman_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's Q of a labelling (v_id, label) of an unweighted graph."""
    links = both_ways(edges)
    tagged = links.join(labels.select(F.col("v_id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("v_id").alias("dst"), F.col("label").alias("ld")), "dst")
    per = tagged.groupBy("ls").agg(F.count_if(F.col("ls") == F.col("ld")).alias("inside"), F.count("*").alias("ends"))
    return per.crossJoin(links.agg(F.count("*").alias("m2"))).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("ends") / F.col("m2")) ** 2).alias("q"))
