"""Correlations, null comparisons and permutation statistics.

Maps are long frames. `pearson` avoids `corr` so that constant inputs give null
instead of an error. Permutations are ordered by md5 of (seed, permutation,
row), so any engine reproduces them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessellar.operators.ordering import average_ranks, global_rank
from tessellar.operators.pairs import correlations


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation, null if either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_rank(order: Column | str, *keys: str) -> Column:
    """Rank within `keys`, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, order)) - 1) / 2


def pairwise_r(maps: DataFrame, flatten: bool = True) -> DataFrame:
    """(i, j, r): correlation of all pairs of rows of (i, pos, value); i < j if `flatten`, else in both orders and with itself. By pairs of blocks of rows."""
    return correlations(maps) if flatten else correlations(maps, maps)


def pearsonr(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, r): correlation of each row of x with each row of y, both (i, pos, value)."""
    return correlations(x, y)


def spearmanr(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, r): rank correlation of row i of x with row i of y."""
    ranked = [f.select("i", "pos", average_rank("value", "i").alias(n)) for f, n in ((x, "x"), (y, "y"))]
    return ranked[0].join(ranked[1], ["i", "pos"]).groupBy("i").agg(pearson("x", "y").alias("r"))


def spearman_pairwise(maps: DataFrame) -> DataFrame:
    """(i, j, r) for i < j: rank correlation of rows of (i, pos, value)."""
    return pairwise_r(maps.select("i", "pos", average_rank("value", "i").alias("value")))


def compare_images(source: DataFrame, target: DataFrame, *, metric: str = "pearsonr", ignore_zero: bool = True, nan_policy: str = "omit") -> DataFrame:
    """One row (r, n) over the ids that both maps (v_id, value) have; zeros on either side (|x| <= 1e-8) dropped."""
    both = source.select("v_id", F.col("value").alias("x")).join(target.select("v_id", F.col("value").alias("y")), "v_id")
    if ignore_zero:
        both = both.where((F.abs("x") > 1e-8) & (F.abs("y") > 1e-8))
    missing = F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()
    if nan_policy == "raise":
        if not both.where(missing).isEmpty():
            raise ValueError("a map holds missing values")
    elif nan_policy == "omit":
        both = both.where(~missing)
    if metric == "spearmanr":
        both = average_ranks(average_ranks(both, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    return both.agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))


def shuffled(rows: DataFrame, n_perm: int, seed: int, id_col: str = "v_id") -> DataFrame:
    """(perm, id_col, place): for each of n_perm permutations the place of each id, from 0.

    `rows` are subjects or map positions, repeated once per permutation; their
    values are not.
    """
    perms = rows.sparkSession.range(1, n_perm + 1).select(F.col("id").alias("perm"))
    key = F.md5(F.concat_ws("-", F.lit(seed), "perm", id_col))
    return rows.select(id_col).crossJoin(F.broadcast(perms)).withColumn("place", F.row_number().over(Window.partitionBy("perm").orderBy(key, id_col)) - 1)  # perms: n_perm rows


def permtest_metric(pairs: DataFrame, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """One row (r, p) of (v_id, x, y): p = (1 + nulls at least as large) / (n_perm + 1)."""
    places = global_rank(pairs, ["v_id"], "place").select("place", "x")
    order = shuffled(pairs, n_perm, seed).join(pairs.select("v_id", "y"), "v_id")
    nulls = order.join(places, "place").groupBy("perm").agg(pearson("x", "y").alias("null"))
    true = pairs.agg(pearson("x", "y").alias("r"))
    # one row on the right
    return nulls.crossJoin(true).groupBy("r").agg(((1.0 + F.count_if(F.abs("null") >= F.abs("r"))) / (n_perm + 1.0)).alias("p"))


def nonparp(statistic: DataFrame, nulls: DataFrame) -> DataFrame:
    """(v_id, p): share of null values (v_id, value) larger in size than the statistic (v_id, stat), strictly."""
    return nulls.join(statistic, "v_id").groupBy("v_id").agg(F.avg(F.when(F.abs("value") > F.abs("stat"), 1.0).otherwise(0.0)).alias("p"))


def zscore_vs_nulls(statistic: DataFrame, nulls: DataFrame) -> DataFrame:
    """(v_id, z): statistic against mean and population deviation of its nulls; null where they do not vary."""
    spread = nulls.groupBy("v_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return statistic.join(spread, "v_id").select("v_id", ((F.col("stat") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))


def normalize_data(data: DataFrame, value: str = "value", *keys: str) -> DataFrame:
    """Adds `z`, the value standardised within `keys` by the population deviation; null where it does not vary."""
    stats = data.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = data.join(stats, list(keys)) if keys else data.crossJoin(stats)  # one row without keys
    return joined.withColumn("z", (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def max_abs_normalize(data: DataFrame, value: str = "value", *keys: str) -> DataFrame:
    """Adds `u`, the value over the largest size within `keys`."""
    top = data.groupBy(*keys).agg(F.max(F.abs(value)).alias("_t"))
    return data.join(top, list(keys)).withColumn("u", F.col(value) / F.nullif("_t", F.lit(0.0))).drop("_t")


def permuted_groups(subjects: DataFrame, n_first: int, n_perm: int, seed: int) -> DataFrame:
    """(perm, subject, first): pooled subjects dealt into a first group of n_first and the rest."""
    return shuffled(subjects, n_perm, seed, "subject").select("perm", "subject", (F.col("place") < n_first).alias("first"))


def perm_group_zmap(maps: DataFrame, first: str, n_perm: int = 1000, seed: int = 20) -> DataFrame:
    """(v_id, diff, z, p): group difference of means per vertex against permuted groups.

    `maps` is (grp, subject, v_id, value); only subjects are permuted, values
    join once per permutation and combine before the shuffle.
    """
    subjects = maps.select("subject", "grp").distinct()
    n_first = subjects.where(F.col("grp") == first).count()
    mean = lambda keep: F.avg(F.when(keep, F.col("value")))
    true = maps.groupBy("v_id").agg((mean(F.col("grp") == first) - mean(F.col("grp") != first)).alias("diff"))
    dealt = permuted_groups(subjects, n_first, n_perm, seed)
    nulls = maps.select("subject", "v_id", "value").join(dealt, "subject").groupBy("perm", "v_id").agg((mean(F.col("first")) - mean(~F.col("first"))).alias("null"))
    return nulls.join(true, "v_id").groupBy("v_id", "diff").agg(((F.col("diff") - F.avg("null")) / F.nullif(F.stddev_pop("null"), F.lit(0.0))).alias("z"), F.avg(F.when(F.abs("null") >= F.abs("diff"), 1.0).otherwise(0.0)).alias("p"))


def beta_p_value(r: Column, n: Column) -> Column:
    """Two-tailed p of a correlation of n pairs, by the incomplete beta function (Arrow-batched)."""

    @pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else _correlation_p(float(a), int(b)) for a, b in zip(r, n)], dtype="float64")

    return p(r, n)


def _correlation_p(r: float, n: int) -> float:
    """P(|R| >= |r|): I_{1 - r^2}(n / 2 - 1, 1 / 2)."""
    from math import exp, lgamma, log

    a, b, x = n / 2 - 1, 0.5, 1 - min(r * r, 1.0)
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + step / c
                c = c if abs(c) > tiny else tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def efficient_pearsonr(a: DataFrame, b: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, r, n, p): correlation of matching columns of two long frames (keys, on, value), clipped to [-1, 1]."""
    both = a.select(*keys, *on, F.col("value").alias("x")).join(b.select(*keys, *on, F.col("value").alias("y")), [*keys, *on])
    out = both.groupBy(*keys).agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))
    out = out.withColumn("r", F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0)))
    return out.withColumn("p", beta_p_value(F.col("r"), F.col("n")))


def euler_threshold(resels: float, q: float = 0.05, max_z: float = 50.0, points: int = 10_000):
    """Expression-level threshold search: see `functions.scalars.expected_ec`; returns a function of a session giving one row (z, ec)."""
    from tessellar.functions.scalars import expected_ec

    def run(spark) -> DataFrame:
        grid = spark.range(points).select((F.col("id") * (max_z / (points - 1))).alias("z")).withColumn("ec", expected_ec(F.col("z"), F.lit(float(resels))))
        hits = grid.where(F.col("ec") <= q).withColumn("_r", F.row_number().over(Window.orderBy("z")))
        return hits.where("_r = 2").select("z", "ec")  # the first is z = 0 (D50)

    return run


def variogram(points: DataFrame, values: DataFrame, bins: int, max_distance: float) -> DataFrame:
    """(bin, n, gamma): half mean squared difference of pairs by distance bin, pairs up to max_distance found by cells."""
    from tessellar.operators.spatial import within

    pairs = within(points, points, max_distance).where("v_id < ref_id")
    at = pairs.join(values.select("v_id", F.col("value").alias("x")), "v_id").join(values.select(F.col("v_id").alias("ref_id"), F.col("value").alias("y")), "ref_id")
    place = F.least(F.floor(F.col("distance") * bins / max_distance), F.lit(bins - 1)).alias("bin")
    return at.groupBy(place).agg(F.count("*").alias("n"), (F.avg((F.col("x") - F.col("y")) ** 2) / 2).alias("gamma"))


#: cells of a matrix that a task of its decomposition holds
SVD_CELLS = 100_000


def svd(data: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((k, s, pos, v), (i, k, score)): singular values, right vectors and scores of the matrix (i, pos, value), absent cells being 0.

    For many rows and few positions: the Gram matrix of the positions is one
    aggregation, and all that the driver sees; scores are a join with the
    vectors. Each vector's entry of largest size is positive; components of
    which s is 0 are left out.
    """
    import numpy as np

    from tessellar.operators.solvers import eigh

    data = data.repartition(max(data.count() // SVD_CELLS, 1), "i")  # the rows' joins and sums stay in tasks of like size
    a, b = data.select("i", F.col("pos").alias("p"), F.col("value").alias("x")), data.select("i", F.col("pos").alias("q"), F.col("value").alias("y"))
    gram = a.join(b, "i").where("p <= q").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()  # positions squared
    places = sorted({r.p for r in gram} | {r.q for r in gram})
    at = {p: n for n, p in enumerate(places)}
    g = np.zeros((len(places),) * 2)
    for p, q, value in gram:
        g[at[p], at[q]] = g[at[q], at[p]] = value
    values, vectors = eigh(data.sparkSession, g)
    order = np.argsort(-values)
    order = [n for n in order if values[n] > 1e-12 * max(values.max(initial=0.0), 1e-300)][:k]
    rows = []
    for n, e in enumerate(order):
        v = vectors[:, e] * np.sign(vectors[np.abs(vectors[:, e]).argmax(), e])
        rows += [(n, float(np.sqrt(values[e])), int(p), float(x)) for p, x in zip(places, v)]
    components = data.sparkSession.createDataFrame(rows, "k int, s double, pos int, v double")
    scores = data.join(components, "pos").groupBy("i", "k").agg(F.sum(F.col("value") * F.col("v")).alias("score"))
    return components, scores
