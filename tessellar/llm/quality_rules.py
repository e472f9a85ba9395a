"""Quality rules: robust multivariate outliers by minimum covariance determinant (native).

Four transformed statistics of a text (mean word length, share of symbols,
repeated lines, share of words in repeated three-word windows) form its vector.
For each language and source they are held against the minimum covariance
determinant: of all subsets of h = ceil(3n/4) vectors, the one whose covariance
has the least determinant.

Search: STARTS starts per group (all vectors, and samples of five taken by
hash), two concentration steps each (estimate, order by Mahalanobis distance,
keep the h closest), then STEPS more for the BEST of them. The covariance of the winner is made consistent for normal data, vectors
within the 0.975 quantile of it give the reweighted estimate, and a document
whose squared distance exceeds CUTOFF is rejected. FLOORS, variances below which
a difference does not count, are added to every covariance (a regularised
determinant: most texts share the value 0 in three of the statistics).

Estimates are shrunk: a group's towards its language's, that towards all
documents', with the weight of PRIOR documents. So each document past the base
rules is judged in a group of any size, by the same formula.

Everything is DataFrame expressions. Vectors are whole thousandths, so all sums
are exact and reruns agree; equal vectors are one row with a count. Order
statistics come from histograms of the logarithm of the distance (per group and
start a bounded number of bins); of the bin that holds the h-th vector, each
vector counts by the same fraction, so h is exact and ties are treated alike. No
group is ever sorted or gathered; one with a third of all rows is a partial
aggregation like any other. Estimates are one row per group and start.

Defined cases: null and wordless texts have zero counts and fail the base
rules; null language or source is a group of its own; repeated rows get equal
verdicts; a very long text is one row like any other (its windows are compared
within the row); an empty table gives an empty result; extra columns, also of
clashing names, are ignored by `report` and carried by `select`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh, stored, wide_key

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

DIMENSIONS = 4
SCALE = 1000
#: standard deviations (in thousandths) below which a difference does not count, per dimension
FLOORS = (60, 350, 500, 700)
SHARE = 0.75
STARTS = 10
FIRST_STEPS = 2
BEST = 3
STEPS = 4
#: vectors of a start, and sampled ones per group to take them from
DRAWN = DIMENSIONS + 1
SAMPLE = (STARTS - 1) * DRAWN
#: bins per unit of the distance's logarithm, in the first steps and after
COARSE, BINS = 8, 32
PRIOR = 20
#: parts that the rows of one group are dealt to
SALT = 16
#: fixed values for four dimensions: consistency factors at shares 0.75 and 0.975, chi-square quantiles 0.975 and 0.9999
CONSISTENT, REWEIGHTED = 1.4864, 1.0645
NEAR, CUTOFF = 11.1433, 23.5127

_X = [f"x{i}" for i in range(DIMENSIONS)]
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def base_counts(text: Column) -> dict[str, Column]:
    """Intermediate columns, in dependency order, that end in the base counts."""
    get = F.get
    return {
        "_t": F.coalesce(text, F.lit("")),
        "_w": F.array_remove(F.split("_t", BLANKS), ""),
        "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_words": F.size("_w").cast("bigint"),
        "_h": F.when(F.size("_w") >= 3, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, get("_w", i + 1), get("_w", i + 2))), F.lit(1), F.size("_w") - 2)).otherwise(F.array().cast("array<bigint>")),
        # windows sorted by hash, with their places, only where any hash repeats
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        "_r": F.filter("_s", lambda x, i: x["h"].eqNullSafe(get("_s", i - 1)["h"]) | x["h"].eqNullSafe(get("_s", i + 1)["h"])),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("_r", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0)).cast("bigint"),
    }


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, uid, g, lang, base counts, base_failed, x0..x3): g names the group, x are thousandths."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.concat_ws("\x01", part(lang_col), part(source_col)).alias("g"), part(lang_col).alias("lang"))
    rows = rows.select("doc_id", "g", "lang", wide_key("doc_id", "text").alias("uid"), "text")
    for name, value in base_counts(F.col("text")).items():
        rows = rows.withColumn(name, value)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = (F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines").cast("double")), F.log1p(100 * F.col("n_repeat_words") / words))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("doc_id", "uid", "g", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *[F.round(SCALE * v).cast("bigint").alias(x) for v, x in zip(vector, _X)])


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact counts, sums and sums of products of the vectors per key."""
    products = [F.sum(F.col("n") * F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)], *products)


_SUMS = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"q{i}{j}" for i, j in _PAIRS]]
_MEANS = [f"m{i}" for i in range(DIMENSIONS)]
_COVS = [f"v{i}{j}" for i, j in _PAIRS]


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """n, means and covariances (times `factor`, plus the floors) of each row of sums."""
    n = F.col("n").cast("double")
    keys = [c for c in sums.columns if c not in _SUMS]
    out = sums.select(*keys, n.alias("n"), *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(DIMENSIONS)], *[(F.col(f"q{i}{j}") / n).alias(f"q{i}{j}") for i, j in _PAIRS])

    def cov(i: int, j: int) -> Column:
        value = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        return F.greatest(value, F.lit(0.0)) * factor + float(FLOORS[i] ** 2) if i == j else value * factor

    return out.select(*keys, "n", *_MEANS, *[cov(i, j).alias(f"v{i}{j}") for i, j in _PAIRS])


def _factored(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor and the log determinant."""
    for i, j in _PAIRS:
        value = F.col(f"v{i}{j}")
        for p in range(j):
            value = value - F.col(f"l{i}{p}") * F.col(f"l{j}{p}")
        estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / F.col(f"l{j}{j}"))
    return estimates.withColumn("logdet", F.round(reduce(lambda a, b: a + b, [F.log(F.col(f"l{i}{i}")) for i in range(DIMENSIONS)]), 9))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds `d2`, the squared Mahalanobis distance, by forward substitution."""
    for i, x in enumerate(_X):
        value = F.col(x) - F.col(f"m{i}")
        for p in range(i):
            value = value - F.col(f"l{i}{p}") * F.col(f"y{p}")
        rows = rows.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMENSIONS)]))


def _joined(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the estimates of their group, a group's rows dealt to SALT parts by content."""
    part = F.pmod(F.xxhash64(*_X), F.lit(SALT)).cast("int")
    dealt = estimates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("part", part).join(dealt, ["g", "part"], how).drop("part")


def _step(vectors: DataFrame, current: DataFrame, bins: int) -> DataFrame:
    """One concentration step: the estimate over the h closest vectors of each group and start."""
    placed = _distance(_joined(vectors, current.drop("n"))).withColumn("bin", F.floor(bins * F.log(F.col("d2") + 1e-3)).cast("int"))
    group = Window.partitionBy("g", "k")
    smaller = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins of one group and start: bounded by the range of a logarithm
    binned = _sums(placed, "g", "k", "bin").select("*", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("below"), F.ceil(SHARE * F.sum("n").over(group)).alias("h"))
    whole, part = F.col("below") + F.col("n") <= F.col("h"), F.col("below") < F.col("h")
    share = (F.col("h") - F.col("below")) / F.col("n")
    # whole bins add up exactly; the one bin that is cut adds its fraction
    kept = [(F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(~whole & part, F.col(c) * share)), F.lit(0.0))).alias(c) for c in _SUMS]
    return cut(_factored(_moments(binned.groupBy("g", "k").agg(*kept), CONSISTENT)))


def _vectors(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their count per group, language and all documents; and each of these with its parent.

    Names of languages and of all documents begin with a letter that no group's begins with.
    """
    own = cut(stats.where("NOT base_failed").groupBy("g", "lang", *_X).agg(F.count("*").alias("n")))
    tongue, everything = F.concat(F.lit("lang"), "lang"), F.lit("all")
    row = lambda level, e, parent: F.struct(F.lit(level).alias("level"), e.alias("e"), parent.alias("parent"))
    levels = F.explode(F.array(row(2, F.col("g"), tongue), row(1, tongue, everything), row(0, everything, F.lit(None).cast("string")))).alias("p")
    parents = cut(own.select("g", "lang").distinct().select(levels).select("p.level", F.col("p.e").alias("g"), "p.parent").distinct())
    every = F.explode(F.array("g", tongue, everything)).alias("e")
    return cut(own.select(every, *_X, "n").groupBy("e", *_X).agg(F.sum("n").alias("n")).withColumnRenamed("e", "g")), parents


def _starts(vectors: DataFrame) -> DataFrame:
    """Sums of all vectors (k = 0) and of DRAWN sampled ones (k = 1...) per group."""
    order = Window.partitionBy("g").orderBy("hash", *_X)
    ranked = vectors.withColumn("hash", F.md5(F.concat_ws("-", *_X))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE)
    sampled = ranked.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("r", *_X))).alias("points"))  # SAMPLE points at most
    m = F.size("points")
    sampled = sampled.select("g", "points", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLE - 1))).alias("i"))
    # where a group has fewer points, they are taken again at a wider stride
    first = F.floor(F.col("i") / DRAWN).cast("int") * DRAWN
    place = F.pmod(first + F.pmod(F.col("i"), F.lit(DRAWN)) * (1 + F.floor(first / F.col("m")).cast("int")), F.col("m"))
    picked = sampled.select("g", (F.floor(F.col("i") / DRAWN) + 1).cast("int").alias("k"), F.get("points", place.cast("int")).alias("p")).select("g", "k", *[f"p.{x}" for x in _X], F.lit(1).cast("bigint").alias("n"))
    return _sums(vectors.select("g", F.lit(0).alias("k"), *_X, "n").unionByName(picked), "g", "k")


def _least(current: DataFrame, n: int) -> DataFrame:
    """The n starts of least determinant of each group."""
    best = current.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("logdet", "k"))), 1, n).alias("b")).select("g", F.explode("b.k").alias("k"))
    return current.join(best, ["g", "k"])


def _shrunk(estimates: DataFrame, parents: DataFrame) -> DataFrame:
    """Estimates of all levels, each drawn towards its parent's with the weight of PRIOR documents, factored."""
    placed = cut(parents.join(estimates, "g"))
    out = above = placed.where("level = 0").select("g", *_MEANS, *_COVS)
    for level in (1, 2):
        wider = above.select(F.col("g").alias("parent"), *[F.col(c).alias(f"w_{c}") for c in _MEANS + _COVS])
        below = placed.where(F.col("level") == level).join(wider, "parent")
        above = cut(below.select("g", *[((F.col("n") * F.col(c) + PRIOR * F.col(f"w_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in _MEANS + _COVS]))
        out = out.unionByName(above)
    return cut(_factored(out))


def search(vectors: DataFrame) -> DataFrame:
    """Per group: the estimate of least determinant that the starts lead to."""
    current = cut(_factored(_moments(_starts(vectors), 1.0)))
    for _ in range(FIRST_STEPS):
        current = _step(vectors, current, COARSE)
    current = cut(_least(current, BEST))
    for _ in range(STEPS):
        current = _step(vectors, current, BINS)
    return cut(_least(current, 1))


def estimates(vectors: DataFrame, parents: DataFrame) -> DataFrame:
    """Per group: mean and Cholesky factor of the reweighted, shrunk estimate."""
    raw = _shrunk(search(vectors).select("g", "n", *_MEANS, *_COVS), parents)
    near = _distance(_joined(vectors, raw)).where(F.col("d2") <= NEAR)
    # a group without a near vector takes its parent's estimate
    counted = _moments(_sums(near, "g"), REWEIGHTED)
    whole = raw.join(cut(counted).select("g", "n", *[F.col(c).alias(f"c_{c}") for c in _MEANS + _COVS]), "g", "left")
    return _shrunk(whole.select("g", F.coalesce("n", F.lit(0.0)).alias("n"), *[F.coalesce(f"c_{c}", c).alias(c) for c in _MEANS + _COVS]), parents)


def verdicts(docs: DataFrame, *, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """`statistics` with `distance` (squared) and `kept`."""
    stats = stored(statistics(docs, **columns), "statistics")
    judged = _distance(_joined(stats, estimates(*_vectors(stats)), "left"))
    distance = F.when(~F.col("base_failed"), F.round("d2", 6))
    return judged.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False)))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, distance, kept."""
    return verdicts(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def select(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are kept."""
    key = fresh(docs, "uid")
    good = verdicts(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("uid").alias(key))
    return docs.withColumn(key, wide_key(id_col, text_col)).join(good, key, "left_semi").select(*docs.columns)
