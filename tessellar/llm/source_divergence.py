"""How the words of a source differ from its language and from the language's other sources.

Terms are counted per language and source. A group's probability of a term
depends on its count alone, so the terms of a group that share a count form a
bucket; the extreme probabilities that their language gives them bound the
divergence of every term in it. Buckets are evaluated best bound first, in
rounds over all groups, until the bounds left lie strictly below the k-th value.

A pair of sources is summed over all kept terms from postings: a term that one
or neither of them has adds what its count alone tells, in closed form, and
postings add the difference where both have it.

Everything is integer arithmetic. Defined cases: a null text, language or source
is ''; every row is a document, repeated ones too; a language without kept terms
gives pairs of value 0 and no terms; texts are read whole; columns of other names
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, stored

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: sources whose pairs are added up in one array; a language of more sources is a grid of such blocks
BLOCK = 512
#: distinct terms that a task counts, and arrays of pairs that it adds up, before it hands them on
HELD, ARRAYS = 400_000, 32
#: buckets of a group that the first round evaluates; every round takes GROW times as many
FIRST, GROW = 4, 8

#: bytes of words, A to Z lowered; all other bytes are spaces
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters from U+0080 on; as UTF-8, just the bytes of these."""
    return text.translate(_BYTES).split()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, handed on whenever HELD terms are held; '' stands for the group itself."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], schema=schema)
        counts.clear()

    for batch in batches:
        langs, sources, texts = batch.columns[0].to_pylist(), batch.columns[1].to_pylist(), batch.columns[2].cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts):
            if (lang, source) not in counts:
                counts[lang, source] = (Counter({b"": 0}), Counter({b"": 0}))
            n, docs = counts[lang, source]
            before, found = len(n), words(text.as_py())
            n.update(found)
            docs.update(set(found))
            held += len(n) - before
            if held > HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def _chance(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 V)); exact, and 0 where V is 0."""
    wide = "decimal(38,0)"
    share = F.expr("CAST(0 AS BIGINT)") if n is None else (F.lit(SCALE).cast(wide) * (n + 2).cast("decimal(19,0)"))
    whole = F.call_function("div", share, (total + 2 * vocabulary).cast("decimal(19,0)"))
    return F.when(vocabulary > 0, 1 + whole.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // np.maximum(p + q, 1)


class Counts:
    """Written tables of the term counts of a corpus."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
        counted = plain.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
        per_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # a term's sources are one row: as many entries as the language has sources
        lists = per_source.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posting"))
        kept = stored(lists.where((F.col("docs") >= min_docs) | (F.col("term") == "")), "postings")
        #: (lang, term, lang_n, posting) of the kept terms
        self.postings = kept.where("term <> ''")
        flat = self.postings.select("lang", "term", "lang_n", F.inline("posting"))
        langs = self.postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
        groups = kept.where("term = ''").select("lang", F.explode("posting.source").alias("source")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a language's sources
        filled = groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "held", "v", "lang_total")])
        #: (lang, source, place, total, held, v, lang_total, p0): every group, its rank in the language, its probability of a term it lacks
        self.groups = stored(filled.withColumn("place", place).withColumn("p0", _chance(F.lit(0), F.col("total"), F.col("v"))), "groups")
        #: (lang, source, place, term, n, p, p0, q): a group's terms with their probabilities there and in the language
        self.entries = stored(flat.join(self.groups, ["lang", "source"]).select("lang", "source", "place", "term", "n", _chance(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", _chance(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "entries")


# ------------------------------------------------------------------ terms


def top_terms(counts: Counts, k: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank): the k terms of each group with the largest divergence above its language."""
    group = ["lang", "source"]
    above = counts.entries.where("p > q")
    buckets = above.groupBy(*group, "n").agg(F.max("p").alias("p"), F.min("q").alias("low")).withColumn("bound", _gap(F.col("p"), F.col("low")))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("bound"), "n"))  # a group's distinct counts
    ordered = stored(buckets.select(*group, "n", "bound", turn.alias("turn")), "buckets")
    best = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    done, first, size, found = 0, None, FIRST, None
    kth = None
    while True:
        batch = ordered.where((F.col("turn") > done) & (F.col("turn") <= done + size))
        if kth is not None:  # groups whose next bound may still reach the k-th value
            batch = batch.join(kth, group, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select(*ordered.columns)
        values = above.join(batch.select(*group, "n"), [*group, "n"], "left_semi").select(*group, "term", _gap(F.col("p"), F.col("q")).alias("value"))
        pool = values if found is None else found.drop("rank").unionByName(values)
        found = cut(pool.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        done, size = done + size, size * GROW
        kth = found.where(F.col("rank") == k).select(*group, F.col("value").alias("least"))
        left = ordered.where(F.col("turn") > done).join(kth, group, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        if left.isEmpty():
            return found


# ------------------------------------------------------------------ pairs


def _both(block: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of one block pair in, sums over the terms that both sources have out, per task."""
    schema = pa.schema([("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("part", pa.int64())])
    sums: dict[tuple, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, bi, bj), total in sums.items():
            x, y = np.nonzero(np.triu(total, 1) if bi == bj else total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x + bi * block), pa.array(y + bj * block), pa.array(total[x, y])], schema=schema)
        sums.clear()

    for batch in batches:
        for lang, bi, bj, places, ps, zeros in zip(*[batch.column(i).to_pylist() for i in range(3)], *[batch.column(i) for i in range(3, 6)]):
            place, p, z = (a.values.to_numpy(zero_copy_only=False).astype(np.int64) for a in (places, ps, zeros))
            key = (lang, bi, bj)
            if key not in sums:
                if len(sums) >= ARRAYS:
                    yield from flushed()
                sums[key] = np.zeros((block, block), np.int64)
            a, b = place // block == bi, place // block == bj
            p1, z1, p2, z2 = p[a, None], z[a, None], p[None, b], z[None, b]
            part = _gaps(p1, p2) - _gaps(p1, z2) - _gaps(z1, p2) + _gaps(z1, z2)
            sums[key][np.ix_(place[a] % block, place[b] % block)] += part
    yield from flushed()


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's histogram beside a block of other groups: sums as if those had none of its terms."""
    schema = pa.schema([("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("part", pa.int64())])
    for batch in batches:
        for lang, x, ps, ns, ys, zs in zip(*[batch.column(i).to_pylist() for i in range(2)], *[batch.column(i) for i in range(2, 6)]):
            p, n, y, z = (a.values.to_numpy(zero_copy_only=False).astype(np.int64) for a in (ps, ns, ys, zs))
            total = np.zeros(len(y), np.int64)
            for at in range(0, len(p), 1024):
                total += (_gaps(p[at : at + 1024, None], z[None, :]) * n[at : at + 1024, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(y), pa.string()), pa.array([x] * len(y), pa.int64()), pa.array(y), pa.array(total)], schema=schema)


def pairs(counts: Counts, block: int = BLOCK) -> DataFrame:
    """(lang, x, y, value): divergence of places x and y of a language, x <> y, summed over all kept terms."""
    lists = counts.entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", "p0"))).alias("e"))
    blocks = F.array_distinct(F.transform("e.place", lambda i: F.floor(i / block).cast("bigint")))
    grid = lists.withColumn("b", blocks).withColumn("i", F.explode("b")).withColumn("j", F.explode("b")).where("i <= j")
    schema = "lang string, x bigint, y bigint, part bigint"
    both = grid.select("lang", "i", "j", F.col("e.place").alias("place"), F.col("e.p").alias("p"), F.col("e.p0").alias("p0")).mapInArrow(partial(_both, block), schema)
    histograms = counts.entries.groupBy("lang", "place", "p").agg(F.count("*").alias("n")).groupBy("lang", "place").agg(F.collect_list(F.struct("p", "n")).alias("h"))
    others = counts.groups.where("v > 0").groupBy("lang", F.floor(F.col("place") / block).alias("b")).agg(F.collect_list(F.struct("place", "p0")).alias("o"))
    beside = histograms.join(others, "lang").select("lang", F.col("place").cast("bigint").alias("x"), F.col("h.p").alias("p"), F.col("h.n").alias("n"), F.col("o.place").alias("y"), F.col("o.p0").alias("z")).mapInArrow(_alone, schema)
    directed = both.unionByName(beside)
    half = directed.where("x <> y").select("lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "part").groupBy("lang", "x", "y").agg(F.sum("part").alias("part"))
    g = counts.groups
    left = g.select("lang", F.col("place").alias("x"), F.col("held").alias("hx"), F.col("p0").alias("zx"), "v")
    right = g.select("lang", F.col("place").alias("y"), F.col("held").alias("hy"), F.col("p0").alias("zy"))
    # the pairs of a language's sources are the result itself
    every = left.join(right, "lang").where("x < y")
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("hx") - F.col("hy")) * _gap(F.col("zx"), F.col("zy"))).otherwise(0)
    full = every.join(half, ["lang", "x", "y"], "left").select("lang", "x", "y", (F.coalesce("part", F.lit(0)) + neither).cast("bigint").alias("value"))
    return full.select("lang", F.inline(F.array(F.struct("x", "y", "value"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "value"))))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language by divergence, and the k most telling terms."""
    counts = Counts(docs, min_docs)
    names = counts.groups.select("lang", "place", "source")
    pair = pairs(counts, block).join(names.withColumnRenamed("place", "x"), ["lang", "x"]).join(names.select("lang", F.col("place").alias("y"), F.col("source").alias("item")), ["lang", "y"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # a language's sources
    first = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    second = top_terms(counts, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return first.unionByName(second)
