"""Mixing sources to target weights by drawing fixed-length blocks.

The words of each source are packed, document after document, into blocks of
`block_len`. Output shards draw how many of their slots each source fills from
multinomials whose probabilities follow the source's remaining quota, so the
draws of all shards add up to it: the slots of a range of shards are split
between its halves, and so on down to single shards, each split seeded by its
range, so any task draws its shards alone. Slot t of a source takes the block
that a keyed permutation of its block numbers assigns to t (a new permutation
for each epoch, so a block is never taken more than ceil(t / blocks) times),
and blocks are joined to slots by their number.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and
share the total size; no target exceeds `limit` times its source, the excess is
shared again by weight (closed form: the least level at which the capped shares
add up).

Scale: texts are read once for their sizes; only (id, source, size) rows and
block numbers are shuffled. Word offsets are prefix sums in parts of some
CHUNK_ROWS rows, so a source with a third of all rows is many windows, not one.
The driver holds one row per source; shards are drawn inside the tasks.

Defined cases: null, empty and wordless texts have size 0 and take nothing; a
source without words has target 0; a null source is a source of its own, in the
last place; repeated rows are packed as separate documents; a very long text is cut
into many blocks; an empty table gives an empty result; extra columns, also of
clashing names, are ignored by `report` and carried by `mix`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .permutation import feistel
from .shared import buckets, cut, fresh, keyed, row_uid

BLOCK_LEN = 256
SHARD_SLOTS = 4096
#: rows of a source that one running total covers, and output shards that one task draws
CHUNK_ROWS = 50_000
TASK_SHARDS = 16
LIMIT = 3
SEED = 11


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, uid, size) of each row."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            data, offsets = K.utf8(part.column("text"))
            *_, rows = K.words(data, offsets, K.BLANK_SEPARATED)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("uid"), pa.array(np.diff(rows))], ["doc_id", "source", "uid", "size"])

    return source.select("doc_id", "source", row_uid().alias("uid"), "text").mapInArrow(kernel, "doc_id bigint, source string, uid bigint, size bigint")


def targets(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, source_no, source_size, rows, weight, target): one row per source."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weighed = per_source.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("source_no") % 3 + 1).cast("double"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("ratio", "source_no")
    level = (
        weighed.withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(limit * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_no", "level"))).over(everything))
    )
    share = F.coalesce(F.col("first.level") * F.col("weight"), F.lit(0.0))
    return level.select("source", "source_no", "source_size", "rows", "weight", F.least(share, limit * F.col("source_size").cast("double")).alias("target"))


def draws(quota: np.ndarray, shard_slots: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(shard, source, first slot of the source, slots, first place in the shard) of the shards [low, high)."""
    total = int(quota.sum())
    shards = -(-total // shard_slots)
    high = shards if high is None else high

    def split(left: np.ndarray, at: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Shards [a, b) take all of `left`, from slot `at` of each source on."""
        if b <= low or a >= high:
            return
        if b - a == 1:
            place = 0
            for s in np.flatnonzero(left).tolist():
                yield a, s, int(at[s]), int(left[s]), place
                place += int(left[s])
            return
        middle = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        take = np.zeros_like(left)
        while (missing := (middle - a) * shard_slots - int(take.sum())) > 0:
            room = left - take
            take += np.minimum(rng.multinomial(missing, room / room.sum()), room)
        yield from split(take, at, a, middle)
        yield from split(left - take, at + take, middle, b)

    if shards:
        yield from split(quota, np.zeros_like(quota), 0, shards)


def plan(sized: DataFrame, *, block_len: int = BLOCK_LEN, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, slots, pieces).

    slots: shard, slot, source_no, block. pieces: one row per document and block
    it lies in: doc_id, uid, source, source_no, source_size, target, size,
    position (of the document in its source), block, piece_start (word in the
    document), piece_len; a document of size 0 has one row with a null block.
    """
    spark = sized.sparkSession
    goal = cut(targets(sized, limit))
    rows = sorted(goal.select("source_no", "source_size", "target").collect())
    size = np.array([r.source_size for r in rows], np.int64)
    blocks = -(-size // block_len)
    quota = np.array([round(r.target * int(b) / r.source_size) if r.source_size else 0 for r, b in zip(rows, blocks)], np.int64)
    quota = np.minimum(quota, limit * blocks)
    block_counts, shards = blocks.tolist(), -(-int(quota.sum()) // shard_slots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                for shard, source, first, count, place in draws(quota, shard_slots, seed, task * TASK_SHARDS, min((task + 1) * TASK_SHARDS, shards)):
                    n = block_counts[source]
                    t = np.arange(first, first + count)
                    block = feistel(t % n, n, K.mix(np.uint64(seed) + (t // n).astype(np.uint64) * np.uint64(1 << 32) + np.uint64(source + 1)))
                    slot = feistel(place + np.arange(count), shard_slots, K.mix(np.array([seed + 7919 * (shard + 1)], np.uint64))[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard)), pa.array(slot), pa.array(np.full(count, source, np.int32)), pa.array(block)], ["shard", "slot", "source_no", "block"])

    tasks = -(-shards // TASK_SHARDS)
    slots = spark.range(0, tasks, 1, max(1, min(tasks, buckets(spark)))).mapInArrow(assign, "shard bigint, slot bigint, source_no int, block bigint")

    chunk = F.pmod(F.col("uid"), F.ceil(F.col("rows") / CHUNK_ROWS))
    placed = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select(sized["*"], "source_no", "source_size", "rows", "target").withColumn("chunk", chunk)
    totals = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per CHUNK_ROWS rows of the source
    bases = totals.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["source_no", "chunk"]).withColumn("position", F.col("base") + F.col("inner"))
    last = F.floor((F.col("position") + F.col("size") - 1) / block_len)
    numbered = at.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("position") / block_len), last))))
    start = F.greatest(F.col("block") * block_len, F.col("position"))
    stop = F.least((F.col("block") + 1) * block_len, F.col("position") + F.col("size"))
    pieces = numbered.select("doc_id", "uid", "source", "source_no", "source_size", "target", "size", "position", "block", (start - F.col("position")).alias("piece_start"), (stop - start).alias("piece_len"))
    return goal, slots, pieces


def picked(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """`pieces` with `picks`, how often the mix takes their block."""
    picks = slots.groupBy("source_no", "block").agg(F.count("*").alias("picks"))
    # the planner only sees the few drawn rows that the slots come from: keep it from broadcasting them
    return pieces.join(picks.hint("merge"), ["source_no", "block"], "left").withColumn("picks", F.coalesce("picks", F.lit(0)))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted)."""
    sized = cut(sizes(docs))
    _, slots, pieces = plan(sized, **options)
    rows = picked(slots, pieces).groupBy("source_no", "position", "uid", "doc_id", "size", "source_size", "target")
    mixed = rows.agg(F.sum(F.coalesce(F.col("picks") * F.col("piece_len"), F.lit(0))).alias("taken"), F.count(F.when(F.col("size") == 0, 1)).alias("empty"))
    # rows of size 0 share their position: identical ones are counted, not told apart
    copies = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("empty").cast("int"))))
    return mixed.withColumn("copy", copies).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mixture as rows of `docs`: one row per document and time that the mix takes any of its blocks.

    Copy c of a document holds the words of its blocks taken at least c times;
    where that is all of them the text is unchanged.
    """
    sized = cut(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    _, slots, pieces = plan(sized, **options)
    docs_keyed, key = keyed(docs, id_col, text_col)
    taken = fresh(docs_keyed, "pieces")
    wanted = picked(slots, pieces).where("picks > 0").groupBy("uid", "position").agg(F.collect_list(F.struct("piece_start", "piece_len", "picks")).alias(taken)).select(F.col("uid").alias(key), taken)
    joined = docs_keyed.dropDuplicates([key]).join(wanted, key)
    columns = docs.columns
    place = columns.index(text_col)
    count = columns.index(chars_col) if chars_col in columns else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text_col):
            index, texts = [], []
            for i, (text, found) in enumerate(zip(part.column(text_col).to_pylist(), part.column(taken).to_pylist())):
                words = text.encode().split()
                for c in range(1, max(p["picks"] for p in found) + 1):
                    spans = sorted((p["piece_start"], p["piece_len"]) for p in found if p["picks"] >= c)
                    index.append(i)
                    whole = sum(n for _, n in spans) == len(words)
                    texts.append(text if whole else b" ".join(w for a, n in spans for w in words[a : a + n]).decode())
            rows = part.drop_columns([taken]).take(pa.array(index, pa.int64()))
            arrays = list(rows.columns)
            arrays[place] = pa.array(texts, arrays[place].type)
            if count is not None:
                arrays[count] = pa.array([len(t) for t in texts], arrays[count].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=rows.schema)

    return joined.select(*columns, taken).mapInArrow(kernel, docs.schema)
