"""N-gram Jaccard self-join by T-occurrence search over inverted lists.

Two documents link when their sets of distinct `k`-word shingles have a Jaccard
similarity of at least 3/4; the result is the connected component of each.

1. Sieve. Half of the hash space is counted: which shingles does another
   document have? A partner holds at least ceil(3n/4) of a document's n
   shingles, so at most floor(n/4) of the counted half may be its own. All
   documents beyond that are alone, without any loss.
2. Copies. Documents with equal sets become one class; its least row stands for it.
3. T-occurrence search among the classes. Inverted lists are ordered by length.
   A class with s shared shingles needs T = ceil(3n/4) occurrences. DivideSkip:
   its L longest lists are set aside and the others, the short ones, are merged
   by heap for each query; whoever occurs fewer than T - L times cannot reach T
   and goes. L is chosen by cost: T - HITS where the lists that this adds to the
   merge hold LONG entries at most, T - 1 where they are longer than the probes
   they would save. What is left is probed in the long lists, by
   binary search of the query's shingles in the candidate's sorted set, and kept
   if it reaches the overlap that the pair requires. Rows of a list that no
   size in that list lets reach the overlap are left out before the lists are
   met with each other, so a template that many pages share, and that alone
   makes no link, costs its length and not its square.
4. Components (`report`), in rounds. First each short list is searched only for
   the member with the fewest shingles of its own (of a family of copies, the
   original), and each query probes the candidate that most of its lists hold:
   one pair per query, whatever the lists' lengths. What that links is one
   component; this repeats while it links anything (STAR_ROUNDS at most). Then
   the lists that still touch several components are searched for all members of
   other components. Every link between different components is found and links
   inside one change nothing, so the components are exact while a list of m
   copies costs m, not m * m, candidates.

`links` gives every link between classes and the members of each class instead;
it is as large as its result, m * m for a family of m near copies.

Shingles are 64-bit hashes, rows keys of 64 bits. Records of the sieve travel as
blobs by hash bucket.

Defined cases: a text of fewer than `k` words has one shingle, the whole
sequence; without words the set is empty and links with nothing; identical rows
are one class, and texts with equal sets link; a null id never names a component
unless all ids in it are null; a very long text is one set, held by one task at
a time; an empty table gives an empty result; extra columns, also of clashing
names, are ignored by `report` and carried by `representatives`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import buckets, cut, keyed, row_uid, stored

SHINGLE = 5
STAR_ROUNDS = 4
#: occurrences in the short lists that a candidate needs, T - L, where the lists are of at most LONG entries
HITS = 3
LONG = 32
#: parts that the rows of one component are dealt to
SALT = 16
LAST = np.iinfo(np.int64).max
SETS = "uid bigint, doc_id bigint, n int, digest binary, shingles binary"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.select("doc_id", "text", row_uid().alias("uid"))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows, one after another, and the row offsets."""
    data, offsets = K.utf8(column)
    data = K.LOWER[data]
    starts, ends, rows = K.words(data, offsets, K.BLANK_SEPARATED)
    hashes = K.word_hashes(data, starts, ends)
    at = K.window_starts(rows, k)
    values, owner = K.ngrams(hashes, k)[at], K.row_of(at, rows)
    sizes = np.diff(rows)
    for n in range(1, k):
        few = np.flatnonzero(sizes == n)
        if len(few):
            values = np.concatenate([values, K.ngrams(hashes, n)[rows[few]]])
            owner = np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(column) + 1))


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(values ^ np.uint64(0x10C)) >> np.uint64(32)) % np.uint64(n)


def _shared_counts(source: DataFrame, k: int, n: int) -> DataFrame:
    """(uid, shared): how many shingles of the lower half of the hash space another document has as well."""
    schema, counted = K.Spool.schema(1, [4]), K.Spool.schema(1, [])
    blob = K.arrow_schema(counted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = K.Spool(n, [4])
        for part in K.slices(batches, "text"):
            values, offsets = shingle_sets(part.column("text"), k)
            low = np.flatnonzero(values >> np.uint64(63) == 0)
            values, row = values[low], np.searchsorted(offsets, low, "right") - 1
            yield from spool.add(_bucket(values, n), [part.column("uid").to_numpy()[row]], [values & np.uint64(0xFFFFFFFF)])
        yield from spool.flush()

    def shared(table: pa.Table) -> pa.Table:
        (uid,), (value,) = K.Spool.read(table, 1, [4])
        order = np.lexsort((uid, value))
        uid, value = uid[order], value[order]
        fresh = np.ones(len(uid), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (uid[1:] != uid[:-1])
        uid, value = uid[fresh], value[fresh]
        _, sizes = K.runs(value)
        uid = np.sort(uid[np.repeat(sizes > 1, sizes)])
        spool = K.Spool(n, [], limit=1 << 62)
        list(spool.add(_bucket(uid.view(np.uint64), n), [uid], []))
        return K.table_of(spool.flush(), blob)

    def gather(table: pa.Table) -> pa.Table:
        (uid,), _ = K.Spool.read(table, 1, [])
        uid = np.sort(uid)
        starts, sizes = K.runs(uid)
        return pa.Table.from_arrays([pa.array(uid[starts]), pa.array(sizes)], ["uid", "shared"])

    found = source.mapInArrow(emit, schema).groupBy("bucket").applyInArrow(shared, counted)
    return found.groupBy("bucket").applyInArrow(gather, "uid bigint, shared bigint")


def _sets(joined: DataFrame, k: int) -> DataFrame:
    """A row per document with the size of its set, and the set and its digest where it may have a partner."""
    arrow = K.arrow_schema(SETS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            values, offsets = shingle_sets(part.column("text"), k)
            low = np.concatenate(([0], np.cumsum(values >> np.uint64(63) == 0)))
            n, half = np.diff(offsets), low[offsets[1:]] - low[offsets[:-1]]
            shared = part.column("shared").fill_null(0).to_numpy(zero_copy_only=False)
            keep = (n > 0) & (half - shared <= n // 4)
            blobs = [values[offsets[i] : offsets[i + 1]].astype("<u8").tobytes() if keep[i] else None for i in range(len(part))]
            columns = [part.column("uid"), part.column("doc_id"), pa.array(n.astype(np.int32)), K.binary_array([b and hashlib.sha256(b).digest()[:16] for b in blobs]), K.binary_array(blobs)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(kernel, SETS)


def _postings(classes: DataFrame, n: int) -> DataFrame:
    """Short inverted lists: (token, uid, n, s, rank, need) with s shared tokens per class, the token's rank among them, and T - L."""
    schema, reply = K.Spool.schema(1, [8]), K.Spool.schema(1, [8, 4])
    blob = K.arrow_schema(reply)
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = K.Spool(n, [8])
        for part in K.slices(batches, "shingles"):
            data, offsets = K.utf8(part.column("shingles"))
            values = np.frombuffer(data.tobytes(), "<u8")
            uid = np.repeat(part.column("uid").to_numpy(), np.diff(offsets) // 8)
            yield from spool.add(_bucket(values, n), [uid], [values])
        yield from spool.flush()

    def lengths(table: pa.Table) -> pa.Table:
        (uid,), (value,) = K.Spool.read(table, 1, [8])
        order = np.argsort(value, kind="stable")
        uid, value = uid[order], value[order]
        _, sizes = K.runs(value)
        length = np.repeat(sizes, sizes)
        uid, value, length = uid[length > 1], value[length > 1], length[length > 1]
        order = np.argsort(uid, kind="stable")
        uid = uid[order]
        spool = K.Spool(n, [8, 4], limit=1 << 62)
        list(spool.add(_bucket(uid.view(np.uint64), n), [uid], [value[order], np.minimum(length[order], 0xFFFFFFFF).astype(np.uint64)]))
        return K.table_of(spool.flush(), blob)

    def gather(table: pa.Table) -> pa.Table:
        (uid,), (value, length) = K.Spool.read(table, 1, [8, 4])
        order = np.lexsort((value, length, uid))
        uid, value, length = uid[order], value[order], np.ascontiguousarray(length[order])
        starts, sizes = K.runs(uid)
        rank = np.arange(len(uid)) - np.repeat(starts, sizes)
        return pa.Table.from_arrays([pa.array(value.view(np.int64)), pa.array(uid), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(length.view(np.int64))], ["token", "uid", "s", "rank", "length"])

    found = classes.select("uid", "shingles").mapInArrow(emit, schema).groupBy("bucket").applyInArrow(lengths, reply)
    ranked = found.groupBy("bucket").applyInArrow(gather, "token bigint, uid bigint, s int, rank int, length bigint")
    # T = ceil(3n/4); the L longest lists of a class are set aside
    sized = ranked.join(classes.select("uid", "n"), "uid").where(f"rank < s - ceil(3 * n / 4D) + {HITS}")
    longest = F.max("length").over(Window.partitionBy("uid"))  # lists of one class
    chosen = sized.withColumn("need", F.when(longest <= LONG, HITS).otherwise(1))
    return chosen.where("rank < s - ceil(3 * n / 4D) + need").select("token", "uid", "n", "s", "rank", "need")


def _heap_merge(lists: DataFrame) -> DataFrame:
    """(x, need, token, y) rows -> candidates (x, y, hits) of at least `need` hits per query x, by heap merge of its lists."""
    out = K.arrow_schema("x bigint, y bigint, hits bigint")

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[np.ndarray]]]:
        """Each query with its lists, as they come sorted; 8 bytes an entry."""
        query = token = None
        found: list[np.ndarray] = []
        for batch in batches:
            xs, needs, ts, ys = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((xs[1:] != xs[:-1]) | (needs[1:] != needs[:-1]) | (ts[1:] != ts[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(xs)]):
                if a == b:
                    continue
                if (xs[a], needs[a]) != query:
                    if found:
                        yield query, found
                    query, token, found = (int(xs[a]), int(needs[a])), None, []
                if ts[a] == token:
                    found[-1] = np.concatenate((found[-1], ys[a:b]))
                else:
                    found.append(ys[a:b].copy())
                token = ts[a]
        if found:
            yield query, found

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []

        def batch():
            columns = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

        for (x, need), merged in queries(batches):
            last, hits = None, 0
            for y in heapq.merge(*map(memoryview, merged)):
                if y == last:
                    hits += 1
                    continue
                if hits >= need:
                    found.append((x, last, hits))
                last, hits = y, 1
                if len(found) >= 1 << 14:
                    yield batch()
                    found = []
            if hits >= need:
                found.append((x, last, hits))
        yield batch()

    return lists.select("x", F.col("need").cast("bigint"), "token", "y").repartition("x").sortWithinPartitions("x", "need", "token", "y").mapInArrow(kernel, "x bigint, y bigint, hits bigint")


def _probe(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates that reach the overlap: binary search of one class's tokens in the other's sorted set."""
    out = K.arrow_schema("u bigint, v bigint")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"))):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
                overlap = int((b[spot] == a).sum())
                keep[i] = 100 * overlap >= 75 * (len(a) + len(b) - overlap)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep)], schema=out)

    first = pairs.join(classes.select(F.col("uid").alias("x"), F.col("shingles").alias("a")), "x")
    both = first.join(classes.select(F.col("uid").alias("y"), F.col("shingles").alias("b")), "y")
    return both.select("x", "y", "a", "b").mapInArrow(kernel, "u bigint, v bigint")


#: the largest partner that a row's class can link with, if this token is one of the first `need` that they share
_ROOM = "CAST(floor(7 * (s - rank + need - 1) / 3D) AS BIGINT) - n"
_REACHABLE = "7L * (least(a.s - a.rank, b.s - b.rank) + least(a.need, b.need) - 1) >= 3L * (a.n + b.n)"


def _reachable(rows: DataFrame) -> DataFrame:
    """Rows of lists of several components that some size in their list lets reach an overlap, with their `room`."""
    sized = rows.withColumn("room", F.expr(_ROOM))
    per_list = sized.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("smallest"), F.max("room").alias("widest")).where("c0 <> c1").drop("c0", "c1")
    return sized.join(per_list, "token").where("smallest <= room AND n <= widest").drop("smallest", "widest")


def _links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): the links between classes of different components in `rows`."""
    left = cut(_reachable(rows))
    pairs = left.alias("a").join(left.alias("b"), F.expr(f"a.token = b.token AND a.component < b.component AND {_REACHABLE}"))
    return cut(_probe(_heap_merge(pairs.select(F.col("a.uid").alias("x"), F.least("a.need", "b.need").alias("need"), F.col("a.token").alias("token"), F.col("b.uid").alias("y"))), classes))


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("part")


def indexed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes uid, doc_id, n of all rows; members uid -> head class; classes with their sets; short inverted lists)."""
    source = _source(docs, id_col, text_col)
    n = buckets(docs.sparkSession)
    counts = _shared_counts(source, k, n)
    sets = stored(_sets(source.join(counts, "uid", "left").select("uid", "doc_id", "text", "shared"), k), "sets")
    sizes = sets.select("uid", "doc_id", F.col("n").cast("bigint").alias("n_shingles"))
    survivors = sets.where("digest IS NOT NULL")
    light = survivors.select("uid", "doc_id", "digest")
    # rows of a set with many copies are dealt to SALT parts; a set of one row is its own head
    shared = light.groupBy("digest").agg(F.min("uid").alias("head"), F.max("uid").alias("other")).where("head <> other").select("digest", "head", _parts())
    members = cut(light.withColumn("part", F.pmod("uid", F.lit(SALT))).join(shared, ["digest", "part"], "left").select("uid", "doc_id", F.coalesce("head", "uid").alias("head")).distinct())
    heads = members.select(F.col("head").alias("uid")).distinct()
    classes = stored(survivors.join(heads, "uid").dropDuplicates(["uid"]).select("uid", "n", "shingles"), "classes")
    return sizes, members, classes, stored(_postings(classes, n), "lists")


def links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(u, v): every link between classes; (uid, doc_id, head): the rows of each class, named by its head."""
    _, members, classes, lists = indexed(docs, **options)
    return _links(_labelled(lists, None), classes), members


def classes_and_links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of all rows, members uid -> class uid, components node -> component over class uids)."""
    sizes, members, classes, lists = indexed(docs, **options)
    labels = None  # every class is its own component at first
    for _ in range(STAR_ROUNDS):
        labelled = _labelled(lists, labels)
        least = labelled.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "uid", "n", "s", "rank", "need", "component")).alias("lead"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        leads = least.where("c0 <> c1").select("token", "lead.*")
        star = labelled.alias("a").join(leads.alias("b"), F.expr(f"a.token = b.token AND a.component <> b.component AND {_REACHABLE}"))
        candidates = _heap_merge(star.select(F.col("a.uid").alias("x"), F.lit(1).alias("need"), F.col("a.token").alias("token"), F.col("b.uid").alias("y")))
        best = candidates.groupBy("x").agg(F.max(F.struct("hits", "y")).alias("best")).select("x", "best.y")
        found = cut(_probe(best, classes))
        if found.isEmpty():
            break
        labels = _relabelled(labels, found)
    found = _links(_labelled(lists, labels), classes)
    if not found.isEmpty():
        labels = _relabelled(labels, found)
    if labels is None:
        labels = lists.select(F.col("uid").alias("node"), F.col("uid").alias("component")).limit(0)
    return sizes, members, labels


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`lists` with the component of each class; one that links have not reached is its own."""
    if labels is None:
        return lists.withColumn("component", F.col("uid"))
    return lists.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of all classes that links have reached so far."""
    if labels is None:
        return cut(components(links))
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    named = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = named.select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")).distinct()
    merged = cut(components(between))
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = labels.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    # a component's name is its least class, which is a node of its own
    return cut(old.unionByName(merged).groupBy("node").agg(F.min("component").alias("component")))


def _by_component(members: DataFrame, labels: DataFrame, best) -> DataFrame:
    """`members` with `best` (an aggregate) of their component; a component's rows are dealt to SALT parts."""
    placed = members.join(labels.withColumnRenamed("node", "head"), "head", "left").select("uid", "doc_id", F.coalesce("component", "head").alias("component"))
    found = placed.groupBy("component").agg(best.alias("best")).select("component", "best", _parts())
    return placed.withColumn("part", F.pmod("uid", F.lit(SALT))).join(found, ["component", "part"])


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id that links reach)."""
    sizes, members, labels = classes_and_links(docs, **options)
    found = _by_component(members, labels, F.min("doc_id")).groupBy("uid").agg(F.min("best").alias("component_id"))
    return sizes.join(found, "uid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each component left: the least by (id, key); identical rows keep one."""
    _, members, labels = classes_and_links(docs, id_col=id_col, text_col=text_col, k=k)
    docs_keyed, key = keyed(docs, id_col, text_col)
    placed = _by_component(members, labels, F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("uid").alias("u"))))
    losers = placed.where(F.col("uid") != F.col("best.u")).select(F.col("uid").alias(key)).distinct()
    return docs_keyed.join(losers, key, "left_anti").dropDuplicates([key]).select(*docs.columns)
