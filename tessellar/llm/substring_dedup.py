"""Removal of word sequences that an earlier document holds, over a compacted De Bruijn graph.

The edges of the graph are the windows of `k` words, its nodes the (k - 1)-word
overlaps. Only edges that at least two documents hold matter:

1. Sift. Each window has a minimiser, the least hash of the sub-windows in it.
   Equal windows have equal minimisers, so windows whose minimiser no other
   document has are unique and go no further.
2. Edges. The other windows are gathered by hash: how often an edge occurs, the
   least document that holds it, and whether all its occurrences continue alike.
3. Compaction. Neighbouring edges that continue alike, occur equally often and
   have one source lie on one nonbranching path. Each document cuts its edges
   into such paths, keyed by a digest of their words; a Spark aggregation makes
   one row of all occurrences of a path (`unitigs` also lists its source).
4. Verification. A path with an occurrence in the source document is proven by
   content. Edges that the hash calls repeated but whose path has none there
   (cut differently) are proven window by window: digests of their words are
   joined with those of the source document.

Records travel as blobs by hash bucket (a few bytes per window), so a shuffle
row costs little and no task holds more than a bucket. Text is exchanged once,
by row key, and that exchange is reused by all later steps. There are no caps:
an edge of any frequency is one record per occurrence.

Defined cases: a null text has no words; a very long text is one slice of a task; texts under `k` words keep everything;
a null id counts as larger than every other and equal to other nulls; rows with
one id never remove each other's words; identical rows get identical results;
an empty table gives an empty result; extra columns, also of clashing names, are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import buckets, cut, row_uid, stored

WINDOW = 13
SUB = 7
LAST = np.iinfo(np.int64).max

SIFT = [6]
EDGES = [8, 4, 4]
MARKS = [4, 5, 1, 8]
FLAGGED = "uid bigint, sieve binary"
REPLY = "uid bigint, marks binary"
PATH = "start int, windows int, k0 bigint, k1 bigint, later boolean, source bigint"
PATHS = "uid bigint, doc_id bigint, spans array<struct<start:int,stop:int>>, paths array<struct<start:int,windows:int,k0:bigint,k1:bigint,later:boolean,source:bigint>>"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.select("doc_id", "text", row_uid().alias("uid"))


def _ids(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).fill_null(LAST).to_numpy(zero_copy_only=False)


def _word_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.utf8(part.column("text"))
    starts, ends, rows = K.words(data, offsets, K.BLANK_SEPARATED)
    return K.word_hashes(data, starts, ends), rows


def _minimisers(hashes: np.ndarray, rows: np.ndarray, k: int, sub: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of k words, and the low 48 bits of its minimiser."""
    at = K.window_starts(rows, k)
    grams = K.ngrams(hashes, sub) & np.uint64((1 << 48) - 1)
    least = grams[at]
    for j in range(1, k - sub + 1):
        np.minimum(least, grams[at + j], out=least)
    return at, least


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return K.mix(values ^ np.uint64(0xB0C3)) % np.uint64(n)


def _regroup(df: DataFrame, widths: list[int], schema: str, name: str) -> DataFrame:
    """Blob rows by hash bucket -> blob rows by document bucket -> one row per document: its records, byte planes joined."""
    arrow = K.arrow_schema(schema)

    def gather(table: pa.Table) -> pa.Table:
        (uid,), values = K.Spool.read(table, 1, widths)
        order = np.argsort(uid, kind="stable")
        uid, values = uid[order], [v[order] for v in values]
        starts, sizes = K.runs(uid)
        blobs = [b"".join(K.pack_bytes(v[a : a + n], w) for v, w in zip(values, widths)) for a, n in zip(starts.tolist(), sizes.tolist())]
        return pa.Table.from_arrays([pa.array(uid[starts]), K.binary_array(blobs)], schema=arrow)

    return df.groupBy("bucket").applyInArrow(gather, schema)


def _unpack(blob: bytes, widths: list[int]) -> list[np.ndarray]:
    n, out, at = len(blob) // sum(widths), [], 0
    for w in widths:
        out.append(K.unpack_bytes(blob[at : at + n * w], w))
        at += n * w
    return out


def _sift(source: DataFrame, k: int, sub: int, n: int) -> DataFrame:
    """Step 1: per document the minimisers that another document has as well."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = K.Spool(n, SIFT)
        for part in K.slices(batches, "text"):
            hashes, rows = _word_hashes(part)
            if len(hashes) < k:
                continue
            at, least = _minimisers(hashes, rows, k, sub)
            row = K.row_of(at, rows)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            row, least = row[fresh], least[fresh]
            order = np.lexsort((least, row))
            row, least = row[order], least[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            row, least = row[fresh], least[fresh]
            yield from spool.add(_bucket(least, n), [_ids(part, "uid")[row]], [least])
        yield from spool.flush()

    def shared(table: pa.Table) -> pa.Table:
        (uid,), (value,) = K.Spool.read(table, 1, SIFT)
        order = np.argsort(value, kind="stable")
        uid, value = uid[order], value[order]
        starts, sizes = K.runs(value)
        several = np.zeros(0, bool) if not len(starts) else np.minimum.reduceat(uid, starts) != np.maximum.reduceat(uid, starts)
        keep = np.repeat(several, sizes)
        uid, value = uid[keep], value[keep]
        order = np.argsort(uid, kind="stable")
        uid, value = uid[order], value[order]
        spool = K.Spool(n, SIFT, limit=1 << 62)
        list(spool.add(_bucket(uid.view(np.uint64), n), [uid], [value]))
        return K.table_of(spool.flush(), blob)

    schema = K.Spool.schema(1, SIFT)
    blob = K.arrow_schema(schema)
    found = source.mapInArrow(emit, schema).groupBy("bucket").applyInArrow(shared, schema)
    return _regroup(found, SIFT, FLAGGED, "sieve")


def _edges(sifted: DataFrame, k: int, sub: int, n: int, print_bits: int) -> DataFrame:
    """Step 2: per document its repeated edges, as (position, occurrences, flags, source row)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = K.Spool(n, EDGES, 2)
        for part in K.slices(batches, "text"):
            hashes, rows = _word_hashes(part)
            if len(hashes) < k:
                continue
            at, least = _minimisers(hashes, rows, k, sub)
            row = K.row_of(at, rows)
            keep = np.zeros(len(at), bool)
            bounds = np.searchsorted(row, np.arange(len(part) + 1))
            for i, blob in enumerate(part.column("sieve")):
                a, b = bounds[i], bounds[i + 1]
                if b > a:
                    sieve = np.sort(K.unpack_bytes(blob.as_py(), 6))
                    spot = np.minimum(np.searchsorted(sieve, least[a:b]), len(sieve) - 1)
                    keep[a:b] = sieve[spot] == least[a:b]
            at, row = at[keep], row[keep]
            edge = K.ngrams(hashes, k)[at]
            following = np.append(hashes, np.uint64(0))[at + k]
            # the word after the edge, or its absence, as a fingerprint
            following = np.where(at + k < rows[row + 1], following | np.uint64(1), np.uint64(0)) & np.uint64((1 << print_bits) - 1)
            yield from spool.add(_bucket(edge, n), [_ids(part, "uid")[row], _ids(part, "doc_id")[row]], [edge, following, (at - rows[row]).astype(np.uint64)])
        yield from spool.flush()

    def gather(table: pa.Table) -> pa.Table:
        (uid, doc), (edge, following, at) = K.Spool.read(table, 2, EDGES)
        order = np.lexsort((uid, doc, edge))
        uid, doc, edge, following, at = uid[order], doc[order], edge[order], following[order], at[order]
        starts, sizes = K.runs(edge)
        if not len(starts):
            return K.table_of([], blob)
        keep = np.repeat(np.minimum.reduceat(uid, starts) != np.maximum.reduceat(uid, starts), sizes)
        branching = np.repeat(np.minimum.reduceat(following, starts) != np.maximum.reduceat(following, starts), sizes)
        first = np.repeat(starts, sizes)
        flags = branching.astype(np.uint64) | ((doc > doc[first]).astype(np.uint64) << np.uint64(1))
        uid, at, count, flags, source = uid[keep], at[keep], np.repeat(sizes, sizes)[keep].astype(np.uint64), flags[keep], uid[first][keep].view(np.uint64)
        order = np.lexsort((at, uid))
        spool = K.Spool(n, MARKS, limit=1 << 62)
        uid = uid[order]
        list(spool.add(_bucket(uid.view(np.uint64), n), [uid], [at[order], count[order], flags[order], source[order]]))
        return K.table_of(spool.flush(), blob)

    wide, narrow = K.Spool.schema(2, EDGES), K.Spool.schema(1, MARKS)
    blob = K.arrow_schema(narrow)
    return _regroup(sifted.mapInArrow(emit, wide).groupBy("bucket").applyInArrow(gather, narrow), MARKS, REPLY, "marks")


def _paths(marked: DataFrame, k: int) -> DataFrame:
    """Step 3, in each document: maximal runs of edges on one nonbranching path, and the words that later edges cover."""
    span = pa.schema([("start", pa.int32()), ("stop", pa.int32())])
    path = K.arrow_schema(PATH)

    def lists(columns: list[list], schema: pa.Schema, sizes: list[int]) -> pa.Array:
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), structs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            spans, paths = [[], []], [[] for _ in path]
            n_spans, n_paths = [], []
            for text, blob in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                words = text.encode().split()
                at, count, flags, source = _unpack(blob, MARKS)
                _, order = np.unique(at, return_index=True)  # identical rows share a key and bring their records twice
                at, count, flags, source = at[order].astype(np.int64), count[order], flags[order].astype(np.int64), source[order].view(np.int64)
                breaks = np.ones(len(at), bool)
                breaks[1:] = (at[1:] != at[:-1] + 1) | (flags[:-1] & 1 == 1) | (count[1:] != count[:-1]) | (flags[1:] >> 1 != flags[:-1] >> 1) | (source[1:] != source[:-1])
                first = np.flatnonzero(breaks)
                sizes = np.diff(np.append(first, len(at)))
                digests = [hashlib.sha256(b" ".join(words[a : a + n + k - 1])).digest()[:16] for a, n in zip(at[first].tolist(), sizes.tolist())]
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                for column, values in zip(paths, (at[first], sizes, halves[:, 0], halves[:, 1], flags[first] & 2 > 0, source[first])):
                    column.append(values)
                later = at[flags & 2 > 0]
                start, stop = K.merged(later, np.full(len(later), k))
                spans[0].append(start)
                spans[1].append(stop)
                n_paths.append(len(first))
                n_spans.append(len(start))
            joined = lambda c: np.concatenate(c) if c else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), lists(list(map(joined, spans)), span, n_spans), lists(list(map(joined, paths)), path, n_paths)], ["uid", "doc_id", "spans", "paths"])

    return marked.mapInArrow(kernel, PATHS)


def unitigs(paths: DataFrame) -> DataFrame:
    """One row per compacted path: key, windows, occurrences, source document (the least) and its start, and whether that is no later one."""
    rank = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "start")
    each = paths.select("doc_id", F.explode("paths").alias("p")).select("doc_id", "p.*")
    return each.groupBy("k0", "k1").agg(F.min(rank).alias("s"), F.count("*").alias("occurrences"), F.min("windows").alias("windows"), F.bool_or(~F.col("later")).alias("sourced")).select("k0", "k1", "windows", "occurrences", F.col("s.d").alias("source_id"), F.col("s.start").alias("source_start"), "sourced")


def _proven_by_window(unproven: DataFrame, source: DataFrame, k: int) -> DataFrame:
    """Edges whose path found no source: compare each window with the words of the source document."""
    arrow = K.arrow_schema("uid bigint, source bigint, start int, key binary")

    def digests(text: str) -> list[bytes]:
        words = text.encode().split()
        return [hashlib.sha256(b" ".join(words[i : i + k])).digest() for i in range(len(words) - k + 1)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            rows = []
            for r in part.to_pylist():
                words = r["text"].encode().split()
                rows += [{"uid": r["uid"], "source": r["source"], "start": i, "key": hashlib.sha256(b" ".join(words[i : i + k])).digest()} for i in range(r["start"], r["start"] + r["windows"])]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            for source, text in zip(part.column("source").to_pylist(), part.column("text").to_pylist()):
                keys = sorted(set(digests(text)))
                for a in range(0, len(keys), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(keys[a : a + (1 << 14)]), pa.int64()), K.binary_array(keys[a : a + (1 << 14)])], ["source", "key"])

    spelled = stored(source.join(unproven.select("uid", "start", "windows", "source"), "uid").select("uid", "source", "start", "windows", "text").mapInArrow(spell, "uid bigint, source bigint, start int, key binary"), "spelled")
    # digests meet digests: a source text is read once, however many windows ask for it
    texts = source.select(F.col("uid").alias("source"), "text").join(spelled.select("source").distinct(), "source").mapInArrow(known, "source bigint, key binary").distinct()
    return spelled.join(texts, ["source", "key"], "left_semi").select("uid", "start", F.lit(1).alias("windows")).distinct()


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, sub: int = SUB, print_bits: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows with their key, words to remove per key: uid, spans array<struct<start,stop>>)."""
    source = _source(docs, id_col, text_col)
    n = buckets(docs.sparkSession)
    flagged = cut(_sift(source, k, sub, n))
    # one plan: the exchange of the texts serves both joins
    marks = _edges(source.join(flagged, "uid"), k, sub, n, print_bits)
    paths = stored(_paths(source.join(marks, "uid"), k), "paths")
    del marks, flagged
    spans = paths.select("uid", "spans").where(F.size("spans") > 0).dropDuplicates(["uid"])
    each = paths.select("uid", F.explode("paths").alias("p")).select("uid", "p.*")
    # a later occurrence is proven by one of the same words that is not later: its document is the least with the edge
    unsourced = stored(unitigs(paths).where("NOT sourced").select("k0", "k1"), "unsourced")
    if not unsourced.isEmpty():
        # stored, so the planner knows the size: a few rows are broadcast to the texts, many are joined by exchange
        bad = stored(each.join(unsourced, ["k0", "k1"], "left_semi").where("later").distinct(), "unproven")
        touched = bad.select("uid").distinct()
        sound = each.where("later").join(touched, "uid", "left_semi").join(unsourced, ["k0", "k1"], "left_anti").select("uid", "start", "windows")
        kept = sound.unionByName(_proven_by_window(bad, source, k))
        again = kept.groupBy("uid").agg(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("windows") + k - 1).alias("stop"))).alias("spans"))
        spans = spans.join(touched, "uid", "left_anti").unionByName(again)
    return source, spans


def deduplicate(docs: DataFrame, *, k: int = WINDOW, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    source, spans = repeated_spans(docs, k=k, **options)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    arrow = K.arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            out: list[list] = [[] for _ in range(4)]
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words = (text or "").encode().split()
                total = len(words)
                if found:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in found], 1)
                    np.add.at(edge, [s["stop"] for s in found], -1)
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                kept = b" ".join(words)
                for column, value in zip(out, (total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[1:]))], schema=arrow)

    return source.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(kernel, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    return deduplicate(docs, **options).drop("kept")
