"""Benchmark decontamination with one FM-index per shard of training text.

A shard is a slice of a few megabytes of documents inside one task. Its words
are numbered in the benchmark's vocabulary; words outside it cannot be part of
an occurrence and end a run, as row ends do. The runs are indexed (suffix
array, Burrows-Wheeler transform, wavelet matrix, sampled suffix positions),
all test phrases are searched backwards at once, occurrences are located
through the samples, and the spans they cover are merged per document.

Scale: no shuffle of documents, memory bounded by the shard. The benchmark is
cut into blocks of some `block_bytes` of text (measured, not assumed). One block
is one broadcast and one pass. More are a pass each: a block is released before
the next one is collected, and only hit documents' spans are kept between the
passes, so neither driver nor executors hold more than one block.

Defined cases: null or wordless texts give zero counts; an item without words
has no phrase; a null item id is written as the empty string; repeated rows
give equal results; a very long text is a shard of its own; an empty benchmark
gives zero counts; extra columns, also of clashing names, are ignored by `scan`
and carried by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import stored, wide_key

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20

SCHEMA = "doc_id bigint, uid binary, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


class Phrases:
    """Distinct test phrases of one benchmark block, as rows of vocabulary numbers aligned to the right."""

    def __init__(self, item_ids: list, texts: list, window: int = WINDOW):
        column = pa.array(texts, pa.large_string())
        data, offsets = K.utf8(column)
        data = K.LOWER[data]
        starts, ends, rows = K.words(data, offsets, K.ALPHANUMERIC)
        hashes = K.word_hashes(data, starts, ends)
        self.window = window
        self.vocabulary, first, symbol = np.unique(hashes, return_index=True, return_inverse=True)
        symbol = (symbol + 1).astype(np.int32)
        self.spelling = [b"", *(bytes(data[starts[i] : ends[i]]) for i in first.tolist())]
        # a window per row, to the right; items of fewer words are one window
        at = K.window_starts(rows, window)
        table, owner = symbol[at[:, None] + np.arange(window)], K.row_of(at, rows)
        sizes = np.diff(rows)
        few = np.flatnonzero((sizes > 0) & (sizes < window))
        short = np.zeros((len(few), window), np.int32)
        for i, r in enumerate(few.tolist()):
            short[i, window - sizes[r] :] = symbol[rows[r] : rows[r + 1]]
        table, owner = np.concatenate((table, short)), np.concatenate((owner, few))
        order = np.lexsort(table.T)
        table, owner = table[order], owner[order]
        fresh = np.ones(len(table), bool)
        fresh[1:] = (table[1:] != table[:-1]).any(1)
        self.symbols = table[fresh]
        self.lengths = (self.symbols > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.names = ["" if i is None else str(i) for i in item_ids]
        self.owners, self.bounds = owner, np.append(np.flatnonzero(fresh), len(table))

    def items(self, phrase: int) -> set[str]:
        """Names of the items that hold a phrase."""
        return {self.names[i] for i in self.owners[self.bounds[phrase] : self.bounds[phrase + 1]].tolist()}


class FMIndex:
    """Index over runs of symbols >= 1, each run followed by a separator of its own."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = self.n = len(text)
        separators = text == 0
        count = int(separators.sum())
        rank = text + count - 1
        rank[separators] = np.arange(count)
        self.order = self._suffixes(rank)
        before = np.roll(text, 1)
        before[0] = 0
        self.bwt = before[self.order]
        self.bits = max(1, int(sigma).bit_length())
        #: first suffix that starts with each symbol
        self.first = np.searchsorted(text[self.order], np.arange(sigma + 2))
        self.levels: list[tuple[np.ndarray, int]] = []
        current = self.bwt
        for bit in reversed(range(self.bits)):
            ones = (current >> bit) & 1
            prefix = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=prefix[1:])
            zeros = n - int(prefix[-1])
            self.levels.append((prefix, zeros))
            mask = ones.astype(bool)
            current = np.concatenate((current[~mask], current[mask]))
        #: positions kept: every `sample`-th one and the first of each run, so no walk crosses a separator
        kept = (self.order % sample == 0) | (self.bwt == 0)
        self.sampled = kept
        self.sample_rank = np.cumsum(kept) - 1
        self.positions = self.order[kept]
        del self.order

    @staticmethod
    def _suffixes(rank: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; separators differ, so ranks become distinct after the longest repeat."""
        n, h = len(rank), 1
        rank = rank.astype(np.uint64)
        order = np.argsort(rank, kind="stable")
        while True:
            ahead = np.zeros(n, np.uint64)
            ahead[: max(n - h, 0)] = rank[h:] + np.uint64(1)
            key = (rank << np.uint64(32)) | ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.zeros(n, np.uint64)
            fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.uint64)
            rank[order] = fresh
            if not n or int(fresh[-1]) == n - 1:
                return order
            h *= 2

    def rank(self, symbol: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in bwt[:index]."""
        low = np.zeros_like(index)
        for (prefix, zeros), bit in zip(self.levels, reversed(range(self.bits))):
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = prefix[low], prefix[index]
            low = np.where(one, zeros + a, low - a)
            index = np.where(one, zeros + b, index - b)
        return index - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase numbers that occur, with their suffix ranges [low, high)."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        width = phrases.shape[1]
        for step in range(width):
            symbol = phrases[alive, width - 1 - step]
            base = self.first[symbol]
            if step:
                low, high = base + self.rank(symbol, low), base + self.rank(symbol, high)
            else:
                low, high = base, self.first[symbol + 1]
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
            whole = lengths[alive] == step + 1
            if whole.any():
                done.append((alive[whole], low[whole], high[whole]))
                alive, low, high = alive[~whole], low[~whole], high[~whole]
            if not len(alive):
                break
        if not done:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one and count the steps."""
        out = np.empty(len(rows), np.int64)
        pending, steps = np.arange(len(rows)), 0
        while len(pending):
            hit = self.sampled[rows]
            out[pending[hit]] = self.positions[self.sample_rank[rows[hit]]] + steps
            pending, rows = pending[~hit], rows[~hit]
            if len(pending):
                symbol = self.bwt[rows]
                rows = self.first[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def find(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Occurrences (phrase, first word) in one shard, the word offsets of its rows, and the word bounds."""
    data = K.LOWER[data]
    starts, ends, rows = K.words(data, offsets, K.ALPHANUMERIC)
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), rows, (starts, ends)
    if not len(phrases.lengths) or not len(starts):
        return nothing
    hashes = K.word_hashes(data, starts, ends)
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == hashes, place + 1, 0)
    known = symbol > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    edges = rows[:-1][rows[:-1] < len(known)]
    opens[edges] = known[edges]
    closes = known.copy()
    closes[:-1] &= ~known[1:]
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    closes[last] = known[last]
    first = np.flatnonzero(opens)
    length = np.flatnonzero(closes) - first + 1
    keep = length >= phrases.shortest
    first, length = first[keep], length[keep]
    if not len(first):
        return nothing
    word = K.take_ranges(first, length + 1)
    text = symbol[np.minimum(word, len(symbol) - 1)]
    text[np.cumsum(length + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    which, low, high = index.search(phrases.symbols, phrases.lengths)
    if not len(which):
        return nothing
    at = word[index.locate(K.take_ranges(low, high - low))]
    which = np.repeat(which, high - low)
    # vocabulary numbers come from hashes: compare the words themselves
    right = np.ones(len(which), bool)
    for step in range(int(phrases.lengths.max())):
        live = np.flatnonzero(phrases.lengths[which] > step)
        position = at[live] + step
        column = phrases.window - phrases.lengths[which[live]] + step
        for s, p, i in zip(phrases.symbols[which[live], column].tolist(), position.tolist(), live.tolist()):
            if data[starts[p] : ends[p]].tobytes() != phrases.spelling[s]:
                right[i] = False
    return which[right], at[right], rows, (starts, ends)


class Blocks:
    """The benchmark in blocks of some `block_bytes` of text, broadcast one at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
        self.items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.window = window
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, -(-int(total) // block_bytes))

    def load(self, number: int):
        """Broadcast of a block's phrases."""
        part = self.items if self.n == 1 else self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == number)
        rows = part.collect()
        return self.items.sparkSession.sparkContext.broadcast(Phrases([r.item for r in rows], [r.text for r in rows], self.window))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _search(source: DataFrame, block, everything: bool) -> DataFrame:
    """(doc_id, uid, n_words, spans, items) of all rows, or of those that hold a phrase of the block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for shard in K.slices(batches, "text", SHARD_BYTES):
            which, at, rows, _ = find(*K.utf8(shard.column("text")), phrases)
            spans, names = [[] for _ in range(len(shard))], [set() for _ in range(len(shard))]
            # a span never leaves its row, but spans of neighbouring rows may touch: merge row by row
            start, stop = K.merged(at + K.row_of(at, rows), phrases.lengths[which])
            owner = K.row_of(start - np.searchsorted(rows[1:-1] + np.arange(1, len(rows) - 1), start, "right"), rows) if len(start) else start
            for r, s, e in zip(owner.tolist(), start.tolist(), stop.tolist()):
                base = int(rows[r]) + r
                spans[r].append({"start": s - base, "stop": e - base})
            for r, w in set(zip(K.row_of(at, rows).tolist(), which.tolist())):
                names[r] |= phrases.items(w)
            columns = [shard.column("doc_id"), shard.column("uid"), pa.array(np.diff(rows)), pa.array(spans, _SPANS), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n_words", "spans", "items"])
            yield out if everything else out.filter(pa.array([len(x) > 0 for x in spans], pa.bool_()))

    return source.mapInArrow(kernel, SCHEMA)


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, merged removal spans (word numbers, stop exclusive), ids of items that occur."""
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if blocks.n == 1:
        return _search(source.withColumn("uid", F.lit(None).cast("binary")), blocks.load(0), True).drop("uid")
    source = source.withColumn("uid", wide_key("doc_id", "text"))
    passes = []
    for b in range(blocks.n):
        block = blocks.load(b)
        passes.append(stored(_search(source, block, b == 0), "phrase-hits"))
        block.destroy()
    hits = reduce(DataFrame.unionByName, passes).where(F.size("spans") > 0)
    merged = hits.groupBy("uid").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = passes[0].select("doc_id", "uid", "n_words").join(merged, "uid", "left")
    return both.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def _merged(spans: Column) -> Column:
    """Union of spans as disjoint ones, in order."""

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(out) > 0) & (s["start"] <= F.get(out, F.size(out) - 1)["stop"]), wider).otherwise(F.array_append(out, s))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`scan` as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["start"])
    return scan(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the merged spans; a text is searched again until no phrase is left, and rows left without text go."""
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)
    if blocks.n == 1:
        return _without(docs, blocks.load(0), text_col, chars_col)
    size = None
    while True:
        for b in range(blocks.n):
            block = blocks.load(b)
            docs = stored(_without(docs, block, text_col, chars_col), "decontaminated")
            block.destroy()
        seen = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint")), F.count("*")).first()
        if seen == size:
            return docs
        size = seen


def _without(docs: DataFrame, block, text_col: str, chars_col: str) -> DataFrame:
    """`docs` without the phrases of one block."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    place = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if fields.get(chars_col) in ("bigint", "int") else None

    def without(texts: list[bytes]) -> dict[int, bytes]:
        phrases = block.value
        changed: dict[int, bytes] = {}
        pending = list(range(len(texts)))
        while pending:
            current = [changed.get(i, texts[i]) for i in pending]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in current])))
            data = np.frombuffer(b"".join(current), np.uint8)
            cuts: dict[int, list] = {}
            which, at, rows, (starts, ends) = find(data, offsets, phrases)
            for a, n in zip(at.tolist(), phrases.lengths[which].tolist()):
                r = int(K.row_of(np.array([a]), rows)[0])
                cuts.setdefault(r, []).append((int(starts[a] - offsets[r]), int(ends[a + n - 1] - offsets[r])))
            again = []
            for r, found in cuts.items():
                text, out, last = current[r], [], 0
                for s, e in sorted(found):
                    if s > last:
                        out.append(text[last:s])
                    last = max(last, e)
                changed[pending[r]] = b"".join([*out, text[last:]])
                again.append(pending[r])
            pending = again
        return changed

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in K.slices(batches, text_col, SHARD_BYTES):
            column = shard.column(place)
            data, offsets = K.utf8(column)
            raw = data.tobytes()
            changed = without([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            if changed:
                columns = list(shard.columns)
                texts = column.to_pylist()
                for i, t in changed.items():
                    texts[i] = t.decode("utf-8", "replace")
                columns[place] = pa.array(texts, column.type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for i in changed:
                        sizes[i] = len(texts[i])
                    columns[count] = pa.array(sizes, columns[count].type)
                shard = pa.RecordBatch.from_arrays(columns, schema=shard.schema)
                gone = np.array([i in changed and not texts[i].strip() for i in range(len(texts))])
                shard = shard.filter(pa.array(~gone))
            yield shard

    return docs.mapInArrow(kernel, docs.schema)


def digest_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
