"""Vectorised byte-level text kernels shared by the Arrow-side operators.

All of them work on the concatenated UTF-8 bytes of a batch and return offsets
into it, so a batch of documents costs a fixed number of NumPy passes instead
of one Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_PRIME_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))

#: `[^\x20\x09-\x0D]`: every byte but the six ASCII blanks belongs to a word.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_CODES = np.random.Generator(np.random.PCG64(0x5EED)).integers(0, 1 << 64, 256, np.uint64, False)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each maximal run of `inside` bytes in a row, and the word offsets of the rows."""
    flags = np.zeros(len(data) + 1, bool)
    np.take(inside, data, out=flags[:-1])
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = flags[:-1]
    edges = offsets[:-1]
    cut = edges[edges < len(data)]
    opens = flags & ~before
    opens[cut] = flags[cut]
    closes = before & ~flags
    closes[cut] = before[cut]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right"))
        b = min(max(b, a + 1), len(starts))
        low, high = int(starts[a]), int(ends[b - 1])
        power, inverse = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * power, out=total[1:])
        i, j = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((total[j] - total[i]) * inverse[i] + (j - i).astype(np.uint64))
        a = b
    return out


_power_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache.get("power", ())) < n:
        size = 1 << max(n - 1, SLICE_BYTES).bit_length()
        for name, base in (("power", _PRIME), ("inverse", _PRIME_INVERSE)):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _power_cache[name] = np.cumprod(values)
    return _power_cache["power"][:n], _power_cache["inverse"][:n]


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, whatever row they belong to."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out *= _PRIME
        out += hashes[j : j + n]
    return mix(out)


def window_starts(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions from which k words follow in the same row."""
    sizes = np.maximum(np.diff(word_offsets) - k + 1, 0)
    return take_ranges(word_offsets[:-1], sizes)


def row_of(index: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(word_offsets, index, "right") - 1


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length), in 32 bits where they suffice."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    kind = np.int32 if max(total, int((starts + lengths).max())) < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def merged(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [at, at + length) as disjoint spans."""
    if not len(at):
        return at, at
    order = np.argsort(at, kind="stable")
    start, stop = at[order], np.maximum.accumulate((at + length)[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]


def pack_bytes(values: np.ndarray, width: int) -> bytes:
    """Low `width` bytes of each unsigned value, byte planes one after another (planes compress better)."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(planes.T).tobytes()


def unpack_bytes(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


class Spool:
    """Collects records (owner, values) of many documents and hands them out as one blob row per bucket.

    A row holds the owners' keys, their record counts, and one byte-plane blob
    per value column; records keep the order in which they came.
    """

    def __init__(self, buckets: int, widths: list[int], key_columns: int = 1, limit: int = 1 << 19):
        self.buckets, self.widths, self.key_columns, self.limit = buckets, widths, key_columns, limit
        self.parts: list[tuple] = []
        self.size = 0

    @staticmethod
    def schema(key_columns: int, widths: list[int]) -> str:
        names = [f"k{i} binary" for i in range(key_columns)] + ["counts binary"] + [f"v{i} binary" for i in range(len(widths))]
        return "bucket int, " + ", ".join(names)

    def add(self, bucket: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """`keys` and `values` have one entry per record."""
        if len(bucket):
            self.parts.append((bucket.astype(np.uint32), keys, values))
            self.size += len(bucket)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        keys = [np.concatenate([p[1][i] for p in self.parts])[order] for i in range(self.key_columns)]
        values = [np.concatenate([p[2][i] for p in self.parts])[order] for i in range(len(self.widths))]
        self.parts, self.size = [], 0
        starts, sizes = runs(bucket)
        columns: list[list] = [[] for _ in range(2 + self.key_columns + len(self.widths))]
        for a, n in zip(starts.tolist(), sizes.tolist()):
            columns[0].append(int(bucket[a]))
            first, count = runs(keys[0][a : a + n])
            for i, k in enumerate(keys):
                columns[1 + i].append(k[a : a + n][first].astype("<i8").tobytes())
            columns[1 + self.key_columns].append(pack_bytes(count, 4))
            for i, w in enumerate(self.widths):
                columns[2 + self.key_columns + i].append(pack_bytes(values[i][a : a + n], w))
        names = ["bucket", *(f"k{i}" for i in range(self.key_columns)), "counts", *(f"v{i}" for i in range(len(self.widths)))]
        arrays = [pa.array(columns[0], pa.int32()), *(binary_array(c) for c in columns[1:])]
        batch = pa.RecordBatch.from_arrays(arrays, names)
        for a in range(0, batch.num_rows, 256):
            yield batch.slice(a, 256)

    @staticmethod
    def read(table: pa.Table, key_columns: int, widths: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys and values of all records of a bucket, one entry per record."""
        def joined(name: str, decode) -> np.ndarray:
            pieces = [decode(x.as_buffer()) for x in table.column(name)]
            return np.concatenate(pieces) if pieces else np.empty(0, np.uint64)

        counts = joined("counts", lambda b: unpack_bytes(b, 4)).astype(np.int64)
        keys = [np.repeat(joined(f"k{i}", lambda b: np.frombuffer(b, "<i8")), counts) for i in range(key_columns)]
        return keys, [joined(f"v{i}", lambda b, w=w: unpack_bytes(b, w)) for i, w in enumerate(widths)]


def table_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
