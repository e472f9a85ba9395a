"""Training-order materialisation of token ids.

Documents are tokenised, packed back to back (an end-of-text id after each)
into sequences of `seq_len` ids, and every sequence gets a global slot from a
keyed Feistel permutation of [0, number of sequences). Slots are dealt to
shards of `shard_slots` consecutive slots, a task writes a range of shards in
order, a shard is one file of fixed stride
(slot s lies at byte `(s % shard_slots) * seq_len * 2`), and a reader resumes
at any slot by seeking.

Two passes over the text: the first only counts the sequences of each input
partition, which yields the number of slots and each partition's first
sequence; the second tokenises again and sends finished sequences, compressed,
to their shard. Token ids cross the network once and are never stored besides
the shards. Packing is per input partition, so the padded sequences are one per
partition at most. The second pass checks each partition against the first
one's count and fails rather than misnumber; `materialise` then starts over.

Shard files are written under a temporary name and moved into place, so a task
that is run again after an executor was lost replaces its file by the same
bytes.

Defined cases: a null text counts as empty; an empty text contributes its
end-of-text id only; a very long text is tokenised as one slice and spans many
sequences; repeated rows are separate documents; null ids stay null in
`doc_ids`; an empty table gives no sequences; extra columns, also of clashing
names, are ignored; a vocabulary that leaves no 16-bit id for the end of text is
an error. The
last sequence of a partition is filled up with the end-of-text id, which
`n_tokens` leaves out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .permutation import feistel
from .shared import scratch, stored

SEQ_LEN = 2048
SHARD_SLOTS = 1024
SEED = 20
WIDE = 12 << 20  # bytes of text tokenised together

SEQUENCES = "slot bigint, shard bigint, n_tokens int, doc_ids array<bigint>, ids binary"
MANIFEST = "slot bigint, shard bigint, byte_offset bigint, n_tokens int, doc_ids array<bigint>, tokens_sha256 string, path string"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def default_tokenizer() -> tuple[str, str]:
    """Path and pre-token pattern of the byte-level vocabulary of 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def open_dir(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder by URI; a bare path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class Packer:
    """Cuts the documents of one partition, in the order given, into sequences of `seq_len` ids."""

    def __init__(self, seq_len: int, end: int):
        self.seq_len, self.end = seq_len, end
        self.ids, self.owners, self.size = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list, int]]:
        at, total = 0, len(ids) + 1
        while at < total:
            n = min(self.seq_len - self.size, total - at)
            self.ids.append(ids[at : at + n] if at + n < total else np.append(ids[at:], self.end))
            self.owners.append(doc_id)
            self.size += n
            at += n
            if self.size == self.seq_len:
                yield self._take()

    def rest(self) -> Iterator[tuple[np.ndarray, list, int]]:
        if self.size:
            yield self._take()

    def _take(self) -> tuple[np.ndarray, list, int]:
        filled = np.concatenate(self.ids)
        out = np.full(self.seq_len, self.end, np.uint16)
        out[: len(filled)] = filled
        found = out, list(dict.fromkeys(self.owners)), len(filled)
        self.ids, self.owners, self.size = [], [], 0
        return found


#: a space next to another blank: there a pre-token may reach across a space
UNSAFE = r" [\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}] "
OPEN_END = r"^$|[\s\x0b\x{85}\p{Z}]$"


class BatchCoder:
    """Token ids of many texts at once.

    A single space between two other characters always opens a pre-token and
    the one before it never reaches past it, so a text's ids are those of its
    space-separated chunks (each but the first with its space) in a row. The
    distinct chunks of a slice are tokenised in one call, and their ids told
    apart by the tokens' byte lengths. Texts with a space beside another blank
    are tokenised whole.
    """

    def __init__(self, tokenizer: tuple[str, str]):
        self.coder, self.end = encoding(*tokenizer)
        if self.end > np.iinfo(np.uint16).max:
            raise ValueError(f"ids up to {self.end} do not fit 16 bits")
        self.bytes_of = np.array([len(self.coder.decode_single_token_bytes(i)) for i in range(self.end)], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts of the rows, and all ids one after another."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(unsafe), pa.scalar("", texts.type), texts), " ")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        parts = pc.list_flatten(lists)
        codes = parts.dictionary_encode()
        firsts = np.cumsum(sizes) - sizes
        # ids of every distinct chunk with its space
        chunks = codes.dictionary
        alone = pc.match_substring_regex(chunks, OPEN_END).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~alone)
        kept = chunks.take(pa.array(plain))
        ids = self._ids("".join([" ", " ".join(kept.to_pylist())]) if len(plain) else "")
        ends = np.cumsum(pc.binary_length(kept).to_numpy().astype(np.int64) + 1)
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1 if len(plain) else ends
        length = np.zeros(len(chunks), np.int64)
        length[plain] = np.diff(stops, prepend=0)
        start = np.zeros(len(chunks), np.int64)
        start[plain] = stops - length[plain]
        flat, total = [ids], len(ids)

        def extra(text: str) -> tuple[int, int]:
            nonlocal total
            flat.append(self._ids(text))
            total += len(flat[-1])
            return total - len(flat[-1]), len(flat[-1])

        for i in np.flatnonzero(alone).tolist():
            start[i], length[i] = extra(" " + chunks[i].as_py())
        code = codes.indices.to_numpy()
        start, length = start[code], length[code]
        # a row's first chunk has no space; an unsafe row is its only chunk
        for row, at in enumerate(firsts.tolist()):
            start[at], length[at] = extra(texts[row].as_py() if unsafe[row] else parts[at].as_py())
        sums = np.concatenate(([0], np.cumsum(length)))
        counts = sums[firsts + sizes] - sums[firsts]
        return counts, np.concatenate(flat)[K.take_ranges(start, length)] if want_ids else None


def _texts(batches: Iterator[pa.RecordBatch], tokenizer: tuple[str, str]) -> Iterator[tuple[int | None, np.ndarray]]:
    coder = BatchCoder(tokenizer)
    for part in K.slices(batches, "text", WIDE):
        counts, ids = coder.encode(part.column("text"))
        ends = np.cumsum(counts)
        for doc_id, a, b in zip(part.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
            yield doc_id, ids[a:b]
    pa.default_memory_pool().release_unused()


def counts(source: DataFrame, tokenizer: tuple[str, str], seq_len: int) -> dict[int, int]:
    """Sequences of each input partition: one number per task reaches the driver."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = BatchCoder(tokenizer), 0
        for part in K.slices(batches, "text", WIDE):
            total += int(coder.encode(part.column("text"), want_ids=False)[0].sum()) + len(part)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [-(-total // seq_len)]}, pa.schema([("part", pa.int64()), ("n", pa.int64())]))

    return {r.part: r.n for r in source.mapInArrow(kernel, "part bigint, n bigint").collect()}


def sequences(source: DataFrame, first: dict[int, tuple[int, int]], total: int, tokenizer: tuple[str, str], seq_len: int, shard_slots: int, seed: int) -> DataFrame:
    """Finished sequences with their slots; ids are zstd-compressed byte planes."""
    bounds = source.sparkSession.sparkContext.broadcast(first)  # two numbers per input partition

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = encoding(*tokenizer)[1]
        part = TaskContext.get().partitionId()
        base, expected = bounds.value.get(part, (0, 0))
        packer, made, pending = Packer(seq_len, end), 0, []

        def flush():
            slot = feistel(np.arange(base + made - len(pending), base + made), total, seed)
            return pa.RecordBatch.from_pydict(
                {"slot": slot, "shard": slot // shard_slots, "n_tokens": [n for *_, n in pending], "doc_ids": [d for _, d, _ in pending], "ids": [pa.compress(K.pack_bytes(x, 2), "zstd", asbytes=True) for x, *_ in pending]},
                pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary())]),
            )

        def packed():
            for doc_id, ids in _texts(batches, tokenizer):
                yield from packer.add(doc_id, ids)
            yield from packer.rest()

        for sequence in packed():
            pending.append(sequence)
            made += 1
            if made > expected:
                break
            if len(pending) == 512:
                yield flush()
                pending.clear()
        if made != expected:
            raise RuntimeError(f"partition {part} gives {made} sequences or more, not {expected}: the input was split in another way than before")
        if pending:
            yield flush()

    return source.mapInArrow(kernel, SEQUENCES)


def write_shards(rows: DataFrame, folder: str, seq_len: int, shard_slots: int) -> DataFrame:
    """One file of fixed stride per shard; returns the manifest, one row per slot."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_dir(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, current, path = None, None, ""

        def close():
            if out is not None:
                out.close()
                system.move(f"{path}.{attempt}.tmp", path)

        for batch in batches:
            manifest = []
            for row in batch.to_pylist():
                if row["shard"] != current:
                    close()
                    current, path = row["shard"], f"{root}/shard-{row['shard']:08d}.bin"
                    out = system.open_output_stream(f"{path}.{attempt}.tmp", compression=None)
                ids = K.unpack_bytes(pa.decompress(row["ids"], 2 * seq_len, "zstd", asbytes=True), 2).astype("<u2")
                out.write(ids.tobytes())
                manifest.append({"slot": row["slot"], "shard": current, "byte_offset": row["slot"] % shard_slots * seq_len * 2, "n_tokens": row["n_tokens"], "doc_ids": row["doc_ids"], "tokens_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "path": path})
            if manifest:
                yield pa.RecordBatch.from_pylist(manifest, _MANIFEST_ARROW)
        close()

    return rows.mapInArrow(kernel, MANIFEST)


_MANIFEST_ARROW = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("tokens_sha256", pa.string()), ("path", pa.string())])


def materialise(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, seed: int = SEED, stable: bool = True, tries: int = 3) -> DataFrame:
    """Write the shards and return their manifest.

    `stable` says that `docs` is read from files, whose partitions come out
    alike each time; other frames are written to the shared folder first.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not stable:
        source = stored(source, "token-source")
    folder = folder or scratch(spark, "shards")
    for attempt in range(tries):
        per_part = counts(source, tokenizer, seq_len)
        total, first = 0, {}
        for part in sorted(per_part):
            first[part] = (total, per_part[part])
            total += per_part[part]
        rows = sequences(source, first, total, tokenizer, seq_len, shard_slots, seed)
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_slots)))
        # ranges of shards in slot order; slots are a permutation, so equal ranges of them hold equally many sequences
        shards = max(1, -(-total // shard_slots))
        rows = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
        manifest = write_shards(rows.sortWithinPartitions("shard", "slot"), folder, seq_len, shard_slots)
        try:
            return stored(manifest, "manifest")
        except Exception as e:
            if attempt + 1 == tries or "the input was split in another way" not in str(e):
                raise
    raise AssertionError


def read(path: str, slot: int, n: int, *, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS) -> np.ndarray:
    """`n` sequences of one shard from `slot` on, by one seek."""
    system, name = open_dir(path)
    with system.open_input_file(name) as f:
        f.seek(slot % shard_slots * seq_len * 2)
        return np.frombuffer(f.read(n * seq_len * 2), "<u2").reshape(-1, seq_len)
