"""WARC archives as a chunked record table.

`chunked` splits each payload natively into rows of (row number, chunk number,
bytes), stored once; from there on no payload is one value again. Records are
classified on a narrow table of digests and lengths alone. The writer streams
chunk rows into archive files, and `read_chunks` streams them back out, each
chunk with the running SHA-1 of the payload so far, so that the last chunk of a
record proves it. Both sides hold one Arrow batch of chunks (the session bounds
its bytes), whatever the record's length; a batch of the source holds whole
payloads, as its rows do.

Records with equal payloads: the one with the smallest id is the response, the
others revisit it. A response holds an HTTP header block and the payload, a
revisit the header block alone. Each record is a gzip member of its own, and its
record id (page id and row number) is unique in the archive.

Archives are written to the shared folder, under a temporary name that is moved
into place when the task has written all of it; a task that is run again after
an executor was lost replaces its file by the same records. The table of files
is stored, so reading starts from committed files only, one task per file.

`read_chunks` also reads archives of other writers: a record keeps the type it
states, the payload of a response is what follows its HTTP header block, that of
any other record its whole block; a revisit's payload length is null where the
archive does not state it.

Defined cases: a null payload is empty; a null id is written as an empty page
name and read back as null (among equal payloads it is the response only if all
ids are null); repeated rows are records of their own, of the same type; a very
long payload is many chunks; an empty table writes no file; extra columns, also
of clashing names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stored
from .token_ids import open_dir

CHUNK = 1 << 18
MIN_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"  # archives are reproducible; pass `date` for a real one

#: parts that the rows of one payload are dealt to
SALT = 16
HTTP = "application/http; msgtype=response"

FILES = "path string, records bigint, bytes bigint"
CHUNKS = "path string, record_no bigint, record_id string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, chunk_no bigint, data binary, data_bytes bigint, running_sha1 string"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of (row, chunk_no, data, id, url, bytes, sha1), stored; an empty payload has one empty chunk."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), text(url_col).alias("url"), text(payload_col).cast("binary").alias("payload"))
    whole = rows.select(F.monotonically_increasing_id().alias("row"), "id", "url", "payload", F.octet_length("payload").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1"))
    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / chunk) - 1).cast("int")
    numbered = whole.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return stored(numbered.select("row", "chunk_no", "id", "url", "bytes", "sha1", data.alias("data")), "warc-chunks", "zstd")


def classified(chunks: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Per row: row, record_type, refers_to, refers_row; from digests and lengths alone.

    The first record of each payload is found by a partial minimum; the rows of
    a payload with very many copies are dealt to SALT parts.
    """
    narrow = chunks.where("chunk_no = 0").select("row", "id", "bytes", "sha1")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = narrow.where(F.col("bytes") >= min_revisit).groupBy("sha1", "bytes").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    dealt = first.select("sha1", "bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    joined = narrow.withColumn("part", F.pmod("row", F.lit(SALT)).cast("int")).join(dealt, ["sha1", "bytes", "part"], "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return joined.select("row", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first.id")).alias("refers_to"), F.when(other, F.col("first.row")).alias("refers_row"))


def records(chunks: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Chunk rows with their record's type, in the order of the archive; a revisit has one empty chunk."""
    typed = chunks.join(classified(chunks, min_revisit).hint("merge"), "row")
    kept = typed.where("record_type = 'response' OR chunk_no = 0").withColumn("data", F.when(F.col("record_type") == "response", F.col("data")).otherwise(F.lit(b"")))
    return kept.sortWithinPartitions("row", "chunk_no")


def _name(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def _header(row: dict, date: str) -> bytes:
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_name(row['id'], row['row'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(row['url'].split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(row['sha1']))}",
        f"Content-Type: {HTTP}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(row['refers_to'], row['refers_row'])}", f"X-Payload-Length: {row['bytes']}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write(chunks: DataFrame, folder: str, *, tasks: int | None = None, date: str = DATE) -> DataFrame:
    """Archive files in `folder`, one per task; returns (path, records, bytes). Chunks of a record must be neighbours."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = open_dir(folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/part-{context.partitionId():06d}.warc.gz"
        temporary = f"{path}.{context.taskAttemptId()}.tmp"
        records = size = 0
        out = member = None
        for batch in batches:
            fields = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(fields, batch.column("data")):
                if out is None:
                    out = system.open_output_stream(temporary, compression=None)
                if row["chunk_no"] == 0:
                    if records:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(_header(row, date)))
                    records += 1
                data = data.as_buffer()
                out.write(member.compress(data))
                size += len(data)
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            system.move(temporary, path)
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}], _arrow(FILES))

    return chunks.mapInArrow(kernel, FILES)


def _page(name: str) -> int | None:
    """Page id in a record id of this writer."""
    page = name.strip("<>").removeprefix("urn:page:").split(":")[0] if name.startswith("<urn:page:") else ""
    return int(page) if page else None


def read_chunks(files: DataFrame, folder: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of archive files: header fields on every chunk, and the running SHA-1 of the payload."""
    schema = _arrow(CHUNKS)

    def records(stream) -> Iterator[dict]:
        number = 0
        buffer = b""

        def line() -> bytes:
            nonlocal buffer
            while b"\r\n" not in buffer:
                more = stream.read(1 << 14)
                if not more:
                    raise EOFError("archive ends inside a header")
                buffer += more
            out, buffer = buffer.split(b"\r\n", 1)
            return out

        def take(n: int) -> bytes:
            nonlocal buffer
            out, buffer = buffer[:n], buffer[n:]
            while len(out) < n:
                more = stream.read(n - len(out))
                if not more:
                    raise EOFError("archive ends inside a record")
                out += more
            return out

        while True:
            if not buffer:
                buffer = stream.read(1 << 14)
            if not buffer:
                return
            if not line().startswith(b"WARC/"):
                raise ValueError("no record starts here")
            fields = {}
            while text := line():
                name, _, value = text.partition(b":")
                fields[name.strip().lower().decode()] = value.strip().decode()
            name, kind = fields["warc-record-id"], fields["warc-type"]
            length, done, no, state = int(fields["content-length"]), 0, 0, hashlib.sha1()
            if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http") and length:
                while text := line():
                    length -= len(text) + 2
                length -= 2
            if length < 0:
                raise ValueError("an HTTP header block reaches past its record")
            stated = fields.get("x-payload-length")
            base = {"record_no": number, "record_id": name.strip("<>"), "page_id": _page(name), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to", "")), "payload_bytes": (int(stated) if stated else None) if kind == "revisit" else length, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
            while no == 0 or done < length:
                piece = take(min(chunk, length - done))
                done += len(piece)
                state.update(piece)
                yield base | {"chunk_no": no, "data": piece if data else None, "data_bytes": len(piece), "running_sha1": None if kind == "revisit" else base32_sha1(state.copy().digest())}
                no += 1
            if take(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            number += 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_dir(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in records(stream):
                        rows.append(row | {"path": path})
                        size += row["data_bytes"] if data else 64
                        if size >= 4 * chunk or len(rows) >= 1024:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, files.count())
    return files.select("path").repartition(tasks).mapInArrow(kernel, CHUNKS)


def archive(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """Write one record per row; (table of files, folder)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = chunked(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, chunk=chunk)
    return stored(write(records(rows), folder), "warc-files"), folder


def report(pages: DataFrame, **options) -> DataFrame:
    """Round trip: page_id, payload_bytes, payload_digest, record_type, refers_to, and `verified` of each record read back."""
    files, folder = archive(pages, **options)
    chunks = read_chunks(files, folder, data=False)
    # the last chunk of a record carries the digest of all of it
    last = chunks.groupBy("path", "record_no", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").agg(F.max(F.struct("chunk_no", "running_sha1")).alias("last"), F.sum("data_bytes").alias("read"))
    whole = (F.col("record_type") == "revisit") | ((F.col("read") == F.col("payload_bytes")) & (F.col("last.running_sha1") == F.col("payload_digest")))
    return last.select("page_id", "payload_bytes", F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("last.running_sha1")).alias("payload_digest"), "record_type", "refers_to", whole.alias("verified"))
