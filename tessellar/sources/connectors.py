"""Spark data sources for maps and surfaces: partitioned readers, and writers whose tasks write files that the commit puts in place.

`vertexmap` reads morphometry and annotation files by ranges of bytes, so one
large map is many partitions, and GIFTI data arrays by file; it writes one file
per map. `surface` writes one file per mesh. Files are opened where a task runs
through `pyarrow.fs`, so any of its file systems will do; the rows of a map or
mesh meet in the task that writes its file, never on the driver.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessellar.sources import formats

#: vertices that one partition of a map reads
VERTICES = 1_000_000
MAP = "path string, v_id bigint, col int, value double"
_MAP_ARROW = pa.schema([("path", pa.string()), ("v_id", pa.int64()), ("col", pa.int32()), ("value", pa.float64())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """Files of a comma-separated list of files and folders, in order of name."""
    out = []
    for p in path.split(","):
        where, inner = located(p)
        info = where.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(inner, recursive=True))
            out += sorted(f"{p.rstrip('/')}/{f.path.removeprefix(inner.rstrip('/')).lstrip('/')}" for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        elif info.type == fs.FileType.File:
            out.append(p)
        else:
            raise FileNotFoundError(p)
    return out


def _bytes(path: str, start: int, size: int) -> bytes:
    where, inner = located(path)
    with where.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


@dataclass
class _Range(InputPartition):
    path: str
    kind: str
    first: int
    last: int
    offset: int
    step: int


def _ranges(path: str, kind: str, size: int) -> list[_Range]:
    """A map's byte ranges; only its header is read."""
    if kind == "gii":
        return [_Range(path, kind, 0, 0, 0, 0)]
    head = _bytes(path, 0, 15)
    if kind == "annot":
        n, offset, step = struct.unpack(">i", head[:4])[0], 4, 8
    elif int.from_bytes(head[:3], "big") == formats.CURVATURE:
        n, offset, step = struct.unpack(">i", head[3:7])[0], 15, 4
    else:
        n, offset, step = int.from_bytes(head[:3], "big"), 6, 2
    return [_Range(path, kind, i, min(i + size, n), offset, step) for i in range(0, n, size)]


class VertexMapSource(DataSource):
    """`spark.read.format("vertexmap").option("kind", "morph" | "annot" | "gii").load(path)`: (path, v_id, col, value).

    The option `vertices` sets how many a partition reads. An annotation's value is its packed colour, to be joined with `colour_table`.
    Writing takes the same columns and the kinds morph and gii.
    """

    @classmethod
    def name(cls) -> str:
        return "vertexmap"

    def schema(self) -> str:
        return MAP

    def reader(self, schema) -> DataSourceReader:
        return _MapReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MapWriter(self.options, overwrite)


class _MapReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "morph")
        self.size = int(options.get("vertices", VERTICES))

    def partitions(self) -> list[InputPartition]:
        return [r for p in files(self.path) for r in _ranges(p, self.kind, self.size)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.kind == "gii":
            where, inner = located(p.path)
            with where.open_input_file(inner) as f:
                arrays = formats.gifti_arrays(f.read())
            for col, (intent, a) in enumerate((i, a) for i, a in arrays if i not in ("NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE")):
                flat = np.asarray(a, float).reshape(len(a), -1)
                for c in range(flat.shape[1]):
                    yield _map_batch(p.path, np.arange(len(flat)), col + c, flat[:, c])
            return
        data = _bytes(p.path, p.offset + p.first * p.step, (p.last - p.first) * p.step)
        if p.kind == "annot":
            pairs = np.frombuffer(data, ">i4").reshape(-1, 2)
            yield _map_batch(p.path, pairs[:, 0], 0, pairs[:, 1])
        else:
            values = np.frombuffer(data, ">f4") if p.step == 4 else np.frombuffer(data, ">i2") / 100.0
            yield _map_batch(p.path, np.arange(p.first, p.last), 0, values)


def _map_batch(path: str, ids: np.ndarray, col: int, values: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(ids.astype(np.int64)), pa.array(np.full(n, col, np.int32)), pa.array(values.astype(np.float64))], schema=_MAP_ARROW)


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, name, r, g, b, t, value): the colour tables of annotation files; a table has a row per region."""
    schema = "path string, index int, name string, r bigint, g bigint, b bigint, t bigint, value double"

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (p,) in zip(batch.column(0).to_pylist()):
                n = struct.unpack(">i", _bytes(p, 0, 4))[0]
                where, inner = located(p)
                tail = _bytes(p, 4 + 8 * n, where.get_file_info(inner).size - 4 - 8 * n)
                _, table, names = formats.read_annot(struct.pack(">i", 0) + tail)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), *[pa.array(table[:, c]) for c in range(4)], pa.array(table[:, 4].astype(float))], names=["path", "index", "name", "r", "g", "b", "t", "value"])

    paths = files(path)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(decode, schema)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(path, v_id, value, index, name): an annotation joined with its colour table; index -1 and no name for colours that it lacks."""
    labels = spark.read.format("vertexmap").option("kind", "annot").load(path)
    named = colour_table(spark, path).where("name <> ''").groupBy("path", "value").agg(F.min(F.struct("index", "name")).alias("r"))
    joined = labels.join(named, ["path", "value"], "left")
    return joined.select("path", "v_id", F.col("value").cast("bigint").alias("value"), F.coalesce("r.index", F.lit(-1)).alias("index"), F.col("r.name").alias("name"))


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, v_id, x, y, z, value) of label text files: the lines of five numbers."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("p"))
    rows = lines.where((F.size("p") == 5) & ~F.startswith(F.col("p")[0], F.lit("#")))
    return rows.select("path", F.col("p")[0].cast("bigint").alias("v_id"), *[F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "value"))])


# ------------------------------------------------------------------ writers


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FileWriter(DataSourceArrowWriter):
    """A task gathers the rows of each of its files, and writes them under a name of the attempt; the commit renames."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.kind, self.overwrite, self.run = options["path"].rstrip("/"), options.get("kind"), overwrite, uuid.uuid4().hex

    def encode(self, name: str, table: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = list(iterator)
        done = []
        if batches:
            table = pa.Table.from_batches(batches)
            for name in sorted(set(table.column("path").to_pylist())):
                rows = table.filter(pc.equal(table.column("path"), name))
                final = f"{self.folder}/{name}"
                temporary = f"{self.folder}/_{self.run}-{uuid.uuid4().hex}"
                where, inner = located(temporary)
                where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(inner) as out:
                    out.write(self.encode(name, rows))
                done.append((temporary, final))
        return _Written(done)

    def commit(self, messages) -> None:
        found = [pair for m in messages if m is not None for pair in m.files]
        names = [final for _, final in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file came from several tasks: repartition by path before writing")
        for temporary, final in found:
            where, inner = located(final)
            if where.get_file_info(inner).type != fs.FileType.NotFound:
                if not self.overwrite:
                    self.abort(messages)
                    raise FileExistsError(final)
                where.delete_file(inner)
            where.move(located(temporary)[1], inner)

    def abort(self, messages) -> None:
        for m in messages:
            for temporary, _ in m.files if m is not None else []:
                where, inner = located(temporary)
                if where.get_file_info(inner).type != fs.FileType.NotFound:
                    where.delete_file(inner)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _MapWriter(_FileWriter):
    def encode(self, name: str, table: pa.Table) -> bytes:
        kind = self.kind or "morph"
        cols, ids, values = _column(table, "col"), _column(table, "v_id"), _column(table, "value")
        maps = []
        for c in np.unique(cols):
            order = np.argsort(ids[cols == c], kind="stable")
            if (ids[cols == c][order] != np.arange(len(order))).any():
                raise ValueError(f"{name}: a map file needs the vertices 0 to n - 1, each once")
            maps.append(values[cols == c][order])
        if kind == "gii":
            return formats.write_gifti_maps(maps)
        if len(maps) != 1:
            raise ValueError(f"{name}: a {kind} file holds one map")
        return formats.write_morph(maps[0])


class _Spool:
    """The rows of one part of a file, in a file of the task: ids, and values beside them."""

    def __init__(self, folder: str, name: str, dtype: type):
        self.ids, self.values = f"{folder}/{name}-ids", f"{folder}/{name}-values"
        self.dtype, self.width, self.count, self.last = np.dtype(dtype), 0, 0, None
        self.sorted = self.dense = True

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        if not len(ids):
            return
        if self.width not in (0, values.shape[1]):
            raise ValueError("faces of a file have the same number of corners")
        self.sorted &= bool((ids[1:] >= ids[:-1]).all()) and (self.last is None or self.last <= ids[0])
        self.dense &= bool((ids == np.arange(self.count, self.count + len(ids))).all())
        self.width, self.count, self.last = values.shape[1], self.count + len(ids), ids[-1]
        for path, x in ((self.ids, ids), (self.values, values)):
            with open(path, "ab") as f:
                f.write(np.ascontiguousarray(x).tobytes())

    def order(self) -> np.ndarray | None:
        """Places of the rows in order of their ids, where they came in another."""
        return None if self.sorted else np.argsort(np.fromfile(self.ids, np.int64), kind="stable")

    def sorted_ids(self) -> np.ndarray | None:
        """Ids in order; None if they are 0 to n - 1 in order."""
        return None if self.dense else np.sort(np.fromfile(self.ids, np.int64))

    def blocks(self) -> Iterator[np.ndarray]:
        """Values in order of the ids, a batch of rows at a time."""
        order = self.order()
        for first in range(0, self.count, formats.BATCH):
            if order is None:
                n = min(formats.BATCH, self.count - first) * self.width
                yield np.fromfile(self.values, self.dtype, n, offset=first * self.width * self.dtype.itemsize).reshape(-1, self.width)
            else:
                whole = np.memmap(self.values, self.dtype, "r", shape=(self.count, self.width))
                yield whole[order[first : first + formats.BATCH]]


class _SurfaceWriter(_FileWriter):
    """Rows are spooled to the task's disk and encoded from there in pieces, whatever their number and order."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, spools = [], {}
        with tempfile.TemporaryDirectory() as own:
            for batch in iterator:
                for name in pc.unique(batch.column("path")).to_pylist():
                    if name not in spools:
                        spools[name] = (_Spool(own, f"{len(spools)}-v", np.float64), _Spool(own, f"{len(spools)}-f", np.int64))
                    for part, spool in zip("vf", spools[name]):
                        rows = batch.filter(pc.and_(pc.equal(batch.column("path"), name), pc.equal(batch.column("part"), part)))
                        columns = [rows.column(k) for k in ("xyz" if part == "v" else "abcd")]
                        columns = [c for c in columns if part == "v" or c.null_count < len(c)]
                        if rows.num_rows:
                            spool.add(rows.column("id").to_numpy(), np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).astype(spool.dtype))
            for name in sorted(spools):
                temporary = f"{self.folder}/_{self.run}-{uuid.uuid4().hex}"
                where, inner = located(temporary)
                where.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(inner) as out:
                    for piece in self.pieces(name, *spools[name]):
                        out.write(piece)
                done.append((temporary, f"{self.folder}/{name}"))
        return _Written(done)

    def pieces(self, name: str, vertices: _Spool, faces: _Spool) -> Iterator[bytes]:
        ids = vertices.sorted_ids()
        numbered = faces.blocks() if ids is None else (np.searchsorted(ids, f) for f in faces.blocks())
        layout = formats.LAYOUTS[self.kind or formats.extension(name)]
        return layout.pieces(vertices.count, faces.count, faces.width or 3, vertices.blocks(), numbered)


class SurfaceSource(DataSource):
    """`spark.read.format("surface").load(paths)` and `df.write.format("surface").save(folder)`: rows of formats.SURFACE, `path` naming the file."""

    @classmethod
    def name(cls) -> str:
        return "surface"

    def schema(self) -> str:
        return formats.SURFACE

    def reader(self, schema) -> DataSourceReader:
        return _SurfaceReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _SurfaceWriter(self.options, overwrite)


@dataclass
class _File(InputPartition):
    path: str


class _SurfaceReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options.get("path") or options["paths"], options.get("kind")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        where, inner = located(partition.path)
        with where.open_input_file(inner) as f:
            yield from formats._rows(partition.path, *formats.read_surface_bytes(f.read(), partition.path, self.kind))


def write_maps(maps: DataFrame, folder: str, kind: str = "morph", mode: str = "append") -> None:
    """A file per `path` of (path, v_id, value), or (path, v_id, col, value); the rows of a file meet in one task."""
    rows = maps if "col" in maps.columns else maps.withColumn("col", F.lit(0))
    rows.selectExpr("path", "cast(v_id AS bigint) AS v_id", "cast(col AS int) AS col", "cast(value AS double) AS value").repartition("path").write.format("vertexmap").option("kind", kind).mode(mode).save(folder)


def mesh_rows(mesh, name: str) -> DataFrame:
    """The rows of formats.SURFACE of a mesh, for a file called `name`."""
    none = lambda *cs: [F.lit(None).cast("double" if c in "xyz" else "bigint").alias(c) for c in cs]
    v = mesh.vertices.select(F.lit(name).alias("path"), F.lit("v").alias("part"), F.col("v_id").alias("id"), *[F.col(k).cast("double").alias(k) for k in "xyz"], *none(*"abcd"))
    f = mesh.faces.select(F.lit(name).alias("path"), F.lit("f").alias("part"), F.col("f_id").alias("id"), *none(*"xyz"), *[F.col(k) for k in mesh.corners], *none(*"abcd"[mesh.polyshape :]))
    return v.unionByName(f)


def write_meshes(rows: DataFrame, folder: str, kind: str | None = None, mode: str = "append") -> None:
    """A file per `path` of rows of formats.SURFACE, which a task gets in order of id, so that it holds none of them."""
    out = rows.repartition("path").sortWithinPartitions("path", "part", "id").write.format("surface").mode(mode)
    (out.option("kind", kind) if kind else out).save(folder)


def register(spark: SparkSession) -> None:
    for source in (SurfaceSource, VertexMapSource):
        spark.dataSource.register(source)
