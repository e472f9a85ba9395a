"""Surface, map, label and annotation files.

Pure functions turn bytes into arrays and back; `register` makes the readers and
writers of `tessellar.sources.connectors` known to a session.
"""

from __future__ import annotations

import base64
import gzip
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Surface = tuple[np.ndarray, np.ndarray]

#: fixed magic numbers of the FreeSurfer formats
QUAD, NEW_QUAD, TRIANGLE, CURVATURE = 16777215, 16777213, 16777214, 16777215


def uncompressed(data: bytes, path: str) -> tuple[bytes, str]:
    """(bytes, path) with a `.gz` layer removed."""
    return (gzip.decompress(data), path[:-3]) if path.endswith(".gz") else (data, path)


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


# GIFTI

_GIFTI_TYPES = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_FLOAT64": "f8"}


def gifti_arrays(data: bytes) -> list[tuple[str, np.ndarray]]:
    """(intent, array) of each data array."""
    out = []
    for node in ElementTree.fromstring(data).iter("DataArray"):
        kind = np.dtype(_GIFTI_TYPES[node.get("DataType")]).newbyteorder("<" if node.get("Endian", "LittleEndian") == "LittleEndian" else ">")
        shape = [int(node.get(f"Dim{i}")) for i in range(int(node.get("Dimensionality", "1")))]
        text = node.find("Data").text or ""
        encoding = node.get("Encoding")
        if encoding == "ASCII":
            array = np.array(text.split(), kind)
        else:
            raw = base64.b64decode(text)
            array = np.frombuffer(zlib.decompress(raw) if encoding == "GZipBase64Binary" else raw, kind)
        order = "F" if node.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"
        out.append((node.get("Intent"), array.reshape(shape, order=order)))
    return out


def read_gifti(data: bytes) -> Surface:
    arrays = dict(reversed(gifti_arrays(data)))
    return arrays["NIFTI_INTENT_POINTSET"].astype(float), arrays["NIFTI_INTENT_TRIANGLE"].astype(np.int64)


def write_gifti(vertices: np.ndarray, faces: np.ndarray, maps: list[np.ndarray] = ()) -> bytes:
    arrays = [("NIFTI_INTENT_POINTSET", vertices.astype("<f4")), ("NIFTI_INTENT_TRIANGLE", faces.astype("<i4"))] + [("NIFTI_INTENT_ESTIMATE", np.asarray(m, "<f4")) for m in maps]
    root = ElementTree.Element("GIFTI", Version="1.0", NumberOfDataArrays=str(len(arrays)))
    for intent, a in arrays:
        dims = {f"Dim{i}": str(n) for i, n in enumerate(a.shape)}
        kind = "NIFTI_TYPE_FLOAT32" if a.dtype.kind == "f" else "NIFTI_TYPE_INT32"
        node = ElementTree.SubElement(root, "DataArray", Intent=intent, DataType=kind, ArrayIndexingOrder="RowMajorOrder", Dimensionality=str(a.ndim), Encoding="GZipBase64Binary", Endian="LittleEndian", **dims)
        ElementTree.SubElement(node, "Data").text = base64.b64encode(zlib.compress(np.ascontiguousarray(a).tobytes())).decode()
    return b'<?xml version="1.0" encoding="UTF-8"?>\n' + ElementTree.tostring(root)


# FreeSurfer geometry


def _three(data: bytes, at: int, n: int = 1) -> np.ndarray:
    b = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3).astype(np.int64)
    return (b[:, 0] << 16) + (b[:, 1] << 8) + b[:, 2]


def read_fs(data: bytes) -> Surface:
    """ASCII, triangle or quad surface; a quad becomes two triangles, split by the parity of its first corner."""
    if data.startswith(b"#!ascii"):
        lines = data.decode().splitlines()
        n_v, n_f = map(int, lines[1].split()[:2])
        vertices = np.array([line.split()[:3] for line in lines[2 : 2 + n_v]], float).reshape(-1, 3)
        return vertices, np.array([line.split()[:3] for line in lines[2 + n_v : 2 + n_v + n_f]], np.int64).reshape(-1, 3)
    magic = int(_three(data, 0)[0])
    if magic == TRIANGLE:
        at = data.index(b"\n\n", 3) + 2
        n_v, n_f = struct.unpack_from(">ii", data, at)
        vertices = np.frombuffer(data, ">f4", 3 * n_v, at + 8).reshape(-1, 3).astype(float)
        return vertices, np.frombuffer(data, ">i4", 3 * n_f, at + 8 + 12 * n_v).reshape(-1, 3).astype(np.int64)
    if magic in (QUAD, NEW_QUAD):
        n_v, n_q = (int(x) for x in _three(data, 3, 2))
        if magic == QUAD:
            vertices = np.frombuffer(data, ">i2", 3 * n_v, 9).reshape(-1, 3) / 100.0
            at = 9 + 6 * n_v
        else:
            vertices = np.frombuffer(data, ">f4", 3 * n_v, 9).reshape(-1, 3).astype(float)
            at = 9 + 12 * n_v
        q = _three(data, at, 4 * n_q).reshape(-1, 4)
        even = (q[:, 0] % 2 == 0)[:, None, None]
        return vertices, np.where(even, q[:, [[0, 1, 3], [2, 3, 1]]], q[:, [[0, 1, 2], [0, 2, 3]]]).reshape(-1, 3)
    raise ValueError("no surface format known by these first bytes")


def write_fs(vertices: np.ndarray, faces: np.ndarray, ascii: bool = False, comment: str = "surface") -> bytes:
    if ascii:
        rows = ["#!ascii version of surface", f"{len(vertices)} {len(faces)}"]
        rows += ["%.6f %.6f %.6f 0" % tuple(v) for v in vertices]
        rows += ["%d %d %d 0" % tuple(f) for f in faces]
        return ("\n".join(rows) + "\n").encode()
    head = TRIANGLE.to_bytes(3, "big") + comment.encode() + b"\n\n"
    return head + struct.pack(">ii", len(vertices), len(faces)) + vertices.astype(">f4").tobytes() + faces.astype(">i4").tobytes()


def volume_info(data: bytes) -> dict[str, str]:
    """`key = value` lines of a geometry footer."""
    tail = data[data.rfind(b"valid =") :] if b"valid =" in data else b""
    return {k.strip(): v.strip() for k, v in (line.split("=", 1) for line in tail.decode("latin1").splitlines() if "=" in line)}


# VTK and PLY text


def read_vtk(data: bytes) -> Surface:
    tokens = data.decode().split()
    at = tokens.index("POINTS")
    n_v = int(tokens[at + 1])
    vertices = np.array(tokens[at + 3 : at + 3 + 3 * n_v], float).reshape(-1, 3)
    at = next(tokens.index(k) for k in ("POLYGONS", "CELLS") if k in tokens)
    n_f, size = int(tokens[at + 1]), int(tokens[at + 2])
    cells = np.array(tokens[at + 3 : at + 3 + size], np.int64)
    return vertices, cells.reshape(n_f, -1)[:, 1:] if n_f else np.empty((0, 3), np.int64)


def write_vtk(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    k = faces.shape[1]
    kind, name = ("UNSTRUCTURED_GRID", "CELLS") if k == 4 else ("POLYDATA", "POLYGONS")
    rows = ["# vtk DataFile Version 2.0", "surface", "ASCII", f"DATASET {kind}", f"POINTS {len(vertices)} float"]
    rows += [" ".join(repr(float(x)) for x in v) for v in vertices]
    rows.append(f"{name} {len(faces)} {len(faces) * (k + 1)}")
    rows += [" ".join(map(str, [k, *f])) for f in faces.tolist()]
    if k == 4:
        rows += [f"CELL_TYPES {len(faces)}", *["10"] * len(faces)]
    return ("\n".join(rows) + "\n").encode()


def read_ply(data: bytes) -> Surface:
    head, _, body = data.decode().partition("end_header\n")
    counts = {line.split()[1]: int(line.split()[2]) for line in head.splitlines() if line.startswith("element")}
    lines = body.splitlines()
    n_v = counts["vertex"]
    return np.array([x.split()[:3] for x in lines[:n_v]], float).reshape(-1, 3), np.array([x.split()[1:4] for x in lines[n_v : n_v + counts["face"]]], np.int64).reshape(-1, 3)


def write_ply(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    rows = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *[f"property double {k}" for k in "xyz"], f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    rows += [" ".join(repr(float(x)) for x in v) for v in vertices] + [" ".join(map(str, [len(f), *f])) for f in faces.tolist()]
    return ("\n".join(rows) + "\n").encode()


# surfaces in pieces


@dataclass
class Layout:
    """A format as a frame (head, middle, tail) of the numbers of vertices, faces and corners, and pieces of rows between its parts."""

    frame: Callable[[int, int, int], tuple[bytes, bytes, bytes]]
    vertices: Callable[[np.ndarray], bytes]
    faces: Callable[[np.ndarray], bytes]
    packed: bool = False

    def pieces(self, n_v: int, n_f: int, corners: int, vertices: Iterable[np.ndarray], faces: Iterable[np.ndarray]) -> Iterator[bytes]:
        """The bytes of a file, whose rows come in blocks."""
        pack = _packed if self.packed else iter
        head, middle, tail = self.frame(n_v, n_f, corners)
        yield head
        yield from pack(map(self.vertices, vertices))
        yield middle
        yield from pack(map(self.faces, faces))
        yield tail


def _packed(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Compressed and in base 64."""
    squeeze, left = zlib.compressobj(), b""
    for piece in pieces:
        left += squeeze.compress(piece)
        whole = len(left) // 3 * 3
        yield base64.b64encode(left[:whole])
        left = left[whole:]
    yield base64.b64encode(left + squeeze.flush())


def _lines(rows: list[str]) -> bytes:
    return "".join(f"{row}\n" for row in rows).encode()


def _gifti_frame(n_v: int, n_f: int, k: int) -> tuple[bytes, bytes, bytes]:
    node = '<DataArray Intent="NIFTI_INTENT_{}" DataType="NIFTI_TYPE_{}" ArrayIndexingOrder="RowMajorOrder" Dimensionality="2" Encoding="GZipBase64Binary" Endian="LittleEndian" Dim0="{}" Dim1="{}"><Data>'
    end = "</Data></DataArray>"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<GIFTI Version="1.0" NumberOfDataArrays="2">' + node.format("POINTSET", "FLOAT32", n_v, 3)
    return head.encode(), (end + node.format("TRIANGLE", "INT32", n_f, k)).encode(), (end + "</GIFTI>").encode()


def _vtk_frame(n_v: int, n_f: int, k: int) -> tuple[bytes, bytes, bytes]:
    kind, name = ("UNSTRUCTURED_GRID", "CELLS") if k == 4 else ("POLYDATA", "POLYGONS")
    head = _lines(["# vtk DataFile Version 2.0", "surface", "ASCII", f"DATASET {kind}", f"POINTS {n_v} float"])
    return head, _lines([f"{name} {n_f} {n_f * (k + 1)}"]), (f"CELL_TYPES {n_f}\n".encode() + b"10\n" * n_f if k == 4 else b"")


def _ply_frame(n_v: int, n_f: int, k: int) -> tuple[bytes, bytes, bytes]:
    return _lines(["ply", "format ascii 1.0", f"element vertex {n_v}", *[f"property double {c}" for c in "xyz"], f"element face {n_f}", "property list uchar int vertex_indices", "end_header"]), b"", b""


def _points(v: np.ndarray) -> bytes:
    return _lines([" ".join(repr(x) for x in row) for row in v.tolist()])


def _counted(f: np.ndarray) -> bytes:
    return _lines([" ".join(map(str, [len(row), *row])) for row in f.tolist()])


LAYOUTS: dict[str, Layout] = {
    "gii": Layout(_gifti_frame, lambda v: v.astype("<f4").tobytes(), lambda f: f.astype("<i4").tobytes(), True),
    "fs": Layout(lambda n_v, n_f, k: (TRIANGLE.to_bytes(3, "big") + b"surface\n\n" + struct.pack(">ii", n_v, n_f), b"", b""), lambda v: v.astype(">f4").tobytes(), lambda f: f.astype(">i4").tobytes()),
    "asc": Layout(lambda n_v, n_f, k: (_lines(["#!ascii version of surface", f"{n_v} {n_f}"]), b"", b""), lambda v: _lines(["%.6f %.6f %.6f 0" % tuple(row) for row in v.tolist()]), lambda f: _lines(["%d %d %d 0" % tuple(row) for row in f.tolist()])),
    "vtk": Layout(_vtk_frame, _points, _counted),
    "ply": Layout(_ply_frame, _points, _counted),
}

READERS: dict[str, Callable[[bytes], Surface]] = {"gii": read_gifti, "fs": read_fs, "asc": read_fs, "pial": read_fs, "white": read_fs, "vtk": read_vtk, "ply": read_ply}
WRITERS: dict[str, Callable[[np.ndarray, np.ndarray], bytes]] = {"gii": write_gifti, "fs": write_fs, "asc": lambda v, f: write_fs(v, f, True), "vtk": write_vtk, "ply": write_ply}


def read_surface_bytes(data: bytes, path: str, kind: str | None = None) -> Surface:
    data, path = uncompressed(data, path)
    kind = kind or extension(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; known: {sorted(READERS)}")
    return READERS[kind](data)


def write_gifti_maps(maps: list[np.ndarray]) -> bytes:
    """A GIFTI file of one float array per map, without a surface."""
    parts = []
    for values in maps:
        raw = base64.b64encode(zlib.compress(np.asarray(values, "<f4").tobytes())).decode()
        parts.append(f'<DataArray Intent="NIFTI_INTENT_NONE" DataType="NIFTI_TYPE_FLOAT32" ArrayIndexingOrder="RowMajorOrder" Dimensionality="1" Dim0="{len(values)}" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{raw}</Data></DataArray>')
    return ('<?xml version="1.0" encoding="UTF-8"?><GIFTI Version="1.0" NumberOfDataArrays="' + str(len(parts)) + '">' + "".join(parts) + "</GIFTI>").encode()


# labels, curvature, annotation


def read_label(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vertex ids, scalars) after two header lines."""
    rows = [line.split() for line in data.decode().splitlines()[2:] if line.strip()]
    return np.array([r[0] for r in rows], np.int64), np.array([r[-1] for r in rows], float)


def write_label(ids: np.ndarray, xyz: np.ndarray, scalars: np.ndarray) -> bytes:
    rows = ["#!ascii label", str(len(ids))] + [f"{i} {x:.6f} {y:.6f} {z:.6f} {s:.6f}" for i, (x, y, z), s in zip(ids.tolist(), xyz, scalars)]
    return ("\n".join(rows) + "\n").encode()


def read_morph(data: bytes) -> np.ndarray:
    """Values per vertex: new format float, old format hundredths."""
    if int(_three(data, 0)[0]) == CURVATURE:
        return np.frombuffer(data, ">f4", struct.unpack_from(">i", data, 3)[0], 15).astype(float)
    return np.frombuffer(data, ">i2", int(_three(data, 0)[0]), 6) / 100.0


def write_morph(values: np.ndarray, n_faces: int = 0) -> bytes:
    return CURVATURE.to_bytes(3, "big") + struct.pack(">iii", len(values), n_faces, 1) + np.asarray(values, ">f4").tobytes()


def read_annot(data: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(table index per vertex, -1 if none; table of r, g, b, t, value; names), old and new table layout."""
    n = struct.unpack_from(">i", data, 0)[0]
    pairs = np.frombuffer(data, ">i4", 2 * n, 4).reshape(-1, 2)
    labels = np.zeros(n, np.int64)
    labels[pairs[:, 0]] = pairs[:, 1]
    at = 4 + 8 * n
    flag, count = struct.unpack_from(">ii", data, at)
    if not flag:
        raise ValueError("no colour table")
    at += 8
    table, names = [], []

    def text(position: int) -> tuple[str, int]:
        size = struct.unpack_from(">i", data, position)[0]
        return data[position + 4 : position + 4 + size].rstrip(b"\0").decode(), position + 4 + size

    if count > 0:
        _, at = text(at)
        places = range(count)
    else:
        size = struct.unpack_from(">i", data, at)[0]
        _, at = text(at + 4)
        places = range(struct.unpack_from(">i", data, at)[0])
        at += 4
        table = [[0, 0, 0, 0, 0]] * size
        names = [""] * size
    for _ in places:
        index = None
        if count <= 0:
            index = struct.unpack_from(">i", data, at)[0]
            at += 4
        name, at = text(at)
        r, g, b, t = struct.unpack_from(">iiii", data, at)
        at += 16
        row = [r, g, b, t, r + (g << 8) + (b << 16)]
        if index is None:
            table.append(row)
            names.append(name)
        else:
            table[index], names[index] = row, name
    table = np.array(table, np.int64)
    where = {int(v): i for i, v in reversed(list(enumerate(table[:, 4]))) if names[i]}
    return np.array([where.get(int(v), -1) for v in labels]), table, names


def write_annot(index: np.ndarray, table: np.ndarray, names: list[str]) -> bytes:
    values = np.where(index >= 0, table[np.maximum(index, 0), 0] + (table[np.maximum(index, 0), 1] << 8) + (table[np.maximum(index, 0), 2] << 16), 0)
    out = struct.pack(">i", len(index)) + np.stack([np.arange(len(index)), values], 1).astype(">i4").tobytes()
    out += struct.pack(">iii", 1, -2, len(names)) + struct.pack(">i", 1) + b"\0" + struct.pack(">i", len(names))
    for i, name in enumerate(names):
        raw = name.encode() + b"\0"
        out += struct.pack(">ii", i, len(raw)) + raw + struct.pack(">iiii", *table[i, :4].tolist())
    return out


# Spark


def surfaces(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(path, part, id, x, y, z, a, b, c, d): vertices (part v) and faces (part f) of all surface files under `path`."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield from _rows(name, *read_surface_bytes(data, name, kind))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, SURFACE)


SURFACE = "path string, part string, id bigint, x double, y double, z double, a bigint, b bigint, c bigint, d bigint"
_SURFACE_ARROW = pa.schema([("path", pa.string()), ("part", pa.string()), ("id", pa.int64()), *((k, pa.float64()) for k in "xyz"), *((k, pa.int64()) for k in "abcd")])


#: rows of a surface in a batch
BATCH = 100_000


def _rows(name: str, vertices: np.ndarray, faces: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, rows in (("v", vertices), ("f", faces)):
        for first in range(0, len(rows), BATCH):
            yield _surface_batch(name, part, first, rows[first : first + BATCH])


def _surface_batch(name: str, part: str, first: int, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of SURFACE of vertices (part v) or faces (part f) that are numbered from `first` on."""
    n = len(rows)
    given = {c: pa.array(np.ascontiguousarray(rows[:, k]).astype(float if part == "v" else np.int64)) for k, c in enumerate("xyz" if part == "v" else "abcd"[: rows.shape[1]])}
    rest = {c: given.get(c, pa.nulls(n, pa.float64() if c in "xyz" else pa.int64())) for c in "xyzabcd"}
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(np.arange(first, first + n)), *rest.values()], schema=_SURFACE_ARROW)


def read_surface(spark: SparkSession, path: str, kind: str | None = None):
    """A Mesh of one surface file; tetrahedra keep their fourth corner."""
    from tessellar.mesh import Mesh

    rows = surfaces(spark, path, kind)
    faces = rows.where("part = 'f'")
    corners = ["a", "b", "c"] if faces.where("d IS NOT NULL").isEmpty() else ["a", "b", "c", "d"]
    return Mesh(rows.where("part = 'v'").select("id", "x", "y", "z").withColumnRenamed("id", "v_id"), faces.select("id", *corners).withColumnRenamed("id", "f_id"))


def write_surface(mesh, path: str, kind: str | None = None) -> None:
    """One surface file, written by one task in pieces; a file format holds one mesh, so use Parquet for meshes beyond a task's time."""
    from tessellar.sources import connectors

    register(mesh.vertices.sparkSession)
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    connectors.write_meshes(connectors.mesh_rows(mesh, name), folder, kind, "overwrite")


def convert_surface(spark: SparkSession, source: str, target: str, kind: str | None = None, target_kind: str | None = None) -> None:
    write_surface(read_surface(spark, source, kind), target, target_kind)


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """(v_id, col, value) of a text map: one line per vertex, one or several columns."""
    from pyspark.sql import functions as F

    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("v_id", "line"))
    return lines.select(F.col("v_id").cast("bigint").alias("v_id"), F.posexplode(F.split(F.trim("line"), r"[\s,]+")).alias("col", "value")).withColumn("value", F.col("value").cast("double"))


def write_data(data: DataFrame, path: str) -> None:
    """Values of (v_id, value) in order of v_id, one line each, in one text file."""
    data.repartition(1).sortWithinPartitions("v_id").selectExpr("cast(value AS string)").write.text(path)


def register(spark: SparkSession) -> None:
    """Make the data sources known to the session."""
    from tessellar.sources import connectors

    connectors.register(spark)
