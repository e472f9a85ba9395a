"""File formats: exact round trips, and readers over Spark."""

import gzip
import struct

import numpy as np
import pytest

from tessellar.sources import formats

V = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0.5, 0.25, 2]], float)
T = np.array([[0, 1, 2], [1, 3, 2]])


@pytest.mark.parametrize("kind", ["gii", "fs", "asc", "vtk", "ply"])
def test_round_trip(kind):
    v, f = formats.read_surface_bytes(formats.WRITERS[kind](V, T), f"x.{kind}")
    assert np.allclose(v, V) and (f == T).all()


def test_gzip_and_unknown():
    v, _ = formats.read_surface_bytes(gzip.compress(formats.write_vtk(V, T)), "a/x.vtk.gz")
    assert np.allclose(v, V)
    with pytest.raises(ValueError):
        formats.read_surface_bytes(b"", "x.unknown")


def test_tetrahedra_in_vtk():
    cells = np.array([[0, 1, 2, 3]])
    assert (formats.read_vtk(formats.write_vtk(V, cells))[1] == cells).all()


def test_quads_split_by_parity():
    three = lambda x: int(x).to_bytes(3, "big")
    data = three(formats.QUAD) + three(4) + three(2) + (V * 100).astype(">i2").tobytes() + b"".join(map(three, [0, 1, 2, 3, 1, 2, 3, 0]))
    v, f = formats.read_fs(data)
    assert np.allclose(v, V) and f.tolist() == [[0, 1, 3], [2, 3, 1], [1, 2, 3], [1, 3, 0]]


def test_maps_labels_annotations():
    assert np.allclose(formats.read_morph(formats.write_morph([1.5, -2.0])), [1.5, -2.0])
    old = (2).to_bytes(3, "big") + (0).to_bytes(3, "big") + struct.pack(">hh", 150, -200)
    assert np.allclose(formats.read_morph(old), [1.5, -2.0])
    ids, scalars = formats.read_label(formats.write_label(np.array([3, 5]), V[:2], np.array([0.5, 1.0])))
    assert ids.tolist() == [3, 5] and scalars.tolist() == [0.5, 1.0]
    table = np.array([[10, 20, 30, 0], [1, 2, 3, 0]])
    index, read, names = formats.read_annot(formats.write_annot(np.array([1, -1, 0]), table, ["one", "two"]))
    assert index.tolist() == [1, -1, 0] and names == ["one", "two"] and read[0, 4] == 10 + (20 << 8) + (30 << 16)
    assert formats.volume_info(b"\x00\x01valid = 1\nvolume = 2 2 2\n") == {"valid": "1", "volume": "2 2 2"}


def test_spark_readers(spark, tmp_path):
    for kind in ("gii", "vtk"):
        (tmp_path / f"m.{kind}").write_bytes(formats.WRITERS[kind](V, T))
    mesh = formats.read_surface(spark, str(tmp_path / "m.gii"))
    assert mesh.vertices.count() == 4 and mesh.area().first()[0] > 0
    formats.register(spark)
    rows = spark.read.format("surface").option("paths", f"{tmp_path}/m.gii,{tmp_path}/m.vtk").load()
    assert rows.groupBy("part").count().orderBy("part").collect()[0]["count"] == 4
    formats.convert_surface(spark, str(tmp_path / "m.vtk"), str(tmp_path / "n.ply"))
    assert np.allclose(formats.read_ply((tmp_path / "n.ply").read_bytes())[0], V)


def test_text_maps(spark, tmp_path):
    (tmp_path / "map.txt").write_text("1.5\n-2\n3e1\n")
    rows = formats.read_data(spark, str(tmp_path / "map.txt")).orderBy("v_id").collect()
    assert [(r.v_id, r.value) for r in rows] == [(0, 1.5), (1, -2.0), (2, 30.0)]
    formats.write_data(spark.createDataFrame([(r.v_id, r.value) for r in rows], "v_id bigint, value double"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
