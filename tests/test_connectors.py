"""Round trips through `df.write.format` and `spark.read.format`."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessellar.plans import fixtures as fx
from tessellar.sources import connectors, formats


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    formats.register(spark)


def _maps(spark, n=50, files=3):
    return spark.range(n * files).select(F.concat(F.lit("m"), F.col("id") % files, F.lit(".curv")).alias("path"), F.floor(F.col("id") / files).alias("v_id"), (F.col("id") * 0.25 - 3).alias("value"))


def test_morph_maps_by_ranges(spark, tmp_path):
    folder = str(tmp_path / "maps")
    connectors.write_maps(_maps(spark), folder)
    assert sorted(os.listdir(folder)) == ["m0.curv", "m1.curv", "m2.curv"]
    back = spark.read.format("vertexmap").option("vertices", 20).load(folder)
    assert back.rdd.getNumPartitions() == 9
    got = {(r.path.rsplit("/", 1)[-1], r.v_id, r.value) for r in back.collect()}
    assert got == {tuple(r) for r in _maps(spark).collect()}


def test_gifti_maps_and_old_morph(spark, tmp_path):
    two = _maps(spark, 10, 1).select("path", "v_id", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("value").alias("value")), F.struct(F.lit(1).alias("col"), (F.col("value") * 2).alias("value")))).alias("e")).select("path", "v_id", "e.*")
    connectors.write_maps(two, str(tmp_path / "g"), "gii")
    got = sorted((r.v_id, r.col, r.value) for r in spark.read.format("vertexmap").option("kind", "gii").load(str(tmp_path / "g")).collect())
    assert got == sorted((r.v_id, r.col, r.value) for r in two.collect())
    old = tmp_path / "old"
    old.write_bytes((3).to_bytes(3, "big") + (1).to_bytes(3, "big") + np.array([150, -25, 0], ">i2").tobytes())
    assert [r.value for r in spark.read.format("vertexmap").load(str(old)).orderBy("v_id").collect()] == [1.5, -0.25, 0.0]


def test_annotation_joined_with_its_table(spark, tmp_path):
    table = np.array([[10, 20, 30, 0], [255, 0, 7, 0]])
    index = np.array([0, 1, 1, -1, 0])
    (tmp_path / "lh.annot").write_bytes(formats.write_annot(index, table, ["one", "two"]))
    rows = connectors.read_annotation(spark, str(tmp_path / "lh.annot")).orderBy("v_id").collect()
    assert [r["index"] for r in rows] == index.tolist()
    assert [r.name for r in rows] == ["one", "two", "two", None, "one"]
    assert rows[1].value == 255 + (0 << 8) + (7 << 16)


def test_old_colour_table(spark, tmp_path):
    import struct

    text = lambda s: struct.pack(">i", len(s) + 1) + s.encode() + b"\0"
    data = struct.pack(">i", 2) + np.array([[0, 5], [1, 0]], ">i4").tobytes() + struct.pack(">ii", 1, 1) + text("table") + text("region") + struct.pack(">iiii", 5, 0, 0, 0)
    (tmp_path / "old.annot").write_bytes(data)
    rows = connectors.read_annotation(spark, str(tmp_path / "old.annot")).orderBy("v_id").collect()
    assert [(r.value, r["index"], r.name) for r in rows] == [(5, 0, "region"), (0, -1, None)]


def test_label_text(spark, tmp_path):
    ids, xyz = np.array([7, 3]), np.array([[1.0, 2, 3], [4, 5, 6]])
    (tmp_path / "a.label").write_bytes(formats.write_label(ids, xyz, np.array([0.5, 2])))
    rows = connectors.read_label_file(spark, str(tmp_path / "a.label")).orderBy("v_id").collect()
    assert [(r.v_id, r.x, r.z, r.value) for r in rows] == [(3, 4.0, 6.0, 2.0), (7, 1.0, 3.0, 0.5)]


@pytest.mark.parametrize("kind", ["gii", "fs", "asc", "vtk", "ply"])
def test_surfaces(spark, sf_dir, tmp_path, kind):
    mesh = fx.torus(spark, sf_dir)
    shifted = type(mesh)(mesh.vertices.withColumn("v_id", F.col("v_id") * 3 + 5), mesh.faces.select("f_id", *[(F.col(k) * 3 + 5).alias(k) for k in "abc"]))
    formats.write_surface(shifted, str(tmp_path / f"x.{kind}"))
    assert os.listdir(tmp_path) == [f"x.{kind}"]
    back = formats.read_surface(spark, str(tmp_path / f"x.{kind}"))
    assert sorted(map(tuple, back.faces.select("a", "b", "c").collect())) == sorted(map(tuple, mesh.faces.select("a", "b", "c").collect()))
    d = back.vertices.withColumnRenamed("x", "u").join(mesh.vertices, "v_id").agg(F.max(F.abs(F.col("u") - F.col("x"))).alias("d"), F.count("*").alias("n")).first()
    assert d.d < 1e-5 and d.n == mesh.vertices.count()
    rows = spark.read.format("surface").load(str(tmp_path))
    assert rows.where("part = 'f'").count() == mesh.faces.count()


def test_failures_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "x")
    connectors.write_maps(_maps(spark, 4, 1), folder)
    with pytest.raises(Exception, match="m0.curv"):
        connectors.write_maps(_maps(spark, 4, 1), folder)
    connectors.write_maps(_maps(spark, 5, 1), folder, mode="overwrite")
    assert spark.read.format("vertexmap").load(folder).count() == 5
    with pytest.raises(Exception, match="each once"):
        connectors.write_maps(_maps(spark, 4, 1).where("v_id <> 2"), str(tmp_path / "y"))
    assert os.listdir(folder) == ["m0.curv"]


def test_surfaces_in_pieces(spark, sf_dir, tmp_path, monkeypatch):
    """A writer's task holds no file as a whole, and rows may come in any order and with any ids."""
    monkeypatch.setattr(formats, "BATCH", 7)
    mesh = fx.torus(spark, sf_dir)
    shifted = type(mesh)(mesh.vertices.withColumn("v_id", F.col("v_id") * 3 + 5), mesh.faces.select("f_id", *[(F.col(k) * 3 + 5).alias(k) for k in "abc"]))
    rows = connectors.mesh_rows(shifted, "x.gii").orderBy(F.xxhash64("part", "id")).toArrow()
    xyz, faces = (np.stack([mesh_rows.column(k).to_numpy() for k in names], 1) for mesh_rows, names in ((mesh.vertices.orderBy("v_id").toArrow(), "xyz"), (mesh.faces.orderBy("f_id").toArrow(), "abc")))
    for kind in formats.LAYOUTS:
        sizes, layout = [], formats.LAYOUTS[kind]
        monkeypatch.setitem(formats.LAYOUTS, kind, formats.Layout(layout.frame, lambda v, f=layout.vertices: sizes.append(len(v)) or f(v), lambda v, f=layout.faces: sizes.append(len(v)) or f(v), layout.packed))
        writer = connectors._SurfaceWriter({"path": str(tmp_path / kind), "kind": kind}, False)
        writer.commit([writer.write(iter(rows.to_batches(max_chunksize=11)))])
        assert sum(sizes) == len(xyz) + len(faces) and max(sizes) == 7
        data = (tmp_path / kind / "x.gii").read_bytes()
        assert kind == "gii" or data == formats.WRITERS[kind](xyz, faces)
        back = formats.read_surface_bytes(data, "x", kind)
        assert np.allclose(back[0], xyz, atol=1e-5) and (back[1] == faces).all()


def test_surface_rows_come_in_batches(monkeypatch):
    monkeypatch.setattr(formats, "BATCH", 7)
    batches = list(formats._rows("x", np.arange(60.0).reshape(20, 3), np.arange(36).reshape(9, 4)))
    assert [b.num_rows for b in batches] == [7, 7, 6, 7, 2]
    ids = [b.column("id").to_pylist() for b in batches]
    assert sum(ids[:3], []) == list(range(20)) and sum(ids[3:], []) == list(range(9))
    assert batches[4].to_pylist()[1] == {"path": "x", "part": "f", "id": 8, "x": None, "y": None, "z": None, "a": 32, "b": 33, "c": 34, "d": 35}
