import numpy as np

from tessellar import __main__ as jobs
from tessellar.sources import formats

OCTAHEDRON = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)
SIDES = np.array([[0, 2, 4], [2, 1, 4], [1, 3, 4], [3, 0, 4], [2, 0, 5], [1, 2, 5], [3, 1, 5], [0, 3, 5]])


def test_jobs(spark, tmp_path):
    (tmp_path / "s.vtk").write_bytes(formats.write_vtk(OCTAHEDRON, SIDES))
    (tmp_path / "mask.txt").write_text("1\n1\n1\n1\n1\n0\n")
    jobs.main(["eigenmodes", str(tmp_path / "s.vtk"), str(tmp_path / "modes"), "--modes", "3", "--mask", str(tmp_path / "mask.txt")])
    modes = spark.read.parquet(str(tmp_path / "modes"))
    assert modes.count() == 18 and modes.where("v_id = 5 AND psi <> 0").count() == 0
    (tmp_path / "map.txt").write_text("9\n0\n0\n0\n0\n0\n")
    jobs.main(["threshold", str(tmp_path / "s.vtk"), str(tmp_path / "map.txt"), str(tmp_path / "cut"), "--fwhm", "1"])
    assert [r.value for r in spark.read.text(str(tmp_path / "cut")).collect()][0] == "9.0"
    jobs.main(["convert", str(tmp_path / "s.vtk"), str(tmp_path / "s.gii")])
    assert (formats.read_gifti((tmp_path / "s.gii").read_bytes())[1] == SIDES).all()
    maps = spark.createDataFrame([(i, p, float(np.sin(i * (p + 1)) + 2)) for i in range(8) for p in range(5)], "i bigint, pos int, value double")
    maps.write.parquet(str(tmp_path / "maps"))
    jobs.main(["gradients", str(tmp_path / "maps"), str(tmp_path / "g"), "--components", "2"])
    assert spark.read.parquet(str(tmp_path / "g")).count() == 16


def test_tetrahedra_keep_their_fourth_corner(spark, tmp_path):
    (tmp_path / "t.vtk").write_bytes(formats.write_vtk(OCTAHEDRON[:4], np.array([[0, 1, 2, 3]])))
    assert formats.read_surface(spark, str(tmp_path / "t.vtk")).polyshape == 4
