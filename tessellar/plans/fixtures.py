"""Meshes, matrices, maps and volumes derived from the supplied tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.mesh import Mesh
from tessellar.operators.pairs import top_products

WIDTH = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Parts as grid cells (v_id, gi, gj, w, label) and the number of rows of the grid."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    height = part.count() // WIDTH  # read from the file's metadata
    cells = part.where(F.col("p_partkey") < WIDTH * height).select(
        F.col("p_partkey").alias("v_id"),
        (F.col("p_partkey") % WIDTH).alias("gi"),
        F.expr(f"p_partkey div {WIDTH}").alias("gj"),
        F.col("p_retailprice").cast("double").alias("w"),
        F.col("p_size").alias("label"),
    )
    # a narrow file is one task, however many faces come of it
    tasks = Mesh.tasks_for(WIDTH * height)
    return cells.repartition(tasks, "v_id") if tasks > 1 else cells, height


def _cell_faces(cells: DataFrame, height: int, wrap: bool) -> DataFrame:
    """Two triangles per grid cell; f_id = 2 v_id and 2 v_id + 1."""
    right = F.col("gi") + 1
    up = F.col("gj") + 1
    if wrap:
        right, up = right % WIDTH, up % height
    else:
        cells = cells.where((F.col("gi") < WIDTH - 1) & (F.col("gj") < height - 1))
    at = lambda i, j: (j * WIDTH + i).cast("bigint")
    p00, p10, p01, p11 = at(F.col("gi"), F.col("gj")), at(right, F.col("gj")), at(F.col("gi"), up), at(right, up)
    base = F.col("v_id") * 2
    return cells.select(F.inline(F.array(F.struct(base.alias("f_id"), p00.alias("a"), p10.alias("b"), p11.alias("c")), F.struct((base + 1).alias("f_id"), p00.alias("a"), p11.alias("b"), p01.alias("c")))))


def torus(spark: SparkSession, sf_dir: str, bump: float = 0.0) -> Mesh:
    """closed torus of radii 3 and 1; `bump` scales the tube by the vertex weight to break its symmetry."""
    cells, height = _grid(spark, sf_dir)
    u, v = 2 * F.pi() * F.col("gi") / WIDTH, 2 * F.pi() * F.col("gj") / height
    tube = 1 + bump * F.col("w")
    vertices = cells.select("v_id", ((3 + tube * F.cos(v)) * F.cos(u)).alias("x"), ((3 + tube * F.cos(v)) * F.sin(u)).alias("y"), (tube * F.sin(v)).alias("z"), "w", "label")
    return Mesh(vertices, _cell_faces(cells, height, True), Mesh.tasks_for(WIDTH * height))


def height_field(spark: SparkSession, sf_dir: str) -> Mesh:
    """open surface over the grid."""
    cells, height = _grid(spark, sf_dir)
    vertices = cells.select("v_id", F.col("gi").cast("double").alias("x"), F.col("gj").cast("double").alias("y"), (F.col("w") / 100).alias("z"), "w", "label")
    return Mesh(vertices, _cell_faces(cells, height, False), Mesh.tasks_for(WIDTH * height))


def slab(spark: SparkSession, sf_dir: str) -> Mesh:
    """tetrahedral slab between the height field and its copy one unit above."""
    flat = height_field(spark, sf_dir)
    cells, height = _grid(spark, sf_dir)
    n = WIDTH * height
    top = flat.vertices.withColumn("v_id", F.col("v_id") + n).withColumn("z", F.col("z") + 1)
    s = F.array_sort(F.array("a", "b", "c"))
    p, q, r = (F.element_at(s, i) for i in (1, 2, 3))
    corners = ((p, q, r, r + n), (p, q, q + n, r + n), (p, p + n, q + n, r + n))
    faces = flat.faces.select(F.inline(F.array(*[F.struct((F.col("f_id") * 3 + i).alias("f_id"), *[c.alias(name) for c, name in zip(cs, "abcd")]) for i, cs in enumerate(corners)])))
    return Mesh(flat.vertices.unionByName(top), faces, Mesh.tasks_for(6 * n))  # six tetrahedra a vertex, of four sides each


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertex-by-feature matrix (i, pos, value, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))


def nearest(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(i, j, w): the k vectors of largest product with each vector."""
    return top_products(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("e")), k)


def similarity(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """symmetric similarity graph, one row (i, j, w) per undirected edge with i < j."""
    return nearest(spark, sf_dir, k).groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("w").alias("w"))


def subject_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two groups of subjects with one value per hour of the day (grp, subject, v_id, value)."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return events.groupBy(F.col("user_id").alias("subject"), F.hour("ts").alias("v_id")).agg(F.avg("value").alias("value")).withColumn("grp", F.when(F.col("subject") % 2 == 0, "HC").otherwise("P")).select("grp", "subject", "v_id", "value")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels (vx, vy, vz, value) with value > 0."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("vx"), (F.col("l_quantity").cast("bigint") % 10).alias("vy"), F.col("l_linenumber").cast("bigint").alias("vz")).agg(F.count("*").alias("value"))
