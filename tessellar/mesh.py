"""`Mesh`: a vertex table and a face table, with the operators as methods.

vertices: v_id bigint, x, y, z double and any data columns; faces: f_id bigint
and corners a, b, c (triangles) or a, b, c, d (tetrahedra). Ids are explicit
and nothing depends on row order. Every operation returns a new Mesh or frame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = "abcd"
#: vertices, with the faces and sides around them, that a task of a mesh of known size works on
TASK_VERTICES = 25_000


class Mesh:
    def __init__(self, vertices: DataFrame, faces: DataFrame, tasks: int | None = None):
        for c in ("v_id", "x", "y", "z"):
            if c not in vertices.columns:
                raise ValueError(f"vertices need a column {c}")
        for c in ("f_id", "a", "b", "c"):
            if c not in faces.columns:
                raise ValueError(f"faces need a column {c}")
        self.vertices, self.faces, self.tasks = vertices, faces, tasks

    def spread(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows dealt by `keys` to as many tasks as suit the mesh, where its size is known; the session's number of shuffle partitions need not."""
        return rows.repartition(self.tasks, *keys) if self.tasks and self.tasks > 1 else rows

    @property
    def polyshape(self) -> int:
        """Corners of a face: 3 or 4."""
        return 4 if "d" in self.faces.columns else 3

    @property
    def corners(self) -> list[str]:
        return list(CORNERS[: self.polyshape])

    @property
    def data_columns(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in ("v_id", "x", "y", "z")]

    @classmethod
    def tasks_for(cls, n_vertices: int) -> int:
        return max(-(-n_vertices // TASK_VERTICES), 1)

    @cached_property
    def edges(self) -> DataFrame:
        from tessellar.operators import topology

        return topology.edges(self)

    def validated(self) -> "Mesh":
        """Raise if a face names a vertex that is not there, or an id repeats."""
        from tessellar.operators import topology

        problems = topology.violations(self).first()
        if problems.dangling or problems.repeated:
            raise ValueError(f"{problems.dangling} corners without a vertex, {problems.repeated} repeated vertex ids")
        return self

    def with_vertex_data(self, name: str, data: DataFrame) -> "Mesh":
        """Attach column `name` of `data` (v_id, name) to the vertices."""
        return Mesh(self.vertices.drop(name).join(data.select("v_id", name), "v_id", "left"), self.faces)

    def drop_vertex_data(self, *names: str) -> "Mesh":
        return Mesh(self.vertices.drop(*names), self.faces)

    def vertex_data(self, name: str) -> DataFrame:
        if name not in self.data_columns:
            raise KeyError(name)
        return self.vertices.select("v_id", name)

    def cell_types(self) -> DataFrame:
        """See `tessellar.operators.topology.cell_types`; all faces of a mesh are of one type."""
        from tessellar.operators import topology

        return topology.cell_types(self.faces.select(F.array(*"abcd"[: self.polyshape]).alias("cell")))

    def parcellate(self, by: str = "label", value: str = "value", *keys: str) -> DataFrame:
        """See `tessellar.operators.editing.parcellate`, over the vertex data."""
        from tessellar.operators import editing

        return editing.parcellate(self.vertices, by, value, *keys)

    def transform(self, function, *args, **options):
        """Chain: `mesh.transform(editing.refine, 2)`."""
        return function(self, *args, **options)


def _delegate(module: str, *names: str) -> None:
    import importlib

    for name in names:

        def method(self, *args, _name=name, **options):
            return getattr(importlib.import_module(f"tessellar.operators.{module}"), _name)(self, *args, **options)

        method.__name__ = name
        method.__doc__ = f"See `tessellar.operators.{module}.{name}`."
        setattr(Mesh, name, method)


_delegate("topology", "half_edges", "vertex_face_counts", "vertex_degrees", "vertex_neighbors", "is_closed", "is_manifold", "is_oriented", "euler", "has_free_vertices", "remove_free_vertices", "boundary_edges", "boundary_loops", "edge_flags", "topology_summary")
_delegate("metrics", "tria_areas", "tria_normals", "tria_qualities", "vertex_areas", "vertex_normals", "area", "volume", "centroid", "average_edge_length", "normalize", "unit_normalize", "euclidean_distmat")
_delegate("editing", "apply_mask", "threshold_surface", "threshold_minimum", "combine_surfaces", "split_surface", "sort_verts", "decimate", "refine", "to_triangular", "threshold_data")
_delegate("graphs", "connected_components", "shortest_path_length", "clustering_coefficient", "rich_club", "smooth", "orient", "modularity")
_delegate("spectral", "fem_stiffness", "fem_mass", "eigenmodes", "heat_diffusion", "geodesic_distance", "geodesic_knn", "curvature")
