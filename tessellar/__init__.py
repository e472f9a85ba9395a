"""Mesh, map, graph and volume analytics expressed as Spark DataFrame plans."""
