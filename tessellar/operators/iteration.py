"""Fixed-point loops over frames, and written tables between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which driver and executors share; where it is unset, as in tests, a temporary folder, but only on a local master."""
    context = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessellar-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of a loop in the shared folder; a name's earlier table is deleted when its successor is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}-{uuid.uuid4().hex}", df.schema
        df.write.parquet(path)
        if old := self.paths.pop(name, None):
            self._delete(old)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def close(self, *keep: str) -> None:
        """Delete all tables but those named."""
        for name in [n for n in self.paths if n not in keep]:
            self._delete(self.paths.pop(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], max_rounds: int) -> DataFrame:
    """Apply `step` until `measure` stays the same; raise if it does not within `max_rounds`."""
    state = cut(state)
    seen = measure(state)
    for _ in range(max_rounds):
        state = cut(step(state))
        now = measure(state)
        if now == seen:
            return state
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
