"""Session helpers: the shared folder, lineage cuts, row keys and bucket counts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        current = context.getCheckpointDir()
        if current is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessellar-"))
            current = context.getCheckpointDir()
        folder = current
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which by itself may be
    long after a step has ended; a step's files would then lie beside the next one's.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """End the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    release(spark)
    return out


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written once as Parquet in the shared folder."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Hash buckets of a blob shuffle: one per shuffle partition, so a bucket's size follows the session's partition size."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_uid(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by content: rows equal in id and text share it, and share every per-document result."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())


def wide_key(id_col: str, text_col: str) -> Column:
    """128-bit key of a row by content; rows equal in id and text share it."""
    doc_id, text = F.col(id_col).cast("bigint").cast("string"), F.col(text_col).cast("string")
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(doc_id, F.lit("null")), F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit("")))))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    name = f"_{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`docs` with the row key in a new column, and that column's name."""
    name = fresh(docs, "uid")
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    return docs.withColumn(name, F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull())), name
