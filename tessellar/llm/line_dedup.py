"""Lines that many documents share, dropped from all of them.

Lines are exploded with their position, normalised and hashed; documents are
counted per hash; the positions of lines whose hash too many documents have go
back to their document, whose other lines are joined again in order.

Defined cases: a null or empty text is one empty line; a line without a key of
`min_chars` code points always stays; a document is a `doc_id`, and each text
of a row without one counts as a document of its own, so repeated rows count
once; repeated rows all give a row; very long texts cost their length; an empty
table gives no rows; columns of any other name are kept and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

MIN_DOCS = 10
MIN_CHARS = 1
#: a line with more than this share of all occurrences of dropped lines is broadcast: at most so many keys of 16 bytes
HEAVY = 4096

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, with A to Z lowered."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u1, u2, id, alone, text): a row's 128-bit key, its id, and for rows without an id a number per text."""
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    missing = F.concat_ws("", doc_id.isNull().cast("string"), text.isNull().cast("string"))
    return docs.select(
        F.xxhash64(doc_id, text, missing).alias("u1"),
        F.xxhash64(missing, text, doc_id).alias("u2"),
        doc_id.alias("id"),
        F.when(doc_id.isNull(), F.xxhash64(text)).alias("alone"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(u1, u2, id, alone, pos, h1, h2) of every line whose key is long enough; h1 and h2 hash the key."""
    lines = rows.select("u1", "u2", "id", "alone", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("u1", "u2", "id", "alone", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= max(min_chars, 0))
    return keyed.select("u1", "u2", "id", "alone", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n_docs, n_lines): hashes of lines in at least `min_docs` documents.

    Occurrences are counted per document before the shuffle and again after it,
    so a line that every document has arrives as one row per task.
    """
    lines = _lines(_rows(docs, id_col, text_col), min_chars)
    per_doc = lines.groupBy("h1", "h2", "id", "alone").agg(F.count("*").alias("n"))
    counted = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))
    return counted.where(F.col("n_docs") >= min_docs)


def _dropped(rows: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """(u1, u2, drop): sorted positions of the lines to drop, for rows with any.

    Lines with more than 1/HEAVY of all occurrences, HEAVY at most, are told by
    a broadcast; the others meet their hash in a join where each key is small.
    A line that the broadcast has told takes a key of its own place through
    that join, so that it lands anywhere.
    """
    total = shared.agg(F.sum("n_lines")).first()[0] or 0
    heavy = shared.where(F.col("n_lines") * HEAVY > F.lit(total)).select("h1", "h2", F.lit(True).alias("heavy"))
    light = shared.where(F.col("n_lines") * HEAVY <= F.lit(total)).select("h1", "h2", F.lit(False).alias("told"), F.lit(True).alias("light"))
    lines = _lines(rows, min_chars).join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("told", F.col("heavy").isNotNull())
    spread = lines.select("u1", "u2", "pos", "told", F.when(F.col("told"), F.xxhash64("u1", "pos")).otherwise(F.col("h1")).alias("h1"), "h2")
    hit = spread.join(light, ["h1", "h2", "told"], "left").where(F.col("told") | F.col("light"))
    # repeated rows have equal keys: their positions are one set
    return hit.groupBy("u1", "u2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def _marked(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """`docs` with the row's lines and the positions to drop (null for none) in two new columns."""
    rows = _rows(docs, id_col, text_col)
    shared = stored(frequent(docs, min_docs, min_chars, id_col=id_col, text_col=text_col), "line-hashes")
    lines, drop = fresh(docs, "lines"), fresh(docs, "drop")
    u1, u2 = fresh(docs, "u1"), fresh(docs, "u2")
    marks = _dropped(rows, shared, min_chars).select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("drop").alias(drop))
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    missing = F.concat_ws("", doc_id.isNull().cast("string"), text.isNull().cast("string"))
    keyed = docs.withColumn(u1, F.xxhash64(doc_id, text, missing)).withColumn(u2, F.xxhash64(missing, text, doc_id))
    out = keyed.join(marks, [u1, u2], "left").drop(u1, u2)
    return out.withColumn(lines, F.split(F.coalesce(text, F.lit("")), "\n", -1)), lines, drop


def _kept(lines: Column, drop: Column) -> Column:
    """Lines at other positions, joined: the runs between dropped positions, each copied once."""
    ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    runs = F.transform(F.sequence(F.lit(1), F.size(drop) + 1), lambda i: F.slice(lines, F.element_at(ends, i) + 2, F.element_at(ends, i + 1) - F.element_at(ends, i) - 1))
    return F.array_join(F.flatten(runs), "\n")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the lines that at least `min_docs` documents have; a text that loses none is unchanged."""
    marked, lines, drop = _marked(docs, min_docs, min_chars, id_col, text_col)
    text = F.when(F.col(drop).isNull(), F.col(text_col).cast("string")).otherwise(_kept(F.col(lines), F.col(drop)))
    return marked.withColumn(text_col, text).select(*docs.columns)


def report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row."""
    marked, lines, drop = _marked(docs, min_docs, min_chars, id_col, text_col)
    text = F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(_kept(F.col(lines), F.col(drop)))
    return marked.select(
        F.col(id_col).alias("doc_id"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
