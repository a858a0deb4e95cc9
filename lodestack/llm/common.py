"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.files import delete_path, new_path

__all__ = ["new_path"]

#: ASCII white space of the word rule, as a regular expression class for Java, Python and RE2.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as bytes; bytes.split() splits at exactly these.
WHITE_BYTES = b" \t\n\x0b\x0c\r"

#: A side of a join is broadcast up to this many (small, fixed-width) rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: rows of a small table in one file, where a caller knows a bound of its rows
FILE_ROWS = 500_000
#: rows of one Arrow batch of texts
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower Arrow's batch size to what suits whole texts: buffers grow with a batch, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def staged(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts the lineage: the files survive lost executors, and nothing before them is computed again. `rows`, a bound of
    the table's rows, keeps a small table from becoming a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables as `staged` returned them, once all that comes from them is staged too; a long session keeps no more than it needs."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            delete_path(t.sparkSession, path)


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if it has at most `limit` rows; else Spark shuffles both sides.

    The count reads Parquet footers only, so it costs next to nothing. limit + 1 rows at most are looked at.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (doc_id; null is a value like any other); every column stays as it is."""
    name = fresh(docs, "gone")
    return docs.join(maybe_broadcast(gone.select(F.col("doc_id").alias(name))), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text):
    """Words of a text column as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
