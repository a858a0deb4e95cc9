"""Keyset pages over document state, counters and diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 1000, 5000


def clamp_limit(raw: object) -> int:
    """A page size from a parameter: its leading integer within [1, MAX_LIMIT]; DEFAULT_LIMIT if there is none."""
    found = re.match(r"\s*([+-]?\d+)", str(raw)) if raw is not None else None
    return min(max(int(found[1]), 1), MAX_LIMIT) if found else DEFAULT_LIMIT


def page(docs: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """external_id, updated_at, kind, metadata of the next `limit` documents after the cursor, in order of external_id."""
    rest = docs if after is None else docs.filter(F.col("external_id") > after)
    return rest.orderBy("external_id").limit(limit).withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).select("external_id", "updated_at", "kind", "metadata")


def next_cursor(rows: list, limit: int) -> str | None:
    """The last identifier if the page is full and not empty."""
    return rows[-1]["external_id"] if rows and len(rows) == limit else None


def counters(docs: DataFrame, segments: DataFrame, by: str) -> DataFrame:
    """by, total_documents, total_segments: derived, never maintained."""
    n = docs.groupBy(by).agg(F.count(F.lit(1)).alias("total_documents"))
    s = segments.groupBy(by).agg(F.count(F.lit(1)).alias("total_segments"))
    return n.join(s, by, "left").select(by, "total_documents", F.coalesce("total_segments", F.lit(0)).alias("total_segments"))


def dimensions(vectors: DataFrame, by: str, order: str) -> DataFrame:
    """by, dimensions: the size of one stored vector each."""
    first = Window.partitionBy(by).orderBy(order)
    one = vectors.filter("embedding IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return one.select(by, F.size("embedding").alias("dimensions"))


def tables(spark, stored: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """name, folders, files, bytes, rows: the stored tables of an index, by name the folders of each and its visible rows; a row each."""
    from lodestack.sources.files import Files

    rows = []
    for name, (folders, table) in sorted(stored.items()):
        files = [x.rsplit(":", 2) for f in folders for x in Files(spark, f).stamp().split(";") if x and not x.startswith("_")]
        rows.append((name, folders, len(files), sum(int(size) for _, size, _ in files), table.count()))
    return spark.createDataFrame(rows, "name string, folders array<string>, files int, bytes long, rows long")
