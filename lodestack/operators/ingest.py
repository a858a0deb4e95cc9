"""Ingest as set operations: segments of new texts against the stored ones, and the merged snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import chunk_text, content_hash


def distinct_segments(chunks: Column) -> Column:
    """array<struct<content_hash, segment_index, segment>> of an array of chunks; of equal ones the first. Sorted, so it takes n log n time."""
    coded = F.array_sort(F.transform(chunks, lambda c, i: F.struct(content_hash(c).alias("content_hash"), i.alias("segment_index"), c.alias("segment"))))
    first = lambda every: F.filter(every, lambda s, i: (i == 0) | (s["content_hash"] != F.get(every, i - 1)["content_hash"]))
    return F.get(F.transform(F.array(coded), lambda every: first(every)), F.lit(0))


def segments_of(docs: DataFrame) -> DataFrame:
    """The columns of docs other than chunks, with n_chunks, content_hash, segment_index and segment; nothing is shuffled."""
    rest = [c for c in docs.columns if c != "chunks"]
    # generated, so that chunks are computed once however often they are used after
    told = F.transform(F.array("chunks"), lambda c: F.struct(F.size(c).alias("n_chunks"), distinct_segments(c).alias("s")))
    cut = docs.select(*rest, F.inline(told)).select(*rest, "n_chunks", F.explode("s").alias("s"))
    return cut.select(*rest, "n_chunks", "s.content_hash", "s.segment_index", "s.segment")


def to_segments(docs: DataFrame, max_tokens: int) -> DataFrame:
    """doc columns other than body, with n_chunks, content_hash, segment_index, segment; equal segments of a document keep the first index."""
    return segments_of(docs.withColumn("chunks", chunk_text(F.col("body"), max_tokens)).drop("body"))


def split_by_limit(docs: DataFrame, n_chunks: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected documents; segments are counted before equal ones are joined. A rejected row says why."""
    counted = docs.withColumn("n_chunks", n_chunks)
    text = F.format_string("document produces %d segments, exceeding limit of %d", F.col("n_chunks"), F.lit(limit))
    return counted.filter(F.col("n_chunks") <= limit), counted.filter(F.col("n_chunks") > limit).withColumn("error", text)


def diff(new: DataFrame, stored: DataFrame, document: str = "external_id", documents: DataFrame | None = None) -> DataFrame:
    """document, content_hash, old_index, new_index, state (changed, unchanged, removed), by full join on document and hash.

    Both sides have (document, segment_index, content_hash) without repeats. Only stored segments of `documents` (default:
    those of `new`) count as removed.
    """
    keys = [document, "content_hash"]
    n = new.select(*keys, F.col("segment_index").alias("new_index"))
    s = stored.join((new if documents is None else documents).select(document).distinct(), document, "left_semi").select(*keys, F.col("segment_index").alias("old_index"))
    state = F.when(F.col("old_index").isNull(), "changed").when(F.col("new_index").isNull(), "removed").otherwise("unchanged")
    return n.join(s, keys, "full_outer").withColumn("state", state)


def report(changes: DataFrame, document: str = "external_id") -> DataFrame:
    """document, segments, changed, unchanged, removed per document."""
    n = lambda s: F.count_if(F.col("state") == s)
    return changes.groupBy(document).agg((n("changed") + n("unchanged")).alias("segments"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), n("removed").alias("removed"))


def merge_documents(stored: DataFrame, new: DataFrame, now: Column, key: tuple[str, ...] = ("external_id",)) -> DataFrame:
    """The document snapshot after an upsert: every field of a new document replaces the stored one, created_at stays.

    A missing kind becomes null and missing metadata an empty object.
    """
    n = new.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("updated_at", now)
    born = stored.select(*key, F.col("created_at").alias("_born"))
    fresh = n.join(born, list(key), "left").withColumn("created_at", F.coalesce("_born", now)).drop("_born")
    rest = stored.join(new.select(*key), list(key), "left_anti")
    return rest.unionByName(fresh.select(*rest.columns))


def merge_segments(stored: DataFrame, new: DataFrame, documents: DataFrame | None = None, key: tuple[str, ...] = ("external_id",)) -> DataFrame:
    """The segment snapshot: unchanged segments keep their embedding at their new index, changed ones come without one.

    `documents` are all that the batch has, with or without segments (default: those of `new`). The hash covers the
    segment alone: a new title does not embed an unchanged segment again.
    """
    keys = [*key, "content_hash"]
    rest = stored.join((new if documents is None else documents).select(*key).distinct(), list(key), "left_anti")
    kept = new.join(stored.select(*keys, "embedding"), keys, "left")
    return rest.unionByName(kept.select(*rest.columns))


def delete_documents(stored: DataFrame, ids: DataFrame, key: str = "external_id") -> DataFrame:
    """Rows of any table whose document is not in ids(key); ids that are not there change nothing."""
    return stored.join(ids.select(key), key, "left_anti")


def run_counters(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """indexed, skipped, failed (and columns `by`): how the documents of a run ended, from status and error of each.

    A document that was stored is indexed; one without text is skipped; one with an error has failed.
    """
    n = lambda c: F.count_if(c)
    failed, skipped = F.col("error").isNotNull(), F.col("error").isNull() & (F.col("status") == "skipped")
    counted = [n((F.col("status") == "indexed") & ~failed).alias("indexed"), n(skipped).alias("skipped"), n(failed).alias("failed")]
    return results.groupBy(*by).agg(*counted) if by else results.agg(*counted)
