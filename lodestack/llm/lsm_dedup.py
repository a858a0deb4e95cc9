"""Exact deduplication through a log-structured merge index, in DataFrame operations only.

* A memtable is what one task reads. It is flushed as one sorted run of level 0: a Parquet file of
  (digest, doc_id, n_points, row_no, sha) sorted by a 64-bit digest. Runs hold no text and flushing shuffles nothing.
* Compaction merges runs into level 1: one row for each digest with the number of its entries and the best identifier (most code
  points, then the smallest doc_id). Runs are combined on the map side first, so a digest with a third of all rows sends one row per task.
* A filter (a Bloom filter in blocks, one row per block) holds the digests that a compacted level marks as hits. It is at most
  MAX_BLOCKS * 512 bytes whatever the index holds, so it is broadcast; beyond that size more rows pass it by chance,
  which costs work and changes nothing.
* Probing reads entries and texts through the filter: only rows that pass go on. Of their texts and entries those of one SHA-256
  form a class. Hits are verified byte by byte: over the rows of a class the smallest and the largest normalised text have to
  be the same bytes. Both are aggregated on the map side first, too. Other texts are never shuffled.

Defined results: null texts count as empty; all texts without a word fall in one group; a null doc_id
comes after every other; rows that repeat one (doc_id, text) count separately in group_size and exactly
one of them has kept = true; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import WHITE, column, dropped, fresh, maybe_broadcast, new_path, staged

RUN_SCHEMA = "digest long, doc_id long, n_points int, row_no long, sha binary"
#: bits of one block of the filter, bits set for each digest, and the most blocks (64 MB)
BLOCK_BITS, BITS_EACH, MAX_BLOCKS = 4096, 4, 1 << 17


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", "")


def _best():
    """Least is best: most code points, then the smallest identifier, nulls last."""
    return F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))


def flush(docs: DataFrame, path: str) -> None:
    """Append one sorted run per task to the index at `path`."""
    norm = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("norm", normalised(F.col("text")))
    entries = norm.select(
        F.xxhash64("norm").alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length("text").alias("n_points"),
        F.monotonically_increasing_id().alias("row_no"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
    )
    entries.sortWithinPartitions("digest", "doc_id").write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def compact(all_runs: DataFrame) -> DataFrame:
    """Merge runs: one row per digest with its best identifier and the number of entries, in order of digest within each file."""
    return all_runs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")).sortWithinPartitions("digest")


def _block(n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned("digest", 47), F.lit(n_blocks)).cast("int")


def _bits() -> list[Column]:
    """BITS_EACH places within a block, from parts of the digest that the block's number does not use."""
    return [F.shiftrightunsigned("digest", 12 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(BITS_EACH)]


def build_filter(hits: DataFrame, n_hits: int) -> DataFrame:
    """block, words: the Bloom filter of hits(digest), at least 12 bits for each as long as MAX_BLOCKS allows."""
    n_blocks = min(MAX_BLOCKS, 1 << max(0, (12 * n_hits // BLOCK_BITS).bit_length()))
    marks = hits.select(_block(n_blocks).alias("block"), F.explode(F.array(*_bits())).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    words = marks.groupBy("block", F.shiftright("bit", 6).alias("w")).agg(F.bit_or(one).alias("bits"))
    whole = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return whole.select("block", F.lit(n_blocks).alias("n_blocks"), each.alias("words"))


def through(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """The rows whose digest the filter may hold: all that it holds and, below its largest size, about one in a hundred others."""
    first = filter_.select("n_blocks").first()
    if first is None:
        return rows.limit(0)
    blocks = filter_.select(F.col("block").alias("of_block"), "words")
    found = rows.join(F.broadcast(blocks), _block(first["n_blocks"]) == F.col("of_block"))  # at most MAX_BLOCKS rows of 512 bytes
    inside = [F.call_function("shiftright", F.get("words", F.shiftright(b, 6)), b % 64).bitwiseAND(F.lit(1)) == 1 for b in _bits()]
    return found.filter(reduce(Column.__and__, inside)).drop("of_block", "words")


def probe(docs: DataFrame, filter_: DataFrame) -> DataFrame:
    """digest, sha and normalised text of the rows of docs(text) that pass the filter; a hit is not yet verified."""
    rows = docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", F.xxhash64("norm"))
    return through(rows, filter_).select("digest", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")


def verify(hits: DataFrame) -> DataFrame:
    """One row per (digest, SHA-256) of the hits, after comparing the bytes; a SHA-256 shared by two texts is an error."""
    groups = hits.groupBy("digest", "sha").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    same = F.when(F.col("least") == F.col("most"), True).otherwise(F.raise_error(F.lit("two texts share one SHA-256")).cast("boolean"))
    return groups.select("digest", "sha", same.alias("verified"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    path = new_path(spark, "lsm-runs")
    flush(docs, path)
    entries = runs(spark, path)
    level = staged(compact(entries), "lsm-level")
    hits = level.filter("n > 1").select("digest")
    filter_ = staged(build_filter(hits, hits.count()), "lsm-filter", MAX_BLOCKS)
    verified = verify(probe(docs, filter_))
    classes = (
        through(entries, filter_)
        .groupBy("digest", "sha")
        .agg(F.count(F.lit(1)).alias("n"), _best().alias("best"))
        .filter("n > 1")
        .join(verified, ["digest", "sha"])
        .filter("verified")
        .select("digest", "sha", "n", F.col("best.doc_id").alias("best_id"), F.col("best.row_no").alias("best_row"))
    )
    classes = staged(classes, "lsm-classes")
    dropped(level, filter_)
    return entries.join(maybe_broadcast(classes), ["digest", "sha"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("best_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_unique(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; the columns stay as they are.

    Of rows that repeat one doc_id and normalised text the one with the most code points stays; among those, one of least row hash.
    """
    result = staged(exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "lsm-result")
    doc, sha = fresh(docs, "gone_id"), fresh(docs, "gone_sha")
    again = result.groupBy("doc_id", "text_sha256").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n")).filter("k < n")
    again = staged(again.select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha), (F.col("k") > 0).alias("repeated")), "lsm-gone")
    text_sha = F.sha2(normalised(F.col("text")), 256)
    gone = again.filter("not repeated").drop("repeated")
    kept = docs.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col(doc)) & (text_sha == F.col(sha)), "left_anti")
    # a repeated (doc_id, text) whose group keeps one of its rows
    twice = again.filter("repeated").select(doc, sha)
    if twice.isEmpty():
        return kept
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_sha == F.col(sha))
    rest, some = kept.join(maybe_broadcast(twice), on, "left_anti"), kept.join(maybe_broadcast(twice), on, "left_semi")
    rank, best = fresh(docs, "row_rank"), fresh(docs, "best_rank")
    hashed = [column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    points = F.char_length(F.coalesce("text", F.lit("")))
    some = some.withColumn(sha, text_sha).withColumn(rank, F.struct((-points).alias("p"), F.xxhash64("text", *hashed).alias("h")))
    # one small row for each (doc_id, text), combined on the map side, then the rows of that rank: equal but for a map column
    first = some.groupBy(F.col("doc_id").alias(doc), F.col(sha).alias(f"{sha}_")).agg(F.min(rank).alias(best))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(sha) == F.col(f"{sha}_")) & (F.col(rank) == F.col(best))
    some = some.join(first, on).dropDuplicates(["doc_id", sha])
    return rest.unionByName(some.select(*[column(c) for c in docs.columns]))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS p, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY p DESC, doc_id)
"""
