"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight; together the sources share `total_share` times all words. A source gives at
most `max_epochs` times its own words; what it cannot give is shared again by weight among the others.
The shares that this ends at have a closed form: with sources ordered by cap / weight, the clamped ones are
a prefix, so one running sum over the (small) table of sources finds the level.

Each document is then repeated: floor(target / source size) whole times, and a seeded part of the source
once more. For that part documents fall in BUCKETS buckets by a seeded hash; buckets below the boundary
give whole repetitions, and the one boundary bucket gives fractional repetitions (a leading part of each of its
documents), so that the words taken meet the target. No source is ever sorted or collected: per source only
bucket sums move, so one source may hold any part of all rows.

Defined results: null text counts as 0 words; null is a source of its own, the last; a source without words
has target 0; rows that repeat a doc_id get the same share; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WHITE, WORD, column, maybe_broadcast, staged, word_count

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096
SEED = 20240


def _hash(seed: int):
    """60 seeded bits of a document's identifier, from MD5 as DuckDB computes it too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source; null is a source.

    The windows run over all sources in one task: a row of a few numbers per source, however many documents there are.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.select("source", "source_size", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    capped = named.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("fill_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    upto = Window.orderBy("fill_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # if all before this one are clamped and none from here on, the level is:
    level = (F.sum("source_size").over(every) * F.lit(total_share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    tried = capped.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("fill_at"), F.struct("fill_at", F.col("source").isNull().alias("none"), "source", "level"))).over(every)["level"]
    return tried.withColumn("found", level).select(
        "source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("weight"))).alias("target")
    )


def targets(sized: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, bucket, size): per source its size, target, whole repetitions, boundary bucket and share taken of that."""
    sums = staged(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    filled = water_fill(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, total_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)))
    f, b = filled.alias("f"), before.alias("b")
    inside = (F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("bucket_size"))
    return staged(
        f.join(b, F.col("f.source").eqNullSafe(F.col("b.source")) & inside, "left").select(
            F.col("f.source").alias("of"),
            "source_size",
            "target",
            "whole",
            F.coalesce("bucket", F.lit(0)).alias("edge"),
            F.coalesce((F.col("need") - F.col("before")) / F.col("bucket_size"), F.lit(0.0)).alias("share"),
        ),
        "mix-targets",
        sums.count(),
    )


def _seeded(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumn("hash", _hash(seed)).withColumn("bucket", F.col("hash") % BUCKETS)


def _apply(seeded: DataFrame, edges: DataFrame) -> DataFrame:
    """Join each row with its source's target, and say how many words its last repetition has (part)."""
    unit = F.shiftright("hash", 12) % (1 << 24) / F.lit(float(1 << 24))
    part = F.when(F.col("bucket") < F.col("edge"), F.col("size")).when(F.col("bucket") == F.col("edge"), F.floor(F.col("size") * F.col("share") + unit))
    joined = seeded.join(maybe_broadcast(edges), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (repetitions), part (words of one more), taken."""
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    seeded = _seeded(sized, seed)
    return (
        _apply(seeded, targets(seeded, weights, total_share, max_epochs))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "part")
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    )


def repeat_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each document `whole` times, then its leading `part` words once more if any.

    The columns stay as they are; n_chars of a shortened text is counted again where that column exists.
    The texts themselves are never shuffled: a row needs no more than its source's small row of targets.
    """
    columns, row = docs.columns, F.struct(*map(column, docs.columns))
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    edges = targets(_seeded(sized, seed))
    rows = docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = _apply(_seeded(rows, seed), edges).filter("whole > 0 OR part > 0")
    out = taken.withColumn("turn", F.explode(F.expr("sequence(1, CAST(whole + IF(part > 0, 1, 0) AS INT))")))
    cut = (F.col("turn") > F.col("whole")) & (F.col("part") < F.col("size"))
    # words with the white space after them, put together again: the leading part as it stood in the text
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD}{WHITE}*)"), F.lit(1))
    text = F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    out = out.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in columns:
        counted = F.char_length(F.col("row.text")).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("row", F.col("row").withField("n_chars", F.when(cut, counted).otherwise(F.col("row.n_chars"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns])


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS fill_at,
             (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
      FROM n WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= fill_at ORDER BY fill_at, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM f),
b AS (SELECT source, hash % {BUCKETS} AS bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM d GROUP BY ALL),
r AS (SELECT *, CAST(coalesce(sum(bucket_size) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b),
e AS (SELECT t.source, t.source_size, t.target, t.whole, coalesce(r.bucket, 0) AS edge, coalesce((t.target - t.whole * t.source_size - r.before) / r.bucket_size, 0) AS share
      FROM t LEFT JOIN r ON t.source IS NOT DISTINCT FROM r.source AND r.before <= t.target - t.whole * t.source_size AND t.target - t.whole * t.source_size < r.before + r.bucket_size)
SELECT doc_id, size, source_size, target,
       whole * size + CASE WHEN hash % {BUCKETS} < edge THEN size
                           WHEN hash % {BUCKETS} = edge THEN CAST(floor(size * share + (hash // {BUCKETS}) % {1 << 24} / {float(1 << 24)}::DOUBLE) AS BIGINT) ELSE 0 END AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
