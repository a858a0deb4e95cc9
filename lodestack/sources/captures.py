"""JSON files of golden queries and of captured rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "description string, queries array<struct<q: string, category: string>>"
CAPTURE = "label string, captured_at string, queries array<struct<q: string, category: string, modes: map<string, array<struct<external_id: string, score: double, title: string>>>>>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """q, category."""
    return spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.inline("queries"))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """label, q, category, mode, ids (ranked)."""
    rows = spark.read.schema(CAPTURE).json(path, multiLine=True).select("label", F.inline("queries"))
    return rows.select("label", "q", "category", F.explode("modes").alias("mode", "found")).select("label", "q", "category", "mode", F.col("found.external_id").alias("ids"))


def write_capture(results: DataFrame, path: str, label: str, captured_at: str) -> None:
    """results(q, category, mode, position, external_id, score, title) as one JSON object per file."""
    rows = results.groupBy("q", "category", "mode").agg(F.array_sort(F.collect_list(F.struct("position", "external_id", "score", "title"))).alias("r"))
    rows = rows.withColumn("r", F.transform("r", lambda x: F.struct(x["external_id"].alias("external_id"), x["score"].alias("score"), x["title"].alias("title"))))
    by_query = rows.groupBy("q", "category").agg(F.map_from_entries(F.collect_list(F.struct("mode", "r"))).alias("modes"))
    one = by_query.agg(F.array_sort(F.collect_list(F.struct("q", "category", "modes")), lambda a, b: F.when(a["q"] < b["q"], -1).when(a["q"] > b["q"], 1).otherwise(0)).alias("queries"))
    one.select(F.lit(label).alias("label"), F.lit(captured_at).alias("captured_at"), "queries").write.json(path)


def compare(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (q, category, mode, a, b) of two captures, and the queries that the second lacks."""
    other = b.select("q", "mode", F.col("ids").alias("b"))
    missing = a.select("q").distinct().join(b.select("q").distinct(), "q", "left_anti")
    have = a.join(b.select("q").distinct(), "q", "left_semi")
    pairs = have.join(other, ["q", "mode"], "left").select("q", "category", "mode", F.col("ids").alias("a"), F.coalesce("b", F.array().cast("array<string>")).alias("b"))
    return pairs, missing
