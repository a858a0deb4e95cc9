"""Metrics that compare two ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_at_k(a: Column, b: Column, k: int) -> Column:
    """Shared members of the first k, over the longer list's depth; null if both are empty."""
    top_a, top_b = F.slice(a, 1, k), F.slice(b, 1, k)
    depth = F.least(F.lit(k), F.greatest(F.size(top_a), F.size(top_b)))
    shared = F.size(F.filter(top_a, lambda x: F.array_contains(top_b, x)))
    return F.when(depth > 0, shared / depth)


def spearman_shared(a: Column, b: Column) -> Column:
    """Rank correlation over the members of both lists (each without repeats), ranked anew; null below two."""
    in_a, in_b = F.filter(a, lambda x: F.array_contains(b, x)), F.filter(b, lambda x: F.array_contains(a, x))
    n = F.size(in_a).cast("double")
    gaps = F.transform(in_a, lambda x, i: i + 1 - F.array_position(in_b, x))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d * d)
    return F.when(n >= 2, 1 - 6 * total / (n * (n * n - 1)))


def empty_queries(asked: DataFrame, results: DataFrame) -> DataFrame:
    """queries, empty: how many queries were asked, and how many of them found nothing."""
    found = asked.select("query_id").join(results.select("query_id", F.lit(True).alias("found")).distinct(), "query_id", "left")
    return found.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("found").isNull()).alias("empty"))
