"""A stored index of vectors: inverted lists, one partition each, and exact similarity within the lists that a query probes.

The centres are unit vectors from k-means on a bounded sample; every vector is in the list of its nearest centre, also those that come
later. How many lists a query probes is measured when the centres are fitted: the least number that finds TARGET of the nearest neighbours among the
sample, so vectors without structure are searched widely and clustered ones narrowly. A search names its lists to the scan, which opens no
other partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.vector import BLOCK, SAMPLE_PER_LIST, _dealt, _known, _near_lists, _one_block, _ranked, _schema, _slices, _unit

MAX_LISTS = 4096
#: share of the sample's nearest neighbours that the probed lists hold, neighbours and queries that it is measured by
TARGET, NEIGHBOURS, ASKED = 0.98, 10, 400


@dataclass(frozen=True)
class Lists:
    """Unit centres, one a row, and how many lists a query probes."""

    centres: np.ndarray
    probes: int

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c], self.probes) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "list int, centre array<double>, probes int").coalesce(1).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Lists:
        rows = sorted(spark.read.parquet(path).collect())  # MAX_LISTS rows at most
        return cls(np.array([r["centre"] for r in rows]), rows[0]["probes"])


def fit(vectors: DataFrame, n: int, lists: int | None = None, seed: int = 7) -> Lists | None:
    """Lists for `n` vectors(embedding), about the square root of their number; none if no vector has a direction."""
    lists = lists or max(1, min(MAX_LISTS, math.isqrt(n)))
    share = min(1.0, lists * SAMPLE_PER_LIST / max(1, n))
    sample = vectors.select("embedding").filter("embedding IS NOT NULL")
    sample = sample.filter(F.pmod(F.xxhash64("embedding", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    table = sample.toArrow()  # bounded: about SAMPLE_PER_LIST rows a list
    unit = _unit(table["embedding"]) if table.num_rows else np.zeros((0, 1))
    unit = unit[~np.isnan(unit).any(axis=1)]
    if not len(unit):
        return None
    unit = unit[np.lexsort(unit.T[::-1])]  # the same centres however the rows come
    centres = _k_means(unit, min(lists, len(unit)), seed)
    return Lists(centres, _probes(unit, centres, seed))


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(unit[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(unit), 8192)])


def _k_means(unit: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on the sample: at most MAX_LISTS * SAMPLE_PER_LIST rows."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(unit, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _probes(unit: np.ndarray, centres: np.ndarray, seed: int) -> int:
    """The least number of nearest lists that hold TARGET of the nearest neighbours of a part of the sample."""
    asked = np.random.default_rng(seed + 1).choice(len(unit), min(ASKED, len(unit)), replace=False)
    sim = unit[asked] @ unit.T
    sim[np.arange(len(asked)), asked] = -2
    k = min(NEIGHBOURS, len(unit) - 1)
    if k < 1:
        return len(centres)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(unit[asked] @ centres.T), axis=1, kind="stable"), axis=1)  # each list's place for a query
    found = np.sort(np.take_along_axis(place, _nearest(unit, centres)[near], axis=1).ravel())
    return int(found[min(len(found) - 1, math.ceil(TARGET * len(found)))]) + 1


def assign(vectors: DataFrame, lists: Lists) -> DataFrame:
    """vectors with `list`, that of the nearest centre; vectors without a direction are in none and left out."""
    return _near_lists(vectors.filter("embedding IS NOT NULL"), lists.centres, 1).withColumnRenamed("block", "list")


def nearest_in_lists(read: Callable[[list[int] | None], DataFrame], lists: Lists, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, part, similarity, rank: as nearest_parts, of the vectors in the lists that each query probes.

    read(lists) gives vectors(vec_id, part, embedding, list) of some lists (None: all). The queries of a batch share what it reads, which can
    only find more; a batch of more than `block` queries is dealt to the tasks of its lists.
    """
    none = read([])
    _, q = _known(none, queries)
    schema = _schema(none, queries)
    few = q.limit(block + 1).toArrow()
    if few.num_rows == 0:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    n = len(lists.centres)
    if few.num_rows <= block:
        unit = _unit(few["embedding"])
        unit = unit[~np.isnan(unit).any(axis=1)]
        if len(unit) and unit.shape[1] != lists.centres.shape[1]:
            raise ValueError(f"vectors have {lists.centres.shape[1]} dimensions, queries {unit.shape[1]}")
        near = np.argsort(-(unit @ lists.centres.T), axis=1, kind="stable")[:, : lists.probes]
        v, _ = _known(read(sorted(set(near.ravel().tolist()))), queries)
        # lists are many small files: a task per core reads several, so that fewer tasks send their k best of every query
        v = v.coalesce(queries.sparkSession.sparkContext.defaultParallelism)
        return _ranked(_one_block(v, few, k, schema), k)
    v = read(None)
    dealt = v.select("vec_id", F.col("part").cast("int").alias("part"), "embedding", F.col("list").alias("block"))
    slices = F.array(*[F.lit(s) for s in _slices(dealt, n)])
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("vec_id", "part"), F.get(slices, F.col("block"))).cast("int"))
    asked = _near_lists(q, lists.centres, lists.probes).withColumn("slice", F.explode(F.sequence(F.lit(0), F.get(slices, F.col("block")) - 1)))
    return _ranked(_dealt(dealt, asked, k, schema), k)
