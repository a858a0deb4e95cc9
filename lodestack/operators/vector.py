"""Nearest vectors by cosine similarity for batches of queries: exact, or approximate over inverted lists.

A batch of up to BLOCK queries is a small matrix that goes to the tasks with the plan; each task multiplies its vectors by it, keeps its own k
best per query, and only those are shuffled. A larger batch is dealt, like the vectors, to tasks by (block of queries, slice of
vectors), so neither side passes through the driver and a task holds one block and one slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: vectors of one task where the batch has several blocks
SLICE = 20_000
#: similarities that are held at once
CELLS = 4_000_000
DECIMALS = 6
#: inverted lists: rows of the sample that the centres are fitted on, per list
SAMPLE_PER_LIST = 64


def check_dimensions(dims: object) -> int:
    if isinstance(dims, bool) or not isinstance(dims, int) or dims <= 0:
        raise ValueError(f"invalid embedding dimensions: {dims}")
    return dims


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors; a zero vector becomes not-a-number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different dimensions")
    m = flat.reshape(len(column), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class _Best:
    """The k best (vector, part) so far for each query of a block; ties go to the smaller identifier, then part."""

    def __init__(self, queries: pa.Table, k: int):
        self.ids, self.units, self.k = queries["query_id"].combine_chunks(), _unit(queries["embedding"]), k
        self.held: list[tuple] = []

    def add(self, keys: pa.Array, parts: np.ndarray, vectors: pa.Array) -> None:
        size = max(64, CELLS // max(1, len(self.units)))
        for i in range(0, len(keys), size):
            unit = _unit(vectors.slice(i, size))
            if unit.shape[1] != self.units.shape[1]:
                raise ValueError(f"vectors have {unit.shape[1]} dimensions, queries {self.units.shape[1]}")
            sim = np.round(self.units @ unit.T, DECIMALS)
            sim[np.isnan(sim)] = -np.inf
            keep = sim > -np.inf
            if sim.shape[1] > self.k:  # all that reach the k-th best, ties and all
                keep &= sim >= -np.partition(-sim, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            q, c = np.nonzero(keep)
            self.held.append((q, keys.slice(i, size).take(pa.array(c)), parts[i : i + size][c], sim[q, c]))
            if len(self.held) > 8:  # fold, so that a task never holds more than a few times k rows per query
                self.held = [self._fold()]

    def _fold(self) -> tuple:
        q, p, s = (np.concatenate([h[i] for h in self.held]) for i in (0, 2, 3))
        keys = pa.concat_arrays([h[1] for h in self.held])
        if pa.types.is_integer(keys.type):
            codes = keys.to_numpy(zero_copy_only=False)
        else:
            codes = np.unique(np.array(keys.to_pylist(), object), return_inverse=True)[1]
        order = np.lexsort((p, codes, -s, q))
        q = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        return np.sort(q)[np.arange(len(q)) - np.searchsorted(q, q) < self.k], keys.take(pa.array(order)), p[order], s[order]

    def rows(self) -> list[pa.Array]:
        q, keys, p, s = self._fold()
        return [self.ids.take(pa.array(q)), keys, pa.array(p, pa.int32()), pa.array(s, pa.float64())]


NAMES = ["query_id", "vec_id", "part", "similarity"]


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, part int, similarity double"


def _one_block(vectors: DataFrame, queries: pa.Table, k: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k)
        for b in batches:
            if b.num_rows:
                best.add(b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2))
        if best.held:
            yield pa.RecordBatch.from_arrays(best.rows(), names=NAMES)

    return vectors.mapInArrow(run, schema)


def _dealt(vectors: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    """Both sides with (block, slice): every vector of a block and slice against every query of the same."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(right, k) if right.num_rows else None
        if best is not None and left.num_rows:
            best.add(left["vec_id"].combine_chunks(), left["part"].to_numpy(), left["embedding"].combine_chunks())
            return pa.table(best.rows(), names=NAMES)
        return pa.table([left["vec_id"].slice(0, 0), left["vec_id"].slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64())], names=NAMES)

    return vectors.groupBy("block", "slice").cogroup(queries.groupBy("block", "slice")).applyInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id", "part")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _known(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = vectors.select("vec_id", F.col("part").cast("int").alias("part"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return v, queries.select("query_id", "embedding").filter("query_id IS NOT NULL AND embedding IS NOT NULL")


def nearest_parts(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, vec_id, part, similarity, rank: as vector_topk, for vectors(vec_id, part, embedding)."""
    v, q = _known(vectors, queries)
    schema = _schema(vectors, queries)
    few = q.limit(block + 1).toArrow()
    if few.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], f"{schema}, rank int")
    if few.num_rows <= block:
        return _ranked(_one_block(v, few, k, schema), k)
    blocks, slices = math.ceil(q.count() / block), max(1, math.ceil(v.count() / slice_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("slice", F.pmod(F.xxhash64("vec_id", "part"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    return _ranked(_dealt(v, q, k, schema), k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k vectors of vectors(vec_id, embedding) most similar to each of queries(query_id, embedding).

    A zero vector is similar to nothing. The filter of a query's kinds belongs before this, on `vectors`.
    """
    return nearest_parts(vectors.withColumn("part", F.lit(0)), queries, k).drop("part")


def _centres(vectors: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Unit centres fitted by k-means on a sample of about SAMPLE_PER_LIST rows per list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, lists * SAMPLE_PER_LIST / max(1, vectors.count()))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.withColumn("size", size).filter("size > 0").select(F.transform("embedding", lambda x: x / F.col("size")).alias("u"))
    sample = unit.filter(F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("u").alias("features"))
    found = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(sample).clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _dealt_to_lists(batches: Iterator[pa.RecordBatch], centres: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows with `block`, in pieces: a row is compared with every centre and goes out n times with its vector, both up to CELLS numbers at once."""
    size = max(1, CELLS // max(len(centres), n * centres.shape[1]))
    for b in batches:
        for i in range(0, b.num_rows, size):
            piece = b.slice(i, size)
            unit = _unit(piece.column(b.schema.get_field_index("embedding")))
            whole = np.flatnonzero(~np.isnan(unit).any(axis=1))
            sim = unit[whole] @ centres.T
            near = sim.argmax(axis=1)[:, None] if n == 1 else np.argsort(-sim, axis=1, kind="stable")[:, :n]
            rows = piece.take(pa.array(np.repeat(whole, near.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "block"])


def _near_lists(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """df with block: a row for each of the n centres that are nearest to its embedding; zero vectors have none."""
    return df.mapInArrow(lambda batches: _dealt_to_lists(batches, centres, n), ", ".join(f"`{n_}` {t}" for n_, t in df.dtypes) + ", block int")


def vector_topk_approximate(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, vec_id, similarity, rank, as vector_topk, but each query looks only through its `probes` nearest inverted lists.

    Every vector is in the list of its nearest centre; the centres (about the square root of the rows, 4096 at most) are fitted on a bounded
    sample. Lists are cut in slices, so a large one is several tasks; queries go to the slices of their lists.
    """
    v, q = _known(vectors.withColumn("part", F.lit(0)), queries)
    n = v.count()
    lists = lists or max(1, min(4096, math.isqrt(n) // 2))
    probes = min(lists, probes or max(8, lists // 3))
    centres = _centres(v, lists, seed)
    dealt = _near_lists(v, centres, 1)
    slices = F.array(*[F.lit(s) for s in _slices(dealt, lists)])  # a number per list
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.get(slices, F.col("block"))).cast("int"))
    asked = _near_lists(q, centres, probes).withColumn("slice", F.explode(F.sequence(F.lit(0), F.get(slices, F.col("block")) - 1)))
    return _ranked(_dealt(dealt, asked, k, _schema(v, q)), k).drop("part")


def _slices(dealt: DataFrame, lists: int) -> list[int]:
    sizes = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}  # a row per list
    return [max(1, math.ceil(sizes.get(i, 0) / SLICE)) for i in range(lists)]
