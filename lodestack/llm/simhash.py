"""SimHash near-deduplication with BK-trees over fingerprint shards.

A document's fingerprint has 64 bits; two documents link when at most RADIUS bits differ, and a component is what
links reach. Work is done on distinct fingerprints only, so a group of equal texts is one node however large.

Links are found in shards. If at most 4 of 64 bits differ, then of b blocks of bits at least b - 4 agree, so every
pair of linked fingerprints shares at least one of the C(b, 4) choices of b - 4 whole blocks. A shard is one choice
with the value of its blocks; b grows with the number of fingerprints so that shards stay small (any b is exact).
In a shard a BK-tree keys each child by its integer Hamming distance to the parent, and every fingerprint of the
shard follows only the edges within the radius. A shard tree is sent to the task that holds the shard's queries
(not broadcast: together the trees grow with the data). A shard of more than SHARD_ROWS fingerprints is cut in salts,
and each pair of salts is a task of its own, so no task holds more than two salts and no link is lost.
Tasks return a spanning set of links, at most one for each fingerprint, never all pairs.

Components come from repeated minimum labels with pointer jumping over the links, each round written to the shared
folder.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id is
ignored when the smallest doc_id is sought (a component of null ids only has component_id null); rows that repeat a
doc_id are nodes of their own texts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import FILE_ROWS, dropped, maybe_broadcast, small_batches, staged, without

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 20_000
#: distinct fingerprints that one task turns into rows of shards
SPREAD_ROWS = 100_000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[i : i + (1 << 16)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values; children are keyed by the distance to their parent."""

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, {}
        todo = [np.arange(len(values))]
        while todo:
            group = todo.pop()
            root, rest = int(group[0]), group[1:]
            away = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(away, kind="stable")
            rest, away = rest[order], away[order]
            cuts = np.flatnonzero(np.diff(away)) + 1
            parts = np.split(rest, cuts) if len(rest) else []
            self.children[root] = [(int(away[c]), int(p[0])) for c, p in zip([0, *cuts.tolist()], parts, strict=False)]
            todo += parts

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node, the query positions within the radius; only edges within the radius are followed."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            away = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            yield node, q[away <= radius]
            for edge, child in self.children[node]:
                near = q[np.abs(away - edge) <= radius]
                if len(near):
                    todo.append((child, near))


def shard_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a shard: each value with its component's least position."""
    root = np.arange(len(values))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for node, near in BKTree(values).links(values, radius):
        mine = find(node)
        for other in np.unique(root[near]).tolist():
            other = find(other)
            if other != mine:
                mine, other = min(mine, other), max(mine, other)
                root[other] = mine
    tops = np.array([find(i) for i in range(len(values))])
    moved = np.flatnonzero(tops != np.arange(len(values)))
    return values[moved], values[tops[moved]]


def blocks_for(n: int) -> int:
    """Blocks of bits so that a random shard has about eight fingerprints at most."""
    for b in (5, 6, 7):
        if n <= 8 << min(sum(w for w, _ in c) for c in combinations(_widths(b), b - RADIUS)):
            return b
    return 8


def _widths(b: int) -> list[tuple[int, int]]:
    """(width, start) of b blocks of 64 bits."""
    edges = [64 * i // b for i in range(b + 1)]
    return [(y - x, x) for x, y in zip(edges, edges[1:], strict=False)]


def _masks(b: int) -> list[int]:
    masks = [sum(((1 << w) - 1) << s for w, s in chosen) for chosen in combinations(_widths(b), b - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, n: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: spanning links between distinct fingerprints (fp) that differ in at most RADIUS bits."""
    masks = F.array(*[F.lit(m) for m in _masks(blocks_for(n))])
    # every fingerprint becomes a row per choice: its table is spread over all tasks before, however few files it has
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, n // SPREAD_ROWS)
    distinct = distinct.repartition(tasks, "fp")
    keyed = distinct.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    hot = staged(keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows), "simhash-hot")
    salts = F.greatest(F.ceil(F.col("n") * 2 / shard_rows), F.lit(1)).cast("int")
    keyed = keyed.join(maybe_broadcast(hot), ["choice", "part"], "left").withColumn("salts", F.coalesce(salts, F.lit(1)))
    own = F.pmod(F.hash("fp"), F.col("salts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.least(own, s).alias("i"), F.greatest(own, s).alias("j")))
    shards = keyed.select("fp", "choice", "part", F.explode(pairs).alias("pair")).select("choice", "part", "pair.i", "pair.j", "fp")
    keys = ["choice", "part", "i", "j"]
    shards = shards.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) if x else pa.array([], pa.int64()) for x in (a, b)], names=["a", "b"])

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            """rows: whole shards, sorted by key."""
            cut = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
            start, fps = np.concatenate([[0], cut]), rows[:, 4].copy().view(np.uint64)
            size = np.diff(np.concatenate([start, [len(rows)]]))
            two = start[size == 2]  # a tree of one edge
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS]
            a, b = [fps[two + 1]], [fps[two]]
            for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = shard_links(fps[s : s + k])
                a.append(x)
                b.append(y)
            return out(a, b)

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or held and (held[-1][-1, :4] != rows[0, :4]).any():  # a shard ended
                yield solve(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield solve(np.concatenate(held))

    return shards.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """v, root: the least node that links reach, for every node of edges (a, b)."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-links")
    n = both.count()
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "v"), "cc-labels", n)
    for _ in range(max_rounds):
        # a node with very many links is one key here: adaptive execution splits its rows, as the other side has one row for it
        near = both.join(labels.select("v", "root"), F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        nearer = near.join(labels.select("v", "root"), F.col("a") == F.col("v")).select("v", F.col("root").alias("old"), F.least("root", "near").alias("up"))
        up = labels.select(F.col("v").alias("u"), F.col("root").alias("above"))
        jumped = nearer.join(up, F.col("up") == F.col("u")).select("v", "old", F.least("up", "above").alias("root"))
        last, labels = labels, staged(jumped, "cc-labels", n)
        dropped(last)
        if labels.filter("root <> old").isEmpty():
            dropped(both)
            return labels.select("v", "root")
    raise RuntimeError("components did not settle; raise max_rounds")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (16 hexadecimal digits), component_id for every row of docs(doc_id, text)."""
    prints = staged(fingerprints(docs), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes", prints.count())
    n = nodes.count()
    # few links come from many shards: they are put together before they are written
    found = staged(links(nodes.select("fp"), n).repartition(1 + n // FILE_ROWS), "simhash-links")
    linked = nodes if found.isEmpty() else None
    if linked is None:
        roots = components(found)
        named = nodes.join(roots, nodes["fp"] == roots["v"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        table = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    else:
        table = nodes.select("fp", F.col("least_id").alias("component_id"))
    table = staged(table, "simhash-components", n)
    dropped(nodes, found)
    return prints.join(maybe_broadcast(table), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; columns stay as they are.

    Rows that share a doc_id stay or go together; a null doc_id goes only if its component has another.
    """
    gone = near_duplicates(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return without(docs, staged(gone, "simhash-gone"))
