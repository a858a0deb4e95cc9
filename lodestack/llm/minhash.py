"""MinHash near-deduplication: fast similarity sketches, banding, and links confirmed on full shingle sets.

* A document's set holds its distinct SHINGLE-word shingles as 64-bit hashes. Its sketch has COORDINATES places, filled in rounds: in round i
  every shingle is hashed to one place with a value, and the least value fills a place that no earlier round has filled. After
  COORDINATES rounds of random places, round COORDINATES + j sends every shingle to place j, so every place fills. Two sketches
  agree at a place with a probability of the sets' Jaccard similarity, concentrated at least as well as independent coordinates.
* BANDS bands of BAND_ROWS places are bucket keys. A pair of similarity 0.85 shares none of them with a probability of 7e-9.
* Equal sets are one node, however many documents have them; of buckets with the same nodes one is looked at. A bucket is cut in blocks of at most
  BLOCK_ROWS nodes and a task gets two of them. It compares nodes by size and by one byte of each place, those of different candidate groups only, and
  returns what spans its groups: at most one candidate a node. By the sketch's concentration a pair of similarity 0.85 agrees at less than
  MIN_MATCHES places with a probability of 1e-10.
* The candidates' components are groups that no link leaves. A group is cut in blocks of at most BLOCK_HASHES shingles, and a task gets two blocks with
  the full sets of their nodes, hashed again from the texts. It looks up nodes in the inverted shingles of all others, always one outside
  the largest component found so far, until every pair of different components is decided, and returns links that span its components. So no
  pair is left out, no list of all pairs is ever written, and a set is sent once for each block of its group.

A link is confirmed by the sizes of the full sets and of their intersection. Components come from repeated minimum labels.

Defined results: null, empty and wordless texts have an empty set and link with nothing, so each is a component of its own; fewer words than
a shingle are one shingle; a null doc_id is ignored when the smallest doc_id is sought (component_id is null where there is no other, and such
rows are kept); rows that repeat a doc_id are nodes of their own texts and are kept or not alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import dropped, maybe_broadcast, small_batches, staged
from lodestack.llm.simhash import components

SHINGLE = 3
#: a link: 100 * intersection >= PERCENT * union
PERCENT = 85
BANDS, BAND_ROWS = 32, 5
COORDINATES = BANDS * BAND_ROWS
#: agreeing places of a candidate, and nodes of one block of a bucket
MIN_MATCHES, BLOCK_ROWS = 100, 4_000
#: shingles of one block of a group (8 bytes each)
BLOCK_HASHES = 2_000_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(codes))
    h = np.full(len(codes) - n + 1, np.uint64(n))
    for k in range(n):  # words in order, so that other cuts of the same letters differ
        h = mix((h + _STEP) ^ codes[k : len(codes) - n + 1 + k])
    return np.unique(h)


def sketch(hashes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit hashes."""
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    for i in range(2 * t):
        y = mix(hashes + np.uint64(int(_STEP) * (i + 1) % 2**64))
        if i >= t:  # every shingle goes to place i - t
            if empty[i - t]:
                out[i - t], empty[i - t] = y.min(), False
        else:
            y.sort()
            place = ((y >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)  # rises with y
            where, first = np.unique(place, return_index=True)
            new = empty[where.astype(np.int64)]
            where, first = where[new].astype(np.int64), first[new]
            out[where], empty[where] = y[first], False
        if not empty.any():
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """BANDS bucket keys of a sketch; keys of different bands differ."""
    rows = coordinates.reshape(BANDS, BAND_ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
    for k in range(BAND_ROWS):
        key = mix(key ^ rows[:, k])
    return key


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), keys (of its bands), lanes (a byte of each place); null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sizes, digests, keys, lanes = [], [], [], []
            for text in b.column(1):
                h = shingles(text.as_py())
                sizes.append(len(h))
                digests.append(xxh3_128_digest(h.tobytes()))
                places = sketch(h) if len(h) else None
                keys.append(None if places is None else band_keys(places).view(np.int64))
                lanes.append(None if places is None else places.astype(np.uint8).tobytes())
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lanes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "keys", "lanes"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<bigint>, lanes binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, hashes (sorted) for wanted(node, least_id, digest): the sets of its documents, hashed again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            same = [i for i, (h, d) in enumerate(zip(sets, b.column(1), strict=True)) if xxh3_128_digest(h.tobytes()) == d.as_py()]
            columns = [b.column(0).take(pa.array(same, pa.int64())), pa.array([len(sets[i]) for i in same], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["node", "n", "hashes"])

    texts = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").filter("text IS NOT NULL")
    found = texts.join(maybe_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "digest", "text")
    return found.mapInArrow(run, "node long, n long, hashes array<bigint>").dropDuplicates(["node"])


class _Components:
    """Components of the positions of some nodes, as labels that every join rewrites."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Link position i with others; of each other component the first link is kept."""
        found, first = np.unique(self.label[others], return_index=True)
        new = found != self.label[i]
        self.links += [(i, int(others[k])) for k in first[new]]
        self.label[np.isin(self.label, found[new])] = self.label[i]


def _lanes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), COORDINATES)


def block_candidates(sizes: np.ndarray, lanes: np.ndarray) -> list[tuple[int, int]]:
    """Positions of pairs that may link and span all such pairs."""
    c = _Components(len(sizes))
    for i in range(len(sizes) - 1):
        rest = i + 1 + np.flatnonzero(c.label[i + 1 :] != c.label[i])
        rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= PERCENT * np.maximum(sizes[rest], sizes[i])]
        if len(rest):
            c.join(i, rest[(lanes[rest] == lanes[i]).sum(axis=1) >= MIN_MATCHES])
    return c.links


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Positions of linked pairs that span the components of all links among some sorted sets."""
    c, asked = _Components(len(sets)), np.zeros(len(sets), bool)
    sizes = np.array([len(s) for s in sets])
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    while True:
        labels, counts = np.unique(c.label, return_counts=True)
        left = np.flatnonzero(~asked & (c.label != labels[counts.argmax()]))
        if not len(left):
            return c.links
        for i in left[:64].tolist():  # the largest component is sought again from time to time
            asked[i] = True
            lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            # members of the slices lo:hi, one after the other
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(owner[at], minlength=len(sets))
            c.join(i, np.flatnonzero(100 * common >= PERCENT * (sizes + sizes[i] - common)))


def _blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Members with i and j: every two blocks of a key meet in one task, a block with itself too."""
    salted = members.withColumn("salts", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.least("own", s).alias("i"), F.greatest("own", s).alias("j")))
    return salted.withColumn("p", F.explode(pairs)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", "own", "salts")


def _table(nodes: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(nodes[at[:, 0]]), "b": pa.array(nodes[at[:, 1]])})


def candidates(members: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: candidates that span the groups within each bucket of members(key, node, n, lanes)."""

    def run(t: pa.Table) -> pa.Table:
        return _table(t["node"].to_numpy(), block_candidates(t["n"].to_numpy(), _lanes(t["lanes"])))

    large = staged(members.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).filter("blocks > 1"), "minhash-large")
    dealt = _blocks(members.join(maybe_broadcast(large), "key", "left"), F.coalesce("blocks", F.lit(1)))
    return dealt.select("key", "i", "j", "node", "n", "lanes").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def links(groups: DataFrame, sets: DataFrame, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """a, b: links that span the components within each group of groups(key, node, n), by the full sets of sets(node, hashes)."""

    def run(t: pa.Table) -> pa.Table:
        hashes = t["hashes"].combine_chunks()
        flat, ends = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(pa.compute.list_value_length(hashes).to_numpy())
        # sets are sorted as unsigned hashes
        return _table(t["node"].to_numpy(), block_links(np.split(flat, ends[:-1])))

    weights = groups.groupBy("key").agg(F.greatest(F.ceil(2 * F.sum("n") / block_hashes), F.lit(1)).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = _blocks(groups.join(maybe_broadcast(staged(weights, "minhash-weights")), "key", "left"), F.coalesce("blocks", F.lit(1)))
    return dealt.select("key", "i", "j", "node").join(sets.select("node", "hashes"), "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def node_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, block_rows: int = BLOCK_ROWS, block_hashes: int = BLOCK_HASHES) -> DataFrame | None:
    """v, root: the component of every linked node of the buckets members(key, node, n, lanes); none if nothing links."""
    maybe = staged(candidates(members, block_rows), "minhash-maybe")
    if maybe.isEmpty():
        return None
    groups = components(maybe).select(F.col("v").alias("node"), F.col("root").alias("key"))
    known = nodes.select("node", "least_id", "digest", F.col("n_shingles").alias("n"))
    groups = staged(known.join(maybe_broadcast(groups), "node"), "minhash-groups")
    sets = staged(full_sets(docs, groups.select("node", "least_id", "digest")), "minhash-sets")
    found = staged(links(groups.select("key", "node", "n"), sets, block_hashes), "minhash-links")
    dropped(maybe, groups, sets)
    return None if found.isEmpty() else components(found)


def one_of_each(buckets: DataFrame) -> DataFrame:
    """buckets(key, node) of several nodes; of buckets with the same nodes one."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"m{s}") for s in (1, 2)]
    sums = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).filter("n > 1")
    one = staged(sums.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key"), "minhash-keys")
    return buckets.join(maybe_broadcast(one), "key", "left_semi")


def near_duplicates(docs: DataFrame, block_rows: int = BLOCK_ROWS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    rows = staged(sketched(docs), "minhash-sketches")
    # equal sets have equal keys, so any of them stands for the node
    alike = [F.first(c).alias(c) for c in ("n_shingles", "keys", "lanes")]
    nodes = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), *alike)
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sized = nodes.select("node", F.col("n_shingles").alias("n"), "lanes")
    members = staged(one_of_each(keyed).join(sized, "node"), "minhash-members")
    roots = node_links(members, docs, nodes, block_rows, block_hashes)
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "v long, root long")
    named = nodes.select("node", "digest", "least_id", "copies").join(maybe_broadcast(roots), F.col("node") == F.col("v"), "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    # a node alone of one document is its own component: only the others are joined to the documents
    linked_roots = staged(named.filter("v IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("least")), "minhash-least")
    several = named.filter("v IS NOT NULL OR copies > 1").join(maybe_broadcast(linked_roots), "root", "left")
    several = staged(several.select("digest", F.coalesce("least", "least_id").alias("least")), "minhash-components", 1 + nodes.count())
    dropped(members)
    joined = rows.select("doc_id", "n_shingles", "digest").join(maybe_broadcast(several), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
rare AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
y AS (SELECT doc_id, g, n.n FROM x SEMI JOIN rare USING (g) JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM y a JOIN y b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.v = n.doc_id
"""
