"""Hybrid search for batches of queries: two retrievals, rank fusion, caps and collapse in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.scores import RecencyRule, kind_weight, recency_multiplier, rrf
from lodestack.functions.text import simple_tokens
from lodestack.operators.lexical import POOL, TextIndex, lexical_top, text_index
from lodestack.operators.vector import nearest_parts

MODES = ("hybrid", "semantic", "lexical")


@dataclass(frozen=True)
class Stored:
    """How a search reads a corpus that is stored by keys.

    docs(ids) and segments(ids) are the rows of ids(doc_id), from the files that can hold them; nearest(queries, k), if there is an index of the
    vectors, is query_id, vec_id, part, similarity, rank. keep(df) writes a small table between two steps.
    """

    docs: Callable[[DataFrame], DataFrame]
    segments: Callable[[DataFrame], DataFrame]
    keep: Callable[[DataFrame], DataFrame]
    nearest: Callable[[DataFrame, int], DataFrame] | None = None


@dataclass(frozen=True)
class SearchOptions:
    mode: str = "hybrid"
    limit: int = 10
    title_weight: float = 3.0
    body_weight: float = 1.0
    rrf_k: float = 60
    lexical_weight: float = 1.0
    vector_weight: float = 1.0
    kind_weights: dict[str, float] = field(default_factory=dict)
    recency: RecencyRule | None = None
    kinds: tuple[str, ...] | None = None
    min_lexical_score: float = 0
    min_vector_score: float = 0
    max_chunks_per_doc: int = 1
    decimals: int = 9

    @classmethod
    def from_config(cls, config: dict, **over) -> SearchOptions:
        rule = config.get("recency")
        own = {
            "title_weight": config["field_weights"]["title"], "body_weight": config["field_weights"]["body"], "rrf_k": config["rrf_k"],
            "lexical_weight": config["rrf_weights"]["lexical"], "vector_weight": config["rrf_weights"]["vector"],
            "kind_weights": config.get("kind_weights") or {}, "min_lexical_score": config.get("min_lexical_score", 0),
            "min_vector_score": config.get("min_vector_score", 0),
            "recency": RecencyRule(tuple(rule["kinds"]), rule["half_life_days"], rule["floor"]) if rule else None,
        }
        return cls(**{**own, **{k: v for k, v in over.items() if v is not None}})


def fusion_order() -> list[Column]:
    """The total order of fused segments: score, passes, vector present, the raw scores, then identity."""
    passes = F.col("lexical_rank").isNotNull().cast("int") + F.col("vector_rank").isNotNull().cast("int")
    return [F.desc("score"), passes.desc(), F.col("vector_rank").isNotNull().desc(), F.desc("lexical_score"), F.desc("vector_score"), F.asc("external_id"), F.asc("segment_index")]


def candidates(
    segments: DataFrame, docs: DataFrame, queries: DataFrame, o: SearchOptions, analyse: Callable[[Column], Column] = simple_tokens, index: TextIndex | None = None,
    stored: Stored | None = None,
) -> DataFrame:
    """query_id, doc_id, segment_index, lexical_score, vector_score: the union of both pools, 0 where a pass has no score.

    `index` is the text index of the corpus; without one it is made from segments and docs. A search within some kinds looks at all vectors of those.
    """
    if o.mode not in MODES:
        raise ValueError(f"unknown mode: {o.mode}")
    placed = segments.filter("embedding IS NOT NULL").select("doc_id", "segment_index", "embedding")
    index = index or text_index(segments, docs, analyse)
    if o.kinds is not None:  # before both pools are cut
        of_kind = docs.filter(F.col("kind").isin(*o.kinds)).select("doc_id")
        placed = placed.join(of_kind, "doc_id", "left_semi")
        of = lambda postings: postings.join(of_kind, "doc_id", "left_semi")
        # counts of all kinds bound those of some
        index = TextIndex(of(index.postings), index.sizes, (lambda terms, find=index.find: of(find(terms))) if index.find else None, index.blocks)
    keys = ["query_id", "doc_id", "segment_index"]
    lexical = lexical_top(index, queries, o.title_weight, o.body_weight, analyse) if o.mode != "semantic" else None
    vector = None
    if o.mode != "lexical":
        if stored and stored.nearest and o.kinds is None:
            best = stored.nearest(queries, POOL)
        else:
            best = nearest_parts(placed.withColumnsRenamed({"doc_id": "vec_id", "segment_index": "part"}), queries, POOL)
        vector = best.select("query_id", F.col("vec_id").alias("doc_id"), F.col("part").alias("segment_index"), F.col("similarity").alias("vector_score"))
    if lexical is None:
        both = vector.withColumn("lexical_score", F.lit(0.0))
    elif vector is None:
        both = lexical.withColumn("vector_score", F.lit(0.0))
    else:
        both = lexical.join(vector, keys, "full_outer")
    return both.select(*keys, F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"))


def fuse(pool: DataFrame, segments: DataFrame, docs: DataFrame, o: SearchOptions, now: Column) -> DataFrame:
    """All segments that are left after floors, per-document caps and the collapse of equal contents, with scores, without texts.

    segments(doc_id, segment_index, content_hash), docs(doc_id, external_id, kind, published_at).
    """
    in_query = lambda score: Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id", "segment_index")
    rank = lambda score, floor: F.when(F.col(score) > floor, F.row_number().over(in_query(score)))  # noqa: E731  rows at or below the floor come last
    ranked = pool.withColumn("lexical_rank", rank("lexical_score", o.min_lexical_score)).withColumn("vector_rank", rank("vector_score", o.min_vector_score))
    ranked = ranked.filter("lexical_rank IS NOT NULL OR vector_rank IS NOT NULL")
    full = ranked.join(docs.select("doc_id", "external_id", "kind", "published_at"), "doc_id")
    full = full.join(segments.select("doc_id", "segment_index", "content_hash"), ["doc_id", "segment_index"])
    score = rrf(F.col("lexical_rank"), F.col("vector_rank"), o.rrf_k, o.lexical_weight, o.vector_weight)
    score = score * kind_weight(F.col("kind"), o.kind_weights) * recency_multiplier(o.recency, F.col("kind"), F.col("published_at"), now)
    scored = full.withColumn("score", F.round(score, o.decimals))
    nth = lambda by: F.row_number().over(Window.partitionBy("query_id", by).orderBy(*fusion_order()))
    capped = scored.withColumn("_n", nth("doc_id")).filter(F.col("_n") <= o.max_chunks_per_doc)
    return capped.withColumn("_n", nth("content_hash")).filter("_n = 1").drop("_n")


def hybrid_search(
    segments: DataFrame, docs: DataFrame, queries: DataFrame, o: SearchOptions, now: Column, analyse: Callable[[Column], Column] = simple_tokens, index: TextIndex | None = None,
    stored: Stored | None = None,
) -> DataFrame:
    """query_id, position, external_id, score, title, snippet, kind, total: the first `limit` results of each query.

    total counts a query's documents before the limit. segments(doc_id, segment_index, body, content_hash, embedding; null: not in
    the vector pass), docs(doc_id, external_id, title, kind, published_at), queries(query_id, q, embedding). Titles and texts are
    joined to the results only. With `stored` the pools are written first, and rows are looked up by the documents in them.
    """
    pool = candidates(segments, docs, queries, o, analyse, index, stored)
    of_pool = (segments, docs)
    if stored:
        pool = stored.keep(pool)
        ids = pool.select("doc_id").distinct()
        of_pool = (stored.segments(ids), stored.docs(ids))
    kept = fuse(pool, *of_pool, o, now)
    every = Window.partitionBy("query_id")
    total = F.size(F.collect_set("doc_id").over(every)).cast("long")
    place = F.row_number().over(every.orderBy(*fusion_order()))
    found = kept.withColumn("total", total).withColumn("position", place).filter(F.col("position") <= o.limit)
    found = found.select("query_id", "position", "doc_id", "segment_index", "external_id", "score", "kind", "total")
    if stored:
        found = stored.keep(found)
        ids = found.select("doc_id").distinct()
        segments, docs = stored.segments(ids), stored.docs(ids)
    texts = segments.select("doc_id", "segment_index", F.col("body").alias("snippet"))
    full = found.join(docs.select("doc_id", "title"), "doc_id").join(texts, ["doc_id", "segment_index"])
    return full.select("query_id", "position", "external_id", "score", "title", "snippet", "kind", "total")
