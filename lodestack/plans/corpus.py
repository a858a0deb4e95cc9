"""The search corpus of the registered queries: documents as lines, with the vectors at hand, their text index, and queries over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.functions.text import simple_tokens, trim
from lodestack.operators.fusion import Stored
from lodestack.operators.lexical import Analyser, TextIndex, analysed, blocks_of, index_in, index_rows
from lodestack.sources.files import Files, delete_path, kept, new_path
from lodestack.sources.layers import LayeredStore, Table

NOW = "2026-07-13 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, external_id, title (first line, 80 characters), body, kind, lang, published_at."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    return d.select(
        "doc_id",
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("external_id"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        F.col("source").alias("kind"),
        "lang",
        day.cast("string").alias("published_at"),
    )


def first_line(text: Column) -> Column:
    """80 characters of it."""
    return F.substring(F.substring_index(text, "\n", 1), 1, 80)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, segment_index, body, content_hash, title, embedding: the distinct lines of each document, the first of equal ones kept.

    A document's first segment has its vector, also where blank lines come before it.
    """
    cut = lines(spark, sf_dir).withColumnRenamed("first", "_first")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("_first"), "embedding")
    return cut.join(vectors, ["doc_id", "_first"], "left").drop("_first")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, segment_index, body, content_hash, title, first: segments without vectors."""
    # lines are told apart within their row, so no text is shuffled
    kept = table(spark, sf_dir, "documents").select("doc_id", first_line(F.col("text")).alias("title"), F.explode(distinct_lines(numbered_lines(F.col("text")))).alias("s"))
    return kept.select("doc_id", "s.segment_index", "s.body", "s.content_hash", "title", "s.first")


def numbered_lines(text: Column) -> Column:
    """array<struct<at, body>>: the trimmed lines that are not blank, with their numbers."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), trim(x).alias("body"))), lambda s: s["body"] != "")


def distinct_lines(lines: Column) -> Column:
    """array<struct<content_hash, segment_index, body, first>> of numbered lines: of equal ones the first; sorted, so n log n time."""
    coded = F.array_sort(F.transform(lines, lambda s, n: F.struct(F.sha2(s["body"], 256).alias("content_hash"), s["at"].alias("segment_index"), s["body"].alias("body"), (n == 0).alias("first"))))
    first = lambda a: F.filter(a, lambda s, i: (i == 0) | (s["content_hash"] != F.get(a, i - 1)["content_hash"]))
    return F.get(F.transform(F.array(coded), lambda a: first(a)), F.lit(0))


@dataclass(frozen=True)
class Corpus:
    """What an ingest of the tables leaves for searches: documents, segments that have vectors, the text index, and how to look rows up."""

    docs: DataFrame
    vectors: DataFrame
    index: TextIndex
    stored: Stored


#: Made at once from whole tables and read by batches of many queries, so none is shuffled into ranges.
TABLES = {
    "docs": Table("doc_id long, external_id string, title string, kind string, lang string, published_at string", "doc_id"),
    "segments": Table("doc_id long, segment_index int, content_hash string, body string, title string, first boolean", "doc_id"),
    "vectors": Table("doc_id long, segment_index int, embedding array<float>", "doc_id"),
    "postings": Table("term string, doc_id long, segment_index int, level int, at array<int>", "doc_id"),
    "sizes": Table("doc_id long, n_title int, fields array<struct<segment_index: int, n: int>>", "doc_id"),
}
_made: dict[tuple, _Made] = {}


def corpus(spark: SparkSession, sf_dir: str, analyse: Analyser = simple_tokens) -> Corpus:
    """The searchable corpus of the tables: stored once per session (and again when their files change), as an ingest does, and read by searches."""
    stamp = tuple(Files(spark, f"{sf_dir}/{name}.parquet").stamp() for name in ("documents", "embeddings"))
    key = (spark.sparkContext.applicationId, sf_dir, analyse.__name__, stamp)
    if key not in _made:
        for old in [k for k in _made if k[:3] == key[:3]]:  # of files that have changed since
            delete_path(spark, _made.pop(old).path)
        _made[key] = _store(spark, sf_dir, analyse)
    return _made[key].corpus


@dataclass(frozen=True)
class _Made:
    path: str
    corpus: Corpus


def _store(spark: SparkSession, sf_dir: str, analyse: Analyser) -> _Made:
    store = LayeredStore(spark, new_path(spark, "corpus"), TABLES)
    in_order = lambda name, df: df.select(*[c.name for c in StructType.fromDDL(TABLES[name].schema)])

    def add(base: dict, **tables: DataFrame) -> dict:
        return store.add_layer(base, {k: in_order(k, t) for k, t in tables.items()}, {})

    # each layer is made from what the one before has written
    p = add(store.pointer(), docs=docs(spark, sf_dir), segments=lines(spark, sf_dir))
    d, s = store.read("docs", p), store.read("segments", p)
    p = add(p, postings=index_rows(analysed(s, d, analyse)))
    index = index_in(store.read("postings", p))
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").filter("embedding IS NOT NULL")
    p = add(p, vectors=s.filter("first").select("doc_id", "segment_index").join(given, "doc_id"), sizes=index.sizes)
    ids = lambda found: found.select(F.col("doc_id").alias("external_id"))
    stored = Stored(lambda found: store.find_all("docs", ids(found), p), lambda found: store.find_all("segments", ids(found), p), lambda df: kept(df, "search"))
    postings = lambda terms: store.find("postings", terms, p, "term")
    text = TextIndex(index.postings, store.read("sizes", p), postings, lambda terms: blocks_of(postings(terms)))
    return _Made(store.path, Corpus(d, store.read("vectors", p), text, stored))


def queries(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    """query_id, q, embedding: the first words of each benchmark item, with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    tokens = F.slice(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), 1, words)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(tokens, " ").alias("q")).join(vectors, "query_id", "left")


#: The same as views for DuckDB.
SQL = r"""
docs AS (
  SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS external_id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body,
         source AS kind, lang, CAST(DATE '2020-01-01' + CAST(doc_id % 2000 AS INT) AS VARCHAR) AS published_at
  FROM documents),
lines AS (
  SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, regexp_replace(line, '^TRIM+|TRIM+$', '', 'g') AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
cut AS (
  SELECT doc_id, min(line_no) AS segment_index, arg_min(body, line_no) AS body, sha256(body) AS content_hash FROM lines WHERE body <> '' GROUP BY doc_id, sha256(body)),
segments AS (
  SELECT c.*, e.embedding FROM cut c LEFT JOIN embeddings e ON c.doc_id = e.vec_id AND c.segment_index = (SELECT min(f.segment_index) FROM cut f WHERE f.doc_id = c.doc_id)),
queries AS (
  SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:WORDS], ' ') AS q, e.embedding
  FROM benchmark LEFT JOIN embeddings e ON vec_id = item_id)
""".replace("TRIM", r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
