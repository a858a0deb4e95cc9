"""The registered queries of the search engine, each with its DuckDB twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import evalmetrics, scores, text, vectors
from lodestack.operators import ingest, rag, state, vector_index
from lodestack.operators.fusion import SearchOptions, hybrid_search
from lodestack.operators.lexical import lexical_scores, lexical_top
from lodestack.operators.vector import vector_topk
from lodestack.plans import corpus
from lodestack.plans.corpus import NOW, SQL, docs, queries, segments, table
from lodestack.sources.files import new_path
from lodestack.sources.layers import LayeredStore, Table
from lodestack.plans.search_sql import lexical_sql, search_sql, search_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


WITH_DOCS = "WITH " + SQL.replace("WORDS", "2").strip() + "\n"

# ---- vectors ---------------------------------------------------------------------------------------------------------

_TOPK = """
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS rank
FROM embeddings e {join} JOIN embeddings q ON q.vec_id % 50 = 0 QUALIFY rank <= 10
"""
KINDS = ("src1", "src3", "src5")


def _query_vectors(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_TOPK.format(join=""))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector_topk(e, _query_vectors(e), 10)


@query(_TOPK.format(join="JOIN documents d ON d.doc_id = e.vec_id AND d.source IN ('src1', 'src3', 'src5')"))
def vector_topk_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    of_kind = table(spark, sf_dir, "documents").filter(F.col("source").isin(*KINDS)).select(F.col("doc_id").alias("vec_id"))
    return vector_topk(e.join(of_kind, "vec_id", "left_semi"), _query_vectors(e), 10)


@query()
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk_cosine through stored inverted lists: nearly the same rows, from the lists that are probed."""
    e = table(spark, sf_dir, "embeddings").withColumn("part", F.lit(0))
    lists = vector_index.fit(e, e.count())
    path = new_path(spark, "vector-lists")
    placed = vector_index.assign(e.select("vec_id", "part", "embedding"), lists) if lists else e.select("vec_id", "part", "embedding", F.lit(0).alias("list")).limit(0)
    placed.write.partitionBy("list").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    read = lambda some: stored if some is None else stored.filter(F.col("list").isin(some))
    if lists is None:
        return vector_topk(e, _query_vectors(e), 10)
    return vector_index.nearest_in_lists(read, lists, _query_vectors(e), 10).drop("part")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS magnitude FROM embeddings")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.magnitude(F.col("embedding")), 6).alias("magnitude"))


@query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
    r AS (SELECT doc_id, list_transform(range(48), lambda i: CAST('0x' || substr(h, CAST((i % 32) * 2 + 1 AS INT), 2) AS INT) / 255e0 * 2 - 1) AS v FROM h)
    SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, round(v[48] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS last FROM r"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", vectors.hash_embedding(F.col("text"), 48).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.round(F.col("v")[47].cast("double"), 5).alias("last"))


# ---- keyword retrieval -----------------------------------------------------------------------------------------------


def _lexical(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    return lexical_scores(corpus.corpus(spark, sf_dir).index, queries(spark, sf_dir, words))


@query(lexical_sql("SELECT query_id, doc_id, segment_index FROM hits"))
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 2).select("query_id", "doc_id", "segment_index")


@query(lexical_sql("SELECT query_id, doc_id, segment_index, lexical_score FROM lex_top", 1))
def lexical_rank_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(corpus.corpus(spark, sf_dir).index, queries(spark, sf_dir, 1))


@query(lexical_sql("SELECT query_id, doc_id, segment_index, lexical_score FROM lex_top"))
def lexical_rank_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(corpus.corpus(spark, sf_dir).index, queries(spark, sf_dir, 2))


@query()
def lexical_rank_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.functions.english import english_tokens

    index = corpus.corpus(spark, sf_dir, english_tokens).index
    return lexical_top(index, queries(spark, sf_dir, 3), analyse=english_tokens)


# ---- hybrid search ---------------------------------------------------------------------------------------------------

RULE = scores.RecencyRule(("src0", "src2", "src4", "src6"), 180.0, 0.85)
SEARCHES = {
    "hybrid_search": SearchOptions(),
    "hybrid_semantic_only": SearchOptions(mode="semantic"),
    "hybrid_lexical_only": SearchOptions(mode="lexical"),
    "kind_filtered": SearchOptions(kinds=KINDS),
    "kind_weighted": SearchOptions(kind_weights={"src0": 0.5, "src1": 1.5, "src2": 0.0}),
    "recency_decay": SearchOptions(recency=RULE),
    "score_floor": SearchOptions(min_lexical_score=0.1, min_vector_score=0.2, limit=50),
    "max_chunks_per_doc": SearchOptions(max_chunks_per_doc=3, limit=40),
    "field_weighted": SearchOptions(title_weight=1.0, body_weight=2.0, lexical_weight=0.7, vector_weight=1.3, rrf_k=20),
}
FOUND = "SELECT query_id, position, external_id, score, title, kind, total FROM found"


def _search(spark: SparkSession, sf_dir: str, o: SearchOptions) -> DataFrame:
    c = corpus.corpus(spark, sf_dir)
    return hybrid_search(c.vectors, c.docs, queries(spark, sf_dir), o, _now(), index=c.index, stored=c.stored)


def _registered(o: SearchOptions) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _search(spark, sf_dir, o).drop("snippet")


for _name, _o in SEARCHES.items():
    QUERIES[_name], ORACLE[_name] = _registered(_o), search_sql(_o, FOUND)


@query(search_sql(SearchOptions(limit=1 << 30), "SELECT query_id, any_value(total) AS total, count(*) AS segments, count(DISTINCT content_hash) AS contents FROM (SELECT f.*, sha256(snippet) AS content_hash FROM found f) GROUP BY query_id"))
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, SearchOptions(limit=1 << 30))
    return found.groupBy("query_id").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("segments"), F.count_distinct(F.sha2("snippet", 256)).alias("contents"))


_SEVERAL = SearchOptions(max_chunks_per_doc=4, limit=40)


@query(search_sql(_SEVERAL, "SELECT query_id, external_id, max(score) AS score, min(position) AS first FROM found GROUP BY query_id, external_id"))
def rag_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.retrieved(_search(spark, sf_dir, _SEVERAL))


@query(
    search_sql(
        SearchOptions(limit=5),
        """SELECT query_id, c || chr(10) || chr(10) || 'Answer with citations.' || chr(10) || chr(10) || 'Question: ' || q AS turn
        FROM (SELECT query_id, string_agg('Source [' || position || ']: ' || title || chr(10) || snippet, chr(10) || chr(10) ORDER BY position) AS c FROM found GROUP BY query_id) JOIN queries USING (query_id)""",
    )
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rag.contexts(_search(spark, sf_dir, SearchOptions(limit=5))).join(queries(spark, sf_dir).select("query_id", "q"), "query_id")
    return found.select("query_id", rag.user_turn(rag.context_block(F.col("chunks")), F.lit("Answer with citations."), F.col("q")).alias("turn"))


_ANSWER = "'[test] ' || text || ' Source [' || (turn % 7 + 1) || ']: [' || (turn % 9) || '] and [2] [' || conv_id || ']'"


@query(
    f"""SELECT conv_id, turn, array_to_string(marker_list, ',') AS markers FROM (SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_transform(
            regexp_extract_all(regexp_replace({_ANSWER}, 'Source \\[\\d+\\]:', 'Source:', 'g'), '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS INT)), lambda n: n >= 1 AND n <= 5))) AS marker_list
        FROM conversations)"""
)
def rag_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("answer", F.expr(_ANSWER))
    return c.select("conv_id", "turn", F.array_join(rag.citation_markers(F.col("answer"), F.lit(5)), ",").alias("markers"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS source_url FROM pages"""
)
def citation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    as_text, as_number, none = (F.to_json(F.struct(*c)) for c in ([F.col("url").alias("source_url")], [F.col("page_id").alias("source_url")], [F.col("url").alias("other")]))
    metadata = F.when(F.col("page_id") % 3 == 0, as_text).when(F.col("page_id") % 3 == 1, as_number).otherwise(none)
    return p.select("page_id", rag.citation_url(metadata).alias("source_url"))


@query(
    """SELECT conv_id, '[test] ' || coalesce(arg_max(text, turn) FILTER (role = 'user'), '') || ' [1] [2]' AS answer, CAST(sum(length(text)) FILTER (role <> 'system') AS BIGINT) AS input_chars,
       count(*) FILTER (role <> 'system') AS messages FROM conversations GROUP BY conv_id"""
)
def echo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    last = F.coalesce(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.lit(""))
    said = F.when(F.col("role") != "system", F.char_length("text"))
    return c.groupBy("conv_id").agg(rag.echo_answer(last, 2).alias("answer"), F.sum(said).alias("input_chars"), F.count(said).alias("messages"))


@query(
    f"""SELECT doc_id, round(coalesce(1e0 / (60 + nullif(doc_id % 50, 0)), 0) + coalesce(2e0 / (60 + nullif(doc_id % 7, 0)), 0), 9) AS fused, CASE source WHEN 'src1' THEN 0.5e0 WHEN 'src2' THEN 0e0 ELSE 1e0 END AS weight,
       round(CASE WHEN source IN ('src0', 'src2', 'src4', 'src6') THEN 0.85e0 + CAST({1 - 0.85!r} AS DOUBLE) * pow(2e0, -greatest((epoch(TIMESTAMP '{NOW}') - epoch(CAST(DATE '2020-01-01' + CAST(doc_id % 2000 AS INT) AS TIMESTAMP))) / 86400, 0) / 180e0) ELSE 1e0 END, 9) AS recency
       FROM documents"""
)
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = lambda n: F.nullif(F.col("doc_id") % n, F.lit(0))
    d = docs(spark, sf_dir)
    return d.select(
        "doc_id",
        F.round(scores.rrf(rank(50), rank(7), 60, 1.0, 2.0), 9).alias("fused"),
        scores.kind_weight(F.col("kind"), {"src1": 0.5, "src2": 0.0}).alias("weight"),
        F.round(scores.recency_multiplier(RULE, F.col("kind"), F.col("published_at"), _now()), 9).alias("recency"),
    )


# ---- text and segments -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 3e0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(WITH_DOCS + "SELECT doc_id, segment_index, content_hash, sha256(title || chr(10) || chr(10) || c.body) AS input_hash FROM cut c JOIN docs USING (doc_id)")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("doc_id", "segment_index", "content_hash", F.sha2(text.embedding_input(F.col("title"), F.col("body")), 256).alias("input_hash"))


@query(
    """SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS external_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE source END AS kind, length(text) AS n_chars
    FROM documents WHERE doc_id % 11 <> 0"""
)
def layered_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a layered store: all of them, then a batch that replaces every seventh, then deletes of every eleventh."""
    schema = "external_id string, kind string, n_chars int"
    store = LayeredStore(spark, new_path(spark, "layers"), {"docs": Table(schema, "external_id", ("external_id",))})
    d = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("external_id"), F.col("source").alias("kind"), F.char_length("text").alias("n_chars"))
    batch = d.filter("doc_id % 7 = 0").withColumn("kind", F.lit("changed"))
    n = {"docs": d.count(), "gone": d.count()}
    p = store.add_layer(store.pointer(), {"docs": d.drop("doc_id")}, n)
    p = store.add_layer(p, {"docs": batch.drop("doc_id"), "gone": batch.select("external_id")}, n)
    p = store.add_layer(p, {"gone": d.filter("doc_id % 11 = 0").select("external_id")}, n)
    return store.read("docs", p)


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\s\\x0B]', '', 'g')) AS INT) AS kept_chars, 0 AS over_budget, 0 AS blank FROM documents")
def segment_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", text.chunk_text(F.col("text"), 50).alias("c"))
    size = F.char_length(F.regexp_replace(F.array_join("c", ""), r"[\s\x0B]", ""))
    over = F.size(F.filter("c", lambda x: text.estimate_tokens(x) > 50))
    return chunks.select("doc_id", size.alias("kept_chars"), over.alias("over_budget"), F.size(F.filter("c", lambda x: text.trim(x) == "")).alias("blank"))


@query()
def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.to_segments(docs(spark, sf_dir).select("doc_id", "title", "body"), 200).select("doc_id", "segment_index", "content_hash", "n_chunks")


@query(WITH_DOCS + "SELECT doc_id, count(*) AS lines, count(DISTINCT sha256(body)) AS segments FROM lines WHERE body <> '' GROUP BY doc_id")
def dup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: text.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", kept.alias("chunks")).filter(F.size("chunks") > 0)
    return d.select("doc_id", F.size("chunks").cast("long").alias("lines"), F.size(ingest.distinct_segments(F.col("chunks"))).cast("long").alias("segments"))


# ---- ingest ----------------------------------------------------------------------------------------------------------

# the stored state has every document without its last line, the new one without its first line
_STATES = WITH_DOCS.rstrip() + """,
every AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last_no FROM lines),
old AS (SELECT doc_id, sha256(body) AS h, min(line_no) AS n FROM every WHERE body <> '' AND line_no < last_no GROUP BY ALL),
new AS (SELECT doc_id, sha256(body) AS h, min(line_no) AS n FROM every WHERE body <> '' AND line_no > 0 GROUP BY ALL),
d AS (SELECT doc_id, h, old.n AS old_index, new.n AS new_index FROM new FULL JOIN (SELECT * FROM old WHERE doc_id IN (SELECT doc_id FROM new)) old USING (doc_id, h))
"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, last = corpus.numbered_lines(F.col("text")), F.size(F.split("text", "\n")) - 1

    def side(keep: Callable[[Column], Column]) -> DataFrame:
        every = corpus.distinct_lines(F.filter(lines, lambda s: keep(s["at"])))
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.content_hash", "s.segment_index")

    return side(lambda at: at < last), side(lambda at: at > 0)


@query(_STATES + "SELECT doc_id, h AS content_hash, old_index, new_index, CASE WHEN old_index IS NULL THEN 'changed' WHEN new_index IS NULL THEN 'removed' ELSE 'unchanged' END AS state FROM d")
def ingest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return ingest.diff(new, old, "doc_id")


@query(
    _STATES
    + """SELECT doc_id, count(new_index) AS segments, count(*) FILTER (old_index IS NULL) AS changed, count(*) FILTER (old_index IS NOT NULL AND new_index IS NOT NULL) AS unchanged,
         count(*) FILTER (new_index IS NULL) AS removed FROM d GROUP BY doc_id"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return ingest.report(ingest.diff(new, old, "doc_id"), "doc_id")


@query(
    """WITH stored AS (SELECT doc_id AS id, source AS kind, '{"lang":"' || lang || '"}' AS metadata, TIMESTAMP '2024-01-01' AS created_at FROM documents),
    new AS (SELECT page_id * 2 AS id, CASE WHEN page_id % 2 = 0 THEN 'page' END AS kind FROM pages)
    SELECT coalesce(n.id, s.id) AS id, CASE WHEN n.id IS NULL THEN s.kind ELSE n.kind END AS kind, CASE WHEN n.id IS NULL THEN s.metadata ELSE '{}' END AS metadata,
           strftime(coalesce(s.created_at, TIMESTAMP '2026-07-13'), '%Y-%m-%d') AS created, strftime(CASE WHEN n.id IS NULL THEN s.created_at ELSE TIMESTAMP '2026-07-13' END, '%Y-%m-%d') AS updated
    FROM stored s FULL JOIN new n ON n.id = s.id"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.lit("2024-01-01").cast("timestamp")
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"), F.to_json(F.struct("lang")).alias("metadata"), born.alias("created_at"), born.alias("updated_at"))
    new = table(spark, sf_dir, "pages").select((F.col("page_id") * 2).alias("id"), F.when(F.col("page_id") % 2 == 0, "page").alias("kind"), F.lit(None).cast("string").alias("metadata"))
    merged = ingest.merge_documents(stored, new, _now(), ("id",))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return merged.select("id", "kind", "metadata", day("created_at").alias("created"), day("updated_at").alias("updated"))


@query(
    WITH_DOCS
    + "SELECT doc_id, count(*) AS n, count(*) <= 8 AS accepted, CASE WHEN count(*) > 8 THEN 'document produces ' || count(*) || ' segments, exceeding limit of 8' END AS error FROM lines WHERE body <> '' GROUP BY doc_id"
)
def segment_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: text.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n")).filter("n > 0")
    good, bad = ingest.split_by_limit(d, F.col("n"), 8)
    return good.select("doc_id", F.col("n").cast("long"), F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error")).union(bad.select("doc_id", F.col("n").cast("long"), F.lit(False), "error"))


@query(_STATES + "SELECT n.doc_id, n.h AS content_hash, n.n AS segment_index, old.h IS NOT NULL AS embedded FROM new n LEFT JOIN old USING (doc_id, h) UNION ALL SELECT doc_id, h, n, true FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    stored = old.withColumn("embedding", F.array(F.lit(1.0)))
    merged = ingest.merge_segments(stored, new, key=("doc_id",))
    return merged.select("doc_id", "content_hash", "segment_index", F.col("embedding").isNotNull().alias("embedded"))


@query("SELECT doc_id, source AS kind FROM documents WHERE doc_id NOT IN (SELECT page_id * 3 FROM pages)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "pages").select((F.col("page_id") * 3).alias("doc_id"))
    return ingest.delete_documents(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind")), gone, "doc_id")


# ---- state -----------------------------------------------------------------------------------------------------------


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS external_id, '2026-07-13' AS updated_at, source AS kind, '{}' AS metadata FROM documents WHERE lpad(CAST(doc_id AS VARCHAR), 9, '0') > '000000099' ORDER BY external_id LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string")).withColumn("updated_at", F.lit("2026-07-13"))
    return state.page(d, state.clamp_limit("100"), "000000099")


@query(WITH_DOCS + "SELECT lang, count(DISTINCT doc_id) AS total_documents, count(content_hash) AS total_segments FROM docs LEFT JOIN cut USING (doc_id) GROUP BY lang")
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return state.counters(d, segments(spark, sf_dir).join(d.select("doc_id", "lang"), "doc_id"), "lang")


@query("SELECT label, CAST(len(arg_min(embedding, vec_id)) AS INT) AS dimensions FROM embeddings GROUP BY label")
def dims_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.dimensions(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query(
    WITH_DOCS
    + """SELECT kind, count(*) FILTER (n BETWEEN 1 AND 8) AS indexed, count(*) FILTER (n = 0) AS skipped, count(*) FILTER (n > 8) AS failed
    FROM (SELECT d.doc_id, d.kind, count(l.doc_id) AS n FROM docs d LEFT JOIN (SELECT * FROM lines WHERE body <> '') l USING (doc_id) GROUP BY ALL) GROUP BY kind"""
)
def ingest_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: text.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("kind"), F.size(lines).alias("n"))
    good, bad = ingest.split_by_limit(d, F.col("n"), 8)
    ended = good.select("kind", F.when(F.col("n") == 0, "skipped").otherwise("indexed").alias("status"), F.lit(None).cast("string").alias("error"))
    return ingest.run_counters(ended.union(bad.select("kind", F.lit("rejected"), "error")), ["kind"])


@query("SELECT page_id, url AS next_url FROM pages")
def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.sources.rest import next_link

    header = F.concat(F.lit('<https://first.test/>; rel="prev", <'), "url", F.lit('>;  rel="next"'))
    return table(spark, sf_dir, "pages").select("page_id", next_link(header).alias("next_url"))


# ---- evaluation ------------------------------------------------------------------------------------------------------

_A, _B = SearchOptions(mode="lexical", limit=50), SearchOptions(limit=50)


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, category, a, b: ranked identifiers of two searches."""
    ids = lambda o, name: _search(spark, sf_dir, o).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "external_id"))), lambda x: x["external_id"]).alias(name))
    both = ids(_A, "a").join(ids(_B, "b"), "query_id")
    return both.withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))


def _captures_sql() -> str:
    one = lambda o, n: f"{n} AS (WITH {search_views(o)} SELECT query_id, list(external_id ORDER BY position) AS ids FROM found GROUP BY query_id)"
    return (
        f"WITH {one(_A, 'ca')}, {one(_B, 'cb')},\ncap AS (SELECT query_id, 'c' || (query_id % 3) AS category, ca.ids AS a, cb.ids AS b FROM ca JOIN cb USING (query_id)),\n"
        "m AS (SELECT *, len(list_filter(a[1:10], lambda x: list_contains(b[1:10], x))) / CAST(least(10, greatest(len(a[1:10]), len(b[1:10]))) AS DOUBLE) AS ovl, list_filter(a, lambda x: list_contains(b, x)) AS sa, list_filter(b, lambda x: list_contains(a, x)) AS sb FROM cap),\n"
        "e AS (SELECT query_id, category, round(ovl, 6) AS overlap, CASE WHEN len(sa) >= 2 THEN round(1 - 6 * list_sum(list_transform(sa, lambda x, i: pow(CAST(i - list_position(sb, x) AS DOUBLE), 2))) / (CAST(len(sa) AS DOUBLE) * (CAST(len(sa) AS DOUBLE) * len(sa) - 1)), 6) END AS rho FROM m)\n"
    )


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _captures(spark, sf_dir)
    return c.select("query_id", "category", F.round(evalmetrics.overlap_at_k(F.col("a"), F.col("b"), 10), 6).alias("overlap"), F.round(evalmetrics.spearman_shared(F.col("a"), F.col("b")), 6).alias("rho"))


@query(_captures_sql() + "SELECT query_id, overlap FROM e")
def overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("query_id", "overlap")


@query(_captures_sql() + "SELECT query_id, rho FROM e")
def spearman_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("query_id", "rho")


@query(_captures_sql() + "SELECT coalesce(category, 'ALL') AS category, count(*) AS n, round(avg(overlap), 4) AS overlap, round(avg(rho), 4) AS rho FROM e GROUP BY GROUPING SETS ((category), ())")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _measured(spark, sf_dir).rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 4).alias("overlap"), F.round(F.avg("rho"), 4).alias("rho"))
    return rolled.withColumn("category", F.coalesce("category", F.lit("ALL")))


@query(
    "WITH found AS (" + search_sql(_B, "SELECT DISTINCT query_id FROM found") + ") SELECT count(*) AS queries, count(*) FILTER (found.query_id IS NULL) AS empty FROM benchmark b LEFT JOIN found ON found.query_id = b.item_id"
)
def empty_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.empty_queries(queries(spark, sf_dir), _search(spark, sf_dir, _B))


@query(_captures_sql() + "SELECT query_id, overlap FROM e WHERE overlap < 0.7 ORDER BY overlap, query_id LIMIT 15")
def most_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).filter("overlap < 0.7").orderBy("overlap", "query_id").limit(15).select("query_id", "overlap")


# ---- pages -----------------------------------------------------------------------------------------------------------


@query()
def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.functions import html

    html.small_batches(spark)
    parse = html.pipeline(html.extract_meta(), html.extract_title(), html.clean_whitespace(), html.remove("nav, footer"), html.to_markdown())
    p = table(spark, sf_dir, "pages").select("page_id", parse(F.col("html")).alias("p"))
    return p.select("page_id", "p.title", "p.body", F.to_json("p.metadata").alias("metadata"), "p.error")


@query()
def kb_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.functions import html

    html.small_batches(spark)
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("Article "), "page_id").alias("title"), "url", F.lit("2020-01-01T00:00:00.000+0000").alias("last_published_at"), F.col("html").alias("content"))
    return html.kb_transform(p, "https://kb.test/articles/", "kb")


__all__ = ["ORACLE", "QUERIES", "corpus"]
