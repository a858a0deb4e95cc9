"""DuckDB statements for the registered search queries, put together from the same options as the plans."""

from __future__ import annotations

from lodestack.operators.fusion import SearchOptions
from lodestack.operators.lexical import POOL
from lodestack.plans.corpus import NOW, SQL

LEXICAL = r"""
qt AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')) AS term FROM queries)),
tt AS (SELECT doc_id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS toks FROM docs_in),
bt AS (SELECT doc_id, segment_index, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS toks FROM segments_in),
tocc AS (SELECT query_id, n_terms, doc_id, term, pos FROM (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM tt) JOIN qt USING (term)),
bocc AS (SELECT query_id, n_terms, doc_id, segment_index, term, pos FROM (SELECT doc_id, segment_index, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM bt) JOIN qt USING (term)),
hits AS (
  SELECT query_id, n_terms, doc_id, segment_index FROM bocc GROUP BY ALL HAVING count(DISTINCT term) = n_terms
  UNION
  SELECT query_id, n_terms, doc_id, segment_index FROM (SELECT query_id, n_terms, doc_id FROM tocc GROUP BY ALL HAVING count(DISTINCT term) = n_terms) JOIN bt USING (doc_id)),
occ AS (
  SELECT h.query_id, h.n_terms, h.doc_id, h.segment_index, o.term, o.pos, {title_w} AS w FROM hits h JOIN tocc o USING (query_id, doc_id)
  UNION ALL
  SELECT h.query_id, h.n_terms, h.doc_id, h.segment_index, o.term, o.pos + len(tt.toks), {body_w} FROM hits h JOIN bocc o USING (query_id, doc_id, segment_index) JOIN tt USING (doc_id)),
lasts AS (
  SELECT a.query_id, a.n_terms, a.doc_id, a.segment_index, a.pos, b.term, max(b.pos) AS last
  FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.segment_index = b.segment_index AND b.pos <= a.pos GROUP BY ALL),
covers AS (
  SELECT query_id, doc_id, segment_index, p, min(pos) AS q
  FROM (SELECT query_id, n_terms, doc_id, segment_index, pos, min(last) AS p FROM lasts GROUP BY ALL HAVING count(*) = n_terms) GROUP BY ALL),
gains AS (
  SELECT c.query_id, c.doc_id, c.segment_index, c.p, c.q, count(*) AS n, sum(1e0 / w) AS inv
  FROM covers c JOIN occ x ON c.query_id = x.query_id AND c.doc_id = x.doc_id AND c.segment_index = x.segment_index AND x.pos BETWEEN c.p AND c.q GROUP BY ALL),
lex AS (
  SELECT query_id, doc_id, segment_index, round(sum(n / inv / (1 + (q - p) - (n - 1))) / ln(CAST(any_value(len(tt.toks) + len(bt.toks)) AS DOUBLE) + 1), 6) AS lexical_score
  FROM gains JOIN tt USING (doc_id) JOIN bt USING (doc_id, segment_index) GROUP BY query_id, doc_id, segment_index),
lex_top AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id, segment_index) <= {pool})
"""

VECTOR = """
vec_top AS (
  SELECT q.query_id, s.doc_id, s.segment_index, round(list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS vector_score
  FROM segments_in s JOIN queries q ON s.embedding IS NOT NULL AND q.embedding IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY vector_score DESC, s.doc_id) <= {pool})
"""

FUSED = """
pool AS ({pool_sql}),
ranked AS (
  SELECT *, CASE WHEN lexical_score > {o.min_lexical_score} THEN row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id, segment_index) END AS lr,
         CASE WHEN vector_score > {o.min_vector_score} THEN row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, doc_id, segment_index) END AS vr
  FROM pool),
scored AS (
  SELECT r.*, d.external_id, d.title, d.kind, s.body, s.content_hash,
         round((coalesce(CAST({o.lexical_weight} AS DOUBLE) / (CAST({o.rrf_k} AS DOUBLE) + lr), 0) + coalesce(CAST({o.vector_weight} AS DOUBLE) / (CAST({o.rrf_k} AS DOUBLE) + vr), 0)) * {kind} * {recency}, {o.decimals}) AS score,
         CAST(lr IS NOT NULL AS INT) + CAST(vr IS NOT NULL AS INT) AS passes
  FROM ranked r JOIN docs_in d USING (doc_id) JOIN segments_in s USING (doc_id, segment_index) WHERE lr IS NOT NULL OR vr IS NOT NULL),
capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {order}) <= {o.max_chunks_per_doc}),
kept AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY {order}) = 1),
found AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position, external_id, score, title, body AS snippet, kind,
         (SELECT count(DISTINCT k.doc_id) FROM kept k WHERE k.query_id = kept.query_id) AS total
  FROM kept QUALIFY position <= {o.limit})
"""

ORDER = "score DESC, passes DESC, (vr IS NOT NULL) DESC, lexical_score DESC, vector_score DESC, external_id, segment_index"
NONE = "SELECT query_id, doc_id, segment_index, {}, {} FROM {}"


def lexical_sql(final: str, words: int = 2) -> str:
    """The statement of a keyword retrieval with title weight 3 and body weight 1; `final` selects from lex or hits."""
    ctes = [SQL.replace("WORDS", str(words)), "docs_in AS (SELECT * FROM docs)", "segments_in AS (SELECT * FROM segments)", LEXICAL.format(title_w="1e0", body_w="(1e0 / 3)", pool=POOL)]
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final


def search_sql(o: SearchOptions, final: str, words: int = 2, more: str = "") -> str:
    """The statement of one search; `final` selects from found. `more` adds views after it."""
    return "WITH " + search_views(o, words) + more + "\n" + final


def search_views(o: SearchOptions, words: int = 2) -> str:
    where = "" if o.kinds is None else " WHERE kind IN (" + ", ".join(f"'{k}'" for k in o.kinds) + ")"
    scale = max(o.title_weight, o.body_weight)
    ctes = [SQL.replace("WORDS", str(words)), f"docs_in AS (SELECT * FROM docs{where})", "segments_in AS (SELECT * FROM segments WHERE doc_id IN (SELECT doc_id FROM docs_in))"]
    if o.mode != "semantic":
        ctes.append(LEXICAL.format(title_w=f"CAST({o.title_weight / scale!r} AS DOUBLE)", body_w=f"CAST({o.body_weight / scale!r} AS DOUBLE)", pool=POOL))
    if o.mode != "lexical":
        ctes.append(VECTOR.format(pool=POOL))
    pool = {
        "hybrid": "SELECT query_id, doc_id, segment_index, coalesce(lexical_score, 0) AS lexical_score, coalesce(vector_score, 0) AS vector_score FROM lex_top FULL JOIN vec_top USING (query_id, doc_id, segment_index)",
        "lexical": NONE.format("lexical_score", "CAST(0 AS DOUBLE) AS vector_score", "lex_top"),
        "semantic": NONE.format("CAST(0 AS DOUBLE) AS lexical_score", "vector_score", "vec_top"),
    }[o.mode]
    kind = "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in o.kind_weights.items()) + " ELSE 1 END" if o.kind_weights else "1"
    recency = "1"
    if r := o.recency:
        age = f"greatest((epoch(TIMESTAMP '{NOW}') - epoch(CAST(published_at AS TIMESTAMP))) / 86400, 0)"
        kinds = ", ".join(f"'{k}'" for k in r.kinds)
        recency = f"CASE WHEN kind IN ({kinds}) THEN CAST({r.floor} AS DOUBLE) + CAST({1 - r.floor!r} AS DOUBLE) * pow(CAST(2 AS DOUBLE), -{age} / CAST({r.half_life_days} AS DOUBLE)) ELSE 1 END"
    ctes.append(FUSED.format(o=o, pool_sql=pool, kind=kind, recency=recency, order=ORDER))
    return ",\n".join(c.strip() for c in ctes)
