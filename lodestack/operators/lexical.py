"""Keyword retrieval for batches of queries over a text index: match in a field, cover-density rank, top k.

The index of a corpus is three tables. `postings` has a row per word and field (term, doc_id, segment_index, level, at: its places), where segment_index TITLE
stands for the title; `sizes` has a row per document with the lengths of its fields; `blocks` counts the postings of a term by level. A search
joins its few terms to the postings, so it handles the occurrences of those terms and no other words.

A level bounds what a word adds to a segment's rank: a cover needs an occurrence of its own to end at and gains one at most, so no rank is above
the sum of its words' occurrences, in title and segment, over ln(positions + 1). Postings are stored in order of term and level. For a query of
frequent words the best levels are ranked first; the k-th rank found is a threshold, and levels of segments that cannot reach it with the best of all
other words are not read. Words of titles are always read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import let, simple_tokens
from lodestack.operators.covers import Covers

POOL = 200
#: segment_index of words that stand in the title
TITLE = -1
#: scores are kept at this many decimals, so that an order does not depend on the order of additions
DECIMALS = 6
#: distinct terms that are named to the scan, and that are looked at for it
PUSHED_TERMS, BROADCAST_TERMS = 1_000, 100_000
#: rows of query terms that are broadcast; a larger batch is joined by shuffling
BROADCAST_ROWS = 200_000
#: levels of one unit of rank; words of titles stand above all levels, so that no cut leaves them out
LEVELS, TITLED = 16, 1 << 24
#: postings of a query's words from which its best levels are ranked first, and postings of a word that are ranked then
HEAVY_ROWS, SAMPLE_ROWS = 200_000, 10_000
#: words of a batch whose cuts are named to the scan
NAMED_CUTS = 10
Analyser = Callable[[Column], Column]
#: query_id, term, and the least level of segments that is looked at
Cuts = list[tuple[object, str, int]]


@dataclass(frozen=True)
class TextIndex:
    """postings(term, doc_id, segment_index, level, at) and sizes(doc_id, n_title, fields: array of segment_index and n).

    `find` and `blocks` give the postings and the counts (term, titled, level, n) of some terms, where a store knows which files hold them.
    """

    postings: DataFrame
    sizes: DataFrame
    find: Callable[[list[str]], DataFrame] | None = None
    blocks: Callable[[list[str]], DataFrame] | None = None


def analysed(segments: DataFrame, docs: DataFrame, analyse: Analyser = simple_tokens) -> DataFrame:
    """doc_id, segment_index, tokens, titled (tokens of the title, for a segment) of every field of segments(doc_id, segment_index, body) and docs(doc_id, title).

    Segments that have their document's title are not joined to it.
    """
    if "title" not in segments.columns:
        segments = segments.join(docs.select("doc_id", "title"), "doc_id", "left")
    tokens = lambda c: analyse(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>").alias("titled")
    titles = docs.select("doc_id", F.lit(TITLE).alias("segment_index"), tokens("title").alias("tokens"), none)
    return titles.union(segments.select("doc_id", F.col("segment_index").cast("int").alias("segment_index"), tokens("body").alias("tokens"), tokens("title").alias("titled")))


def places(tokens: Column) -> Column:
    """array<struct<term, at: array<int>>>: each term of an array of tokens with its places; sorted, so it takes n log n time."""
    coded = F.array_sort(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: x["term"].isNotNull()))

    def runs(c: Column) -> Column:
        every = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(c, i)["term"] != F.get(c, i - 1)["term"]))
        run = lambda s, i, k: F.slice(c, i + 1, F.coalesce(F.get(s, k + 1), F.size(c)) - i)
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(c, i)["term"].alias("term"), F.transform(run(s, i, k), lambda x: x["pos"]).alias("at"))))

    return let(coded, runs)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of fields (doc_id, segment_index, tokens, titled), those of a batch in order of term, then the fields' lengths."""
    for b in batches:
        lengths = [pc.fill_null(pc.list_value_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
        every = pa.concat_arrays([b.column(2).flatten(), b.column(3).flatten()]).dictionary_encode()
        names = every.dictionary.take(sorted_at := pc.array_sort_indices(every.dictionary))
        rank = np.empty(len(names) + 1, np.int64)
        rank[-1] = -1
        rank[sorted_at.to_numpy()] = np.arange(len(names))
        code = rank[pc.fill_null(every.indices, -1).to_numpy(zero_copy_only=False)]
        row = [np.repeat(np.arange(b.num_rows), n) for n in lengths]
        at = np.arange(len(row[0])) - np.repeat(np.cumsum(lengths[0]) - lengths[0], lengths[0])
        key, titled = (c * b.num_rows + r for c, r in zip((code[: len(at)], code[len(at) :]), row, strict=True))
        order = np.argsort(key, kind="stable")  # by term and field, places in order
        order = order[np.searchsorted(key[order], 0) :]  # nulls are words that take a place and match nothing
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        own, n = key[first], np.diff(first, append=len(key))
        also, times = np.unique(titled[titled >= 0], return_counts=True)
        place = np.minimum(np.searchsorted(also, own), max(0, len(also) - 1))
        found = n + (np.where(also[place] == own, times[place], 0) if len(also) else 0)
        field, term = own % max(1, b.num_rows), own // max(1, b.num_rows)
        segment = b.column(1).to_numpy(zero_copy_only=False)
        level = np.ceil(LEVELS * found / np.log((lengths[0] + lengths[1])[field] + 1.0)).astype(np.int32) + np.where(segment[field] == TITLE, TITLED, 0).astype(np.int32)
        ends = np.concatenate([first, len(key) + np.arange(b.num_rows + 1)])  # and one number for each field
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([at[order], lengths[0]]), pa.int32()))
        of = pa.array(np.concatenate([field, np.arange(b.num_rows)]))
        words = pa.concat_arrays([names.take(pa.array(term)), pa.nulls(b.num_rows, names.type)])
        levels = pa.array(np.concatenate([level, np.zeros(b.num_rows, np.int32)]), pa.int32())
        yield pa.RecordBatch.from_arrays([words, b.column(0).take(of), b.column(1).take(of), levels, lists], names=["term", "doc_id", "segment_index", "level", "at"])


def index_rows(fields: DataFrame) -> DataFrame:
    """The postings of analysed fields, and for each field a row without a term that has its length: all of an index in one pass.

    A field's words are sorted in Arrow batches: as array expressions in a row that took several times as long.
    """
    return fields.select("doc_id", "segment_index", "tokens", "titled").mapInArrow(_words, f"term string, doc_id {dict(fields.dtypes)['doc_id']}, segment_index int, level int, at array<int>")


def index_in(rows: DataFrame) -> TextIndex:
    """The index in index_rows."""
    every = rows.filter("term IS NULL").groupBy("doc_id").agg(F.collect_list(F.struct("segment_index", F.col("at")[0].alias("n"))).alias("every"))
    title = F.get(F.filter("every", lambda f: f["segment_index"] == TITLE), F.lit(0))["n"]
    sizes = every.filter(title.isNotNull()).select("doc_id", title.alias("n_title"), F.filter("every", lambda f: f["segment_index"] != TITLE).alias("fields"))
    return TextIndex(rows.filter("term IS NOT NULL"), sizes)


def index_of(fields: DataFrame) -> TextIndex:
    """The index of analysed fields, which are best written before: both tables are made from them."""
    lengths = fields.select(F.lit(None).cast("string").alias("term"), "doc_id", "segment_index", F.array(F.size("tokens")).alias("at"))
    return TextIndex(index_rows(fields).filter("term IS NOT NULL"), index_in(lengths).sizes)


def blocks_of(postings: DataFrame) -> DataFrame:
    """term, titled, level, n: the postings of each term by kind of field and level."""
    return postings.groupBy("term", (F.col("level") >= TITLED).alias("titled"), (F.col("level") % TITLED).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def text_index(segments: DataFrame, docs: DataFrame, analyse: Analyser = simple_tokens) -> TextIndex:
    """The index of segments(doc_id, segment_index, body) and docs(doc_id, title)."""
    return index_of(analysed(segments, docs, analyse))


def query_terms(queries: DataFrame, analyse: Analyser = simple_tokens) -> DataFrame:
    """query_id, term, term_no (from 0), n_terms: the distinct terms of queries(query_id, q); all have to match."""
    kept = F.array_distinct(F.filter(analyse(F.col("q")), lambda t: t.isNotNull()))
    found = queries.select("query_id", kept.alias("terms"))
    return found.select("query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("term_no", "term"))


def cover_density(occ: Column, n_terms: Column, n_positions: Column, title_weight: Column | float, body_weight: Column | float) -> Column:
    """Cover-density rank of sorted occurrences (pos, term_no, titled), over ln(positions + 1).

    A cover is a smallest window that holds every term; it scores its occurrences' mean weight (harmonic), less the
    more other words stand in it. One pass: the least of the terms' last places is where the cover ending here begins. Occurrences in
    the title come first, so their number in a cover follows from its two ends.
    """
    none = F.array_repeat(F.lit(-1), n_terms)
    zero = F.struct(none.alias("last"), F.lit(0).alias("at"), F.lit(-1).alias("left"), F.lit(0.0).alias("score"))

    def scored(occ: Column, n_titled: Column) -> Column:
        def step(s: Column, o: Column) -> Column:
            last = F.transform(s["last"], lambda v, i: F.when(i == o["term_no"], s["at"]).otherwise(v))

            def close(left: Column, last: Column) -> Column:
                new = (left >= 0) & (left > s["left"])
                n = s["at"] - left + 1
                in_title = F.greatest(F.least(s["at"] + 1, n_titled) - left, F.lit(0))
                inverse = in_title / F.lit(title_weight) + (n - in_title) / F.lit(body_weight)
                gain = n / inverse / (1 + (o["pos"] - F.get(occ, left)["pos"]) - (n - 1))
                score = s["score"] + F.when(new, gain).otherwise(F.lit(0.0))
                return F.struct(last.alias("last"), (s["at"] + 1).alias("at"), F.when(new, left).otherwise(s["left"]).alias("left"), score.alias("score"))

            return let(last, lambda last: let(F.array_min(last), lambda left: close(left, last)))

        return F.aggregate(occ, zero, step, lambda s: s["score"])

    total = let(occ, lambda occ: let(F.size(F.filter(occ, lambda o: o["titled"])), lambda n: scored(occ, n)))
    return total / F.log(n_positions.cast("double") + 1)


def matches(index: TextIndex, queries: DataFrame, analyse: Analyser = simple_tokens) -> DataFrame:
    """query_id, n_terms, doc_id, segment_index, n_title, n_body, title_occ, body_occ of every match, for batches of any size.

    A segment matches when its body or its document's title holds every term.
    """
    terms = query_terms(queries, analyse)
    words = [r["term"] for r in terms.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()]
    postings = index.postings
    if len(words) <= PUSHED_TERMS:  # the scan skips files and row groups that hold none of them
        postings = (index.find(words) if index.find else postings).filter(F.col("term").isin(words))
    small = F.broadcast(terms) if len(words) <= BROADCAST_TERMS and terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else terms
    found = postings.join(small, "term").repartition("query_id", "doc_id")
    placed = F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("term_no").alias("term_no")))
    found = found.select("query_id", "n_terms", "doc_id", "segment_index", placed.alias("occ"))
    # both groupings keep to the one shuffle by query and document
    fields = found.groupBy("query_id", "n_terms", "doc_id", "segment_index").agg(F.array_sort(F.flatten(F.collect_list("occ"))).alias("occ"))
    whole = F.size(F.array_distinct(F.col("occ.term_no"))) == F.col("n_terms")
    of_doc = fields.withColumn("whole", whole).groupBy("query_id", "n_terms", "doc_id").agg(F.collect_list(F.struct("segment_index", "whole", "occ")).alias("f"))
    title = F.get(F.filter("f", lambda x: x["segment_index"] == TITLE), F.lit(0))
    named = of_doc.filter(F.exists("f", lambda x: x["whole"])).withColumn("title", title)
    bodies = F.map_from_entries(F.transform(F.filter("f", lambda x: x["segment_index"] != TITLE), lambda x: F.struct(x["segment_index"], F.struct(x["whole"], x["occ"]))))
    joined = named.select("query_id", "n_terms", "doc_id", "title", bodies.alias("bodies")).join(index.sizes, "doc_id")
    # all segments of a document whose title matches; else those whose body does
    hit = lambda s: F.coalesce(F.col("title.whole"), F.lit(False)) | F.coalesce(F.try_element_at("bodies", s["segment_index"])["whole"], F.lit(False))
    rows = joined.select("query_id", "n_terms", "doc_id", "title", "bodies", "n_title", F.explode(F.filter("fields", hit)).alias("s"))
    none = F.array().cast("array<struct<pos:int,term_no:int>>")
    return rows.select(
        "query_id", "n_terms", "doc_id", F.col("s.segment_index").alias("segment_index"), "n_title", F.col("s.n").alias("n_body"),
        F.coalesce("title.occ", none).alias("title_occ"), F.coalesce(F.try_element_at("bodies", F.col("s.segment_index"))["occ"], none).alias("body_occ"),
    )


def _above_cuts(postings: DataFrame, terms: DataFrame, words: list[str], cuts: Cuts) -> DataFrame:
    """Postings that some query of the batch has not cut; more than NAMED_CUTS words are joined, as a filter would try one after the other on every row."""
    least: dict[str, int] = {}
    uncut = {(r["query_id"], r["term"]) for r in terms.select("query_id", "term").collect()} - {(q, t) for q, t, _ in cuts}  # PUSHED_TERMS at most
    for _, t, cut in cuts:
        least[t] = min(cut, least.get(t, cut))
    high = {t: c for t, c in least.items() if c > 0 and t not in {t for _, t in uncut}}
    if len(high) > NAMED_CUTS:
        table = postings.sparkSession.createDataFrame([(w, high.get(w, 0)) for w in words], "term string, _cut int").coalesce(1)
        return postings.join(F.broadcast(table), "term").filter(F.col("level") >= F.col("_cut")).drop("_cut")
    return postings.filter(reduce(Column.__or__, [(F.col("term") == t) & (F.col("level") >= c) for t, c in high.items()], F.col("term").isin([w for w in words if w not in high])))


def _by_document(index: TextIndex, terms: DataFrame, title_weight: float, body_weight: float, cuts: Cuts | None) -> DataFrame | None:
    """query_id, doc_id, segment_index, covers, positions of every match; none if the batch is too large to go to the tasks with the plan.

    Of cut words, what some query of the batch looks at is looked at for all, which can only find more.
    """
    few = terms.limit(BROADCAST_ROWS + 1).toArrow()
    words = pc.unique(few["term"]).to_pylist()
    if few.num_rows > BROADCAST_ROWS or len(words) > BROADCAST_TERMS:
        return None
    postings = index.postings
    if len(words) <= PUSHED_TERMS:  # the scan skips files and row groups that hold none of them
        postings = (index.find(words) if index.find else postings).filter(F.col("term").isin(words))
    else:
        postings = postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    if cuts:
        postings = _above_cuts(postings, terms, words, cuts)
    of_word = postings.select("doc_id", "segment_index", "term", "at", F.lit(0).alias("n"))
    size = F.concat(F.array(F.struct(F.lit(TITLE).alias("segment_index"), F.col("n_title").alias("n"))), "fields")
    of_field = index.sizes.select("doc_id", F.explode(size).alias("f")).select("doc_id", "f.segment_index", F.lit(None).cast("string"), F.array().cast("array<int>"), "f.n")
    rows = of_word.union(of_field).filter("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id")
    of = dict(terms.dtypes)["query_id"], dict(postings.dtypes)["doc_id"]
    return rows.mapInArrow(Covers.of(few, TITLE, title_weight, body_weight).run, f"query_id {of[0]}, doc_id {of[1]}, segment_index int, covers double, positions long")


def lexical_scores(index: TextIndex, queries: DataFrame, title_weight: float = 3.0, body_weight: float = 1.0, analyse: Analyser = simple_tokens, cuts: Cuts | None = None) -> DataFrame:
    """query_id, doc_id, segment_index, lexical_score of every match for queries(query_id, q); the rank looks at title and body in a row.

    Postings below the `cuts` are left out: what would match by them is lost or ranked lower.
    """
    scale = max(title_weight, body_weight)
    found = _by_document(index, query_terms(queries, analyse), title_weight / scale, body_weight / scale, cuts)
    if found is not None:
        score = F.col("covers") / F.log(F.col("positions").cast("double") + 1)
        return found.select("query_id", "doc_id", "segment_index", F.round(score, DECIMALS).alias("lexical_score"))
    place = lambda occ, shift, titled: F.transform(occ, lambda o: F.struct((o["pos"] + shift).alias("pos"), o["term_no"].alias("term_no"), F.lit(titled).alias("titled")))
    occ = F.concat(place(F.col("title_occ"), F.lit(0), True), place(F.col("body_occ"), F.col("n_title"), False))
    score = cover_density(occ, F.col("n_terms"), F.col("n_title") + F.col("n_body"), title_weight / scale, body_weight / scale)
    return matches(index, queries, analyse).select("query_id", "doc_id", "segment_index", F.round(score, DECIMALS).alias("lexical_score"))


def top(scored: DataFrame, score: str, k: int = POOL) -> DataFrame:
    """The k best per query; the window's limit is applied in each task before rows are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id", "segment_index")
    return scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def lexical_top(index: TextIndex, queries: DataFrame, title_weight: float = 3.0, body_weight: float = 1.0, analyse: Analyser = simple_tokens, k: int = POOL) -> DataFrame:
    """The k best of lexical_scores per query; for frequent words only levels of postings that can be among them are read."""
    cuts = level_cuts(index, queries, title_weight, body_weight, analyse, k) if index.blocks else None
    return top(lexical_scores(index, queries, title_weight, body_weight, analyse, cuts), "lexical_score", k)


def level_cuts(index: TextIndex, queries: DataFrame, title_weight: float, body_weight: float, analyse: Analyser, k: int, heavy_rows: int | None = None, sample_rows: int | None = None) -> Cuts:
    """The least levels that can reach the k best, for the queries of frequent words that have k matches among their best levels.

    A batch of more than PUSHED_TERMS terms is not looked at.
    """
    heavy_rows, sample_rows = heavy_rows or HEAVY_ROWS, sample_rows or SAMPLE_ROWS
    rows = query_terms(queries, analyse).select("query_id", "term").limit(PUSHED_TERMS + 1).collect()
    if not rows or len(rows) > PUSHED_TERMS:
        return []
    counted = index.blocks(sorted({r["term"] for r in rows})).groupBy("term", "titled", "level").agg(F.sum("n").alias("n")).collect()  # some levels a term
    levels: dict[str, dict[bool, dict[int, int]]] = {}
    for r in counted:
        levels.setdefault(r["term"], {True: {}, False: {}})[r["titled"]][r["level"]] = r["n"]
    terms: dict[object, list[str]] = {}
    for r in rows:
        terms.setdefault(r["query_id"], []).append(r["term"])
    size = {t: sum(sum(x.values()) for x in kinds.values()) for t, kinds in levels.items()}
    heavy = [q for q, ts in terms.items() if all(t in size for t in ts) and sum(size[t] for t in ts) >= heavy_rows]
    if not heavy:
        return []

    def best(kinds: dict[bool, dict[int, int]]) -> int:
        """The level from which a term has `sample_rows` postings of segments."""
        total = 0
        for level, n in sorted(kinds[False].items(), reverse=True):
            total += n
            if total >= sample_rows:
                return level
        return 0

    first = [(q, t, best(levels[t])) for q in heavy for t in terms[q]]
    found = top(lexical_scores(index, queries.filter(F.col("query_id").isin(heavy)), title_weight, body_weight, analyse, first), "lexical_score", k)
    least = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("lexical_score").alias("score")).filter(F.col("n") >= k)
    cuts: Cuts = []
    for r in least.collect():
        q = r["query_id"]
        most = {t: max((level for x in levels[t].values() for level in x), default=0) for t in terms[q]}
        bar = LEVELS * (r["score"] - 10.0**-DECIMALS)
        cuts += [(q, t, max(0, math.ceil(bar - (sum(most.values()) - most[t])))) for t in terms[q]]
    return cuts
