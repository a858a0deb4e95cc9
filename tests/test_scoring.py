"""The text index in one pass, and matches scored document by document, against plain loops."""

import math

from lodestack.operators.lexical import LEVELS, TITLE, TITLED, analysed, index_of, lexical_scores, matches, query_terms, text_index

DOCS = [(i, ["red fox", "the red", "", "the the fox", "blue"][i % 5]) for i in range(60)]
SEGS = [(i, k, " ".join(("the", "red", "fox", "den", "a")[(i * 7 + k * 3 + j * (1 + k)) % 5] for j in range((i + k) % 9))) for i, _ in DOCS for k in range(0, i % 4 * 2, 2)]


def tables(spark):
    return spark.createDataFrame(SEGS, "doc_id long, segment_index int, body string"), spark.createDataFrame(DOCS, "doc_id long, title string")


def test_an_index_is_made_without_array_loops_or_a_shuffle_of_words(spark):
    segments, docs = tables(spark)
    fields = analysed(segments.join(docs, "doc_id"), docs)
    postings = index_of(fields).postings
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(" not in plan
    want, titles = set(), dict(DOCS)
    for i, k, body in [(i, TITLE, t) for i, t in DOCS] + SEGS:
        words, titled = body.split(), [] if k == TITLE else titles[i].split()
        for w in set(words):
            level = math.ceil(LEVELS * (words.count(w) + titled.count(w)) / math.log(len(words) + len(titled) + 1))
            want.add((w, i, k, level + (TITLED if k == TITLE else 0), tuple(p for p, x in enumerate(words) if x == w)))
    got = postings.collect()
    assert {(r["term"], r["doc_id"], r["segment_index"], r["level"], tuple(r["at"])) for r in got} == want and len(got) == len(want)


def scores(terms, title, body):
    """Plain cover density with weights 1 and 1/3."""
    occ = [(p, w, 1.0) for p, w in enumerate(title) if w in terms] + [(len(title) + p, w, 1 / 3) for p, w in enumerate(body) if w in terms]
    total, left = 0.0, -1
    for e in range(len(occ)):
        last = [max((j for j in range(e + 1) if occ[j][1] == t), default=-1) for t in terms]
        if min(last) > left:
            left = min(last)
            n = e - left + 1
            total += n / sum(1 / o[2] for o in occ[left : e + 1]) / (1 + occ[e][0] - occ[left][0] - (n - 1))
    return total / math.log(len(title) + len(body) + 1)


def test_a_posting_is_shuffled_once_however_many_queries_share_its_word(spark, monkeypatch):
    from lodestack.operators import covers

    monkeypatch.setattr(covers, "PAIRS", 50)  # several pieces in a batch
    segments, docs = tables(spark)
    asked = [(q, ("the", "red fox", "fox the red", "the red", "den", "blue", "the", "none", "red none")[q % 9]) for q in range(27)]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    index = text_index(segments, docs)
    scored = lexical_scores(index, queries)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(query_id" not in plan
    want, titles = {}, dict(DOCS)
    for q, text in asked:
        terms = list(dict.fromkeys(text.split()))
        for i, k, body in SEGS:
            title, words = titles[i].split(), body.split()
            if set(terms) <= set(title) or set(terms) <= set(words):
                want[q, i, k] = scores(terms, title, words)
    got = {(r["query_id"], r["doc_id"], r["segment_index"]): r["lexical_score"] for r in scored.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert got.keys() == {(r["query_id"], r["doc_id"], r["segment_index"]) for r in matches(index, queries).collect()}
    assert query_terms(queries).count() == sum(len(set(t.split())) for _, t in asked)


def test_a_document_goes_on_in_the_next_batch(spark):
    """Batches of three rows: no document is whole in one."""
    segments, docs = tables(spark)
    queries = spark.createDataFrame([(1, "the red"), (2, "fox")], "query_id long, q string")
    index = text_index(segments, docs)
    want = sorted(map(tuple, lexical_scores(index, queries).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        assert sorted(map(tuple, lexical_scores(text_index(segments, docs), queries).collect())) == want
    finally:
        spark.conf.set(size, before)


def test_the_cuts_of_many_words_are_looked_up(spark):
    import re

    from lodestack.operators.lexical import _above_cuts

    words = [f"w{i}" for i in range(40)]
    rows = [(w, i, 0, (i * 7 + n) % 30, [0]) for i in range(20) for n, w in enumerate(words)]
    postings = spark.createDataFrame(rows, "term string, doc_id long, segment_index int, level int, at array<int>")
    terms = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "query_id long, term string")
    cuts = [(n, w, n % 25) for n, w in enumerate(words)]
    got = _above_cuts(postings, terms, words, cuts)
    assert len(re.findall(r"level#\d+ >= \d", got._jdf.queryExecution().executedPlan().toString())) == 0
    assert {(r["term"], r["doc_id"]) for r in got.collect()} == {(r[0], r[1]) for r in rows if r[3] >= int(r[0][1:]) % 25}
