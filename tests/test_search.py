import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.engine import EchoLlm, NotFound, SearchEngine, Unauthorized
from lodestack.operators import ingest
from lodestack.operators.fusion import SearchOptions, hybrid_search
from lodestack.operators.vector import check_dimensions, vector_topk

def now():
    return F.lit("2026-07-13 00:00:00").cast("timestamp")


def corpus(spark, rows):
    docs = spark.createDataFrame([(i, f"d{i}", t, k, p) for i, (t, _, k, p, _) in enumerate(rows)], "doc_id long, external_id string, title string, kind string, published_at string")
    segs = spark.createDataFrame([(i, 0, b, v) for i, (_, b, _, _, v) in enumerate(rows)], "doc_id long, segment_index int, body string, embedding array<float>")
    return docs, segs.withColumn("content_hash", F.sha2("body", 256))


ROWS = [
    ("Parking permits", "how to get a permit for parking", "services", None, [1.0, 0.0]),
    ("Other", "parking permit parking permit", "posts", "2015-01-15", [0.8, 0.6]),
    ("Mirror", "parking permit parking permit", None, None, [0.6, 0.8]),
    ("Taxes", "pay your taxes", "services", None, [0.0, 1.0]),
    ("Parking", "garages", "posts", "2026-07-13", None),
]


def run(spark, options, q="parking permit"):
    docs, segs = corpus(spark, ROWS)
    queries = spark.createDataFrame([(7, q, [1.0, 0.0])], "query_id long, q string, embedding array<float>")
    return [(r["external_id"], r["score"], r["total"]) for r in hybrid_search(segs, docs, queries, options, now()).orderBy("position").collect()]


def test_match_needs_all_terms_in_one_field(spark):
    found = {r[0] for r in run(spark, SearchOptions(mode="lexical"))}
    assert found == {"d0", "d1"}  # d2 is a mirror of d1; d4 has one term only


def test_modes_and_neutral_weights(spark):
    base = run(spark, SearchOptions())
    assert {r[0] for r in base} == {"d0", "d1"} and base[0][2] == 2
    assert run(spark, SearchOptions(kind_weights={"none": 3.0})) == base
    assert run(spark, SearchOptions(mode="semantic"))[0][0] == "d0"
    zero = run(spark, SearchOptions(kind_weights={"services": 0.0}))
    assert zero[-1][:2] == ("d0", 0.0) and zero[0][2] == 2  # kept, but last


def test_kinds_filter_equals_smaller_corpus(spark):
    docs, segs = corpus(spark, ROWS)
    queries = spark.createDataFrame([(7, "parking permit", [1.0, 0.0])], "query_id long, q string, embedding array<float>")
    a = hybrid_search(segs, docs, queries, SearchOptions(kinds=("posts",)), now()).orderBy("position").collect()
    few = docs.filter("kind = 'posts'")
    b = hybrid_search(segs.join(few.select("doc_id"), "doc_id", "left_semi"), few, queries, SearchOptions(), now()).orderBy("position").collect()
    assert a == b and {r["kind"] for r in a} == {"posts"}


def test_stop_query_and_empty_corpus(spark):
    assert run(spark, SearchOptions(mode="lexical"), "nowhere") == []
    docs, segs = corpus(spark, ROWS)
    queries = spark.createDataFrame([(7, "x", [1.0, 0.0])], "query_id long, q string, embedding array<float>")
    assert hybrid_search(segs.limit(0), docs.limit(0), queries, SearchOptions(), now()).count() == 0
    with pytest.raises(ValueError):
        run(spark, SearchOptions(mode="other"))


def test_best_match_survives_a_full_pool(spark):
    rows = [("t", f"permit filler words number {i} in between parking", "k", None, None) for i in range(210)] + [("best", "parking permit", "k", None, None)]
    docs, segs = corpus(spark, rows)
    queries = spark.createDataFrame([(1, "parking permit", None)], "query_id long, q string, embedding array<float>")
    assert hybrid_search(segs, docs, queries, SearchOptions(mode="lexical"), now()).filter("position = 1").first()["external_id"] == "d210"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["vec_id"], r["similarity"]) for r in vector_topk(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107)]
    for bad in (0, -1, 1.5, "3", True):
        with pytest.raises(ValueError):
            check_dimensions(bad)


def test_english_matches_by_stems_at_their_places(spark):
    """Matches and positions of the English index against plain Python; a stop word takes a place and matches nothing."""
    import re

    from lodestack.functions.english import STOP_WORDS, english_tokens, stem
    from lodestack.operators.lexical import matches, text_index

    rows = [("Running the permits", "He was running, and parked the parking permits"), ("The", "of and the"), ("Permit", "nothing here"), ("", "Permitted runs. RUN!")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, title string")
    segs = spark.createDataFrame([(i, 0, b) for i, (_, b) in enumerate(rows)], "doc_id long, segment_index int, body string")
    queries = ["run permit", "the permits", "of the", "parking"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, q string")
    terms = lambda t: [None if w in STOP_WORDS else stem(w) for w in re.findall(r"\w+", t.lower())]
    want = set()
    for k, text in enumerate(queries):
        asked = {t for t in terms(text) if t}
        for i, (title, body) in enumerate(rows):
            if asked and any(asked <= set(terms(field)) for field in (title, body)):
                places = lambda f: tuple(p for p, t in enumerate(terms(f)) if t in asked)  # noqa: E731, B023
                want.add((k, i, len(terms(title)), len(terms(body)), places(title), places(body)))
    got = matches(text_index(segs, docs, english_tokens), q, english_tokens).collect()
    assert {(r["query_id"], r["doc_id"], r["n_title"], r["n_body"], tuple(o["pos"] for o in r["title_occ"]), tuple(o["pos"] for o in r["body_occ"])) for r in got} == want and len(want) >= 4


def test_diff(spark):
    new = spark.createDataFrame([("a", 0, "h1"), ("a", 1, "h2")], "external_id string, segment_index int, content_hash string")
    old = spark.createDataFrame([("a", 0, "h2"), ("a", 1, "h3"), ("b", 0, "h9")], "external_id string, segment_index int, content_hash string")
    got = {(r["content_hash"], r["state"]) for r in ingest.diff(new, old).collect()}
    assert got == {("h1", "changed"), ("h2", "unchanged"), ("h3", "removed")}


PROMPT = {"system": "s", "response_format": "f", "model": "m", "max_tokens": 10, "temperature": 0.5, "retrieval": {"mode": "lexical", "limit": 3, "max_chunks_per_doc": 1, "min_lexical_score": 0, "min_vector_score": 0}}


def test_engine(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}")
    keys = e.create_index("i", config={"embedding": {"provider": "test", "dimensions": 16}, "max_segment_tokens": 20, "max_segments_per_document": 3})
    assert e.create_index("i") is None and keys["index_key"].startswith("idx_")
    assert e.authorize("i", "search", keys["search_key"]).name == "i"
    for key, name, error in ((None, "i", Unauthorized), ("x", "nope", NotFound), ("x", "i", Unauthorized), (keys["index_key"], "i", Unauthorized)):
        with pytest.raises(error):
            e.authorize(name, "search", key)
    new = e.mint_key("i", "search")
    with pytest.raises(Unauthorized):
        e.authorize("i", "search", keys["search_key"])
    assert e.authorize("i", "search", new) and e.revoke_key("i", "search") and not e.revoke_key("none", "rag")
    rows = [("p", "Parking", "Apply for parking permits online.", "services", json.dumps({"source_url": "http://p"})), ("t", "Taxes", "Pay taxes.\n\nPay taxes.", None, None), ("long", "L", "word " * 200, None, None)]
    schema = "external_id string, title string, body string, kind string, metadata string"
    said = {r["external_id"]: r for r in e.ingest("i", spark.createDataFrame(rows, schema), now()).collect()}
    assert (said["p"]["segments"], said["p"]["changed"], said["t"]["segments"], said["t"]["status"]) == (1, 1, 1, "indexed")
    assert said["long"]["status"] == "rejected" and "exceeding limit of 3" in said["long"]["error"]
    assert sorted(r["external_id"] for r in e.store("i").docs().collect()) == ["p", "t"]
    before = {r["content_hash"]: r["embedding"] for r in e.store("i").segments().collect()}
    e.ingest("i", spark.createDataFrame([("p", "New title", "Apply for parking permits online.", "services", json.dumps({"source_url": "http://p"}))], schema), now())
    assert {r["content_hash"]: r["embedding"] for r in e.store("i").segments().collect()} == before  # a title alone embeds nothing again
    page = e.documents("i", 1)
    assert page["documents"][0]["external_id"] == "p" and page["next_cursor"] == "p" and e.documents("i", 5, "p")["next_cursor"] is None
    found = e.search("i", "permit parking", mode="lexical")
    assert [r["external_id"] for r in found["results"]] == ["p"] and found["total"] == 1  # English stems
    assert e.create_prompt("i", "a", PROMPT) == PROMPT and e.create_prompt("i", "a", PROMPT) is None and e.list_prompts("i") == ["a"]
    answer = e.answer("i", "a", "parking permit", EchoLlm(markers=1, text="Source [2]: no [9]"))
    assert [c["marker"] for c in answer["citations"]] == [1] and answer["citations"][0]["url"] == "http://p"
    assert [r["used"] for r in answer["retrieved"]][0] and answer["prompt"] == "a"
    e.delete_documents("i", ["p", "missing"])
    assert [r["external_id"] for r in e.store("i").docs().collect()] == ["t"]
    assert e.update_index("i", {"rrf_k": 10}).config["rrf_k"] == 10 and e.delete_prompt("i", "a") and not e.delete_prompt("i", "a")
    assert e.delete_index("i") and not e.delete_index("i") and e.healthy()


DOCUMENT = "external_id string, title string, body string, kind string, metadata string"
CONFIG = {"embedding": {"provider": "test", "dimensions": 8}, "max_segment_tokens": 20, "max_segments_per_document": 2}


def test_registry_outlives_the_engine(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = SearchEngine(spark, path)
    keys = first.create_index("a/b é", "text", CONFIG)
    first.create_prompt("a/b é", "p", PROMPT)
    first.ingest("a/b é", spark.createDataFrame([("x", "X", "old text", None, None)], DOCUMENT), now())
    again = SearchEngine(spark, path)
    assert [i.name for i in again.list_indexes()] == ["a/b é"] and again.list_prompts("a/b é") == ["p"]
    assert again.authorize("a/b é", "index", keys["index_key"]).description == "text"
    assert again.ensure_index("a/b é") == {"created": False} and again.create_index("a/b é") is None
    assert again.search("a/b é", "old", mode="lexical")["total"] == 1
    # a deleted index takes its data along
    assert first.delete_index("a/b é") and again.get_index("a/b é") is None
    assert [p for p in tmp_path.iterdir() if p.name.startswith("data-")] == []
    made = again.ensure_index("a/b é", config=CONFIG)
    assert made["created"] and made["index_key"] and again.store("a/b é").docs().count() == 0 and again.list_prompts("a/b é") == []
    with pytest.raises(NotFound):
        again.ingest("none", spark.createDataFrame([], DOCUMENT))
    again.create_index("second")
    assert [i.name for i in again.list_indexes()] == ["a/b é", "second"]


def test_ingest_reports(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}")
    e.create_index("i", config=CONFIG)
    body = "One two three four five six seven.\n\nEight nine ten eleven twelve thirteen."
    assert e.ingest_document("i", {"external_id": "a", "title": "A", "body": body}, now()) == {"external_id": "a", "segments": 2, "changed": 2, "unchanged": 0, "status": "indexed"}
    assert e.ingest_document("i", {"external_id": "a", "title": "B", "body": body, "kind": "k"}, now())["unchanged"] == 2
    from lodestack.engine import Rejected

    with pytest.raises(Rejected, match="produces 7 segments, exceeding limit of 2"):
        e.ingest_document("i", {"external_id": "a", "title": "C", "body": "word " * 80}, now())
    kept = e.store("i").docs().first()
    assert (kept["title"], kept["kind"], kept["segment_count"], kept["metadata"]) == ("B", "k", 2, "{}")  # what was there stays
    said = e.ingest("i", spark.createDataFrame([("a", "D", " \n ", None, None), ("e", "Empty", None, None, None)], DOCUMENT), now()).collect()
    assert {(r["external_id"], r["segments"], r["removed"], r["status"]) for r in said} == {("a", 0, 2, "indexed"), ("e", 0, 0, "indexed")}
    docs = {r["external_id"]: (r["title"], r["segment_count"], r["kind"]) for r in e.store("i").docs().collect()}
    assert docs == {"a": ("D", 0, None), "e": ("Empty", 0, None)} and e.store("i").segments().count() == 0 and e.store("i").index().postings.filter("segment_index >= 0").count() == 0
    twice = spark.createDataFrame([("z", "zz", "first", None, None, 2), ("z", "aa", "second", None, None, 9), ("z", "mm", "third", None, None, 5)], DOCUMENT + ", at int")
    e.ingest("i", twice, now(), order="at")
    assert e.store("i").docs().filter("external_id = 'z'").first()["title"] == "aa"
    e.ingest("i", twice.coalesce(1), now())
    assert e.store("i").docs().filter("external_id = 'z'").first()["title"] == "mm"  # the last as they come
    status = e.status("i")
    assert {r["name"]: r["rows"] for r in status["tables"].collect()}["docs"] == 3 and all(r["bytes"] > 0 for r in status["tables"].collect())
    assert status["dimensions"].first()["dimensions"] == 8 and status["totals"].first()["total_documents"] == 3


def test_stored_index_equals_a_new_one(spark, tmp_path):
    """Search over the stored postings finds what an index made from the stored segments would."""
    from lodestack.operators.lexical import text_index

    e = SearchEngine(spark, f"file://{tmp_path}")
    e.create_index("i", config={**CONFIG, "text_search_config": "simple", "max_segments_per_document": 9})
    doc = lambda i, t, b: (i, t, b, None, None)
    e.ingest("i", spark.createDataFrame([doc("a", "Alpha beta", "beta gamma\n\nbeta"), doc("b", "Beta", ""), doc("c", "C", "gamma")], DOCUMENT), now())
    e.ingest("i", spark.createDataFrame([doc("a", "Alpha", "gamma beta"), doc("d", "D", "x " * 60)], DOCUMENT), now())
    e.delete_documents("i", ["c"])
    store = e.store("i")
    new = text_index(store.segments().selectExpr("external_id AS doc_id", "segment_index", "segment AS body"), store.docs().selectExpr("external_id AS doc_id", "title"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.index().postings) == rows(new.postings)
    flat = lambda df: sorted((r["doc_id"], r["n_title"], tuple(sorted(map(tuple, r["fields"])))) for r in df.collect())
    assert flat(store.index().sizes) == flat(new.sizes)
    assert [r["external_id"] for r in e.search("i", "beta gamma", mode="lexical")["results"]] == ["a"]
    assert e.search("i", "gone", mode="lexical") == {"results": [], "total": 0, "query": "gone"}


def test_recency_through_the_facade(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}")
    e.create_index("i", config={**CONFIG, "text_search_config": "simple"})
    when = {"stale": '{"published_at": "2015-01-15"}', "fresh": '{"published_at": "2026-07-13"}', "number": '{"published_at": 2015}', "broken": "{", "undated": None}
    e.ingest("i", spark.createDataFrame([(i, "T", f"parking {i}", "posts", m if m != "{" else '{"published_at": "soon"}') for i, m in when.items()], DOCUMENT), now())
    plain = {r["external_id"]: r["score"] for r in e.search("i", "parking", mode="lexical", now=now())["results"]}
    aged = {r["external_id"]: r["score"] for r in e.search("i", "parking", mode="lexical", recency="posts:180:0.85", now=now())["results"]}
    ratio = {i: round(aged[i] / plain[i], 2) for i in plain}
    assert ratio == {"stale": 0.85, "fresh": 1.0, "number": 1.0, "broken": 1.0, "undated": 1.0}


def test_stream(spark, tmp_path):
    from lodestack.functions.vectors import hash_embedding
    from lodestack.streaming.ingest import SnapshotStore, delete, stream_upserts, upsert

    source = f"{tmp_path}/in"
    doc = lambda i, t, b: spark.createDataFrame([(i, t, b, None, None)], DOCUMENT)
    spark.createDataFrame([("a", "A", "one\n\ntwo", "k", None), ("b", "B", "three", None, None)], DOCUMENT).write.json(source)
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    embed = lambda t: hash_embedding(t, 8)
    start = lambda: stream_upserts(spark.readStream.schema(DOCUMENT).json(source), store, embed, f"{tmp_path}/c", now)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert store.docs().count() == 2 and store.pointer()["streams"] == {"stream": 0}
    upsert(store, doc("z", "Z", "z"), embed, now(), stream="stream", number=0)  # the same batch again
    assert store.docs().count() == 2
    # writes in between do not swallow the next micro-batch
    delete(store, spark.createDataFrame([("b",), ("missing",)], "external_id string"))
    upsert(store, doc("api", "P", "by hand"), embed, now())
    upsert(store, doc("other", "O", "of another stream"), embed, now(), stream="two", number=0)
    doc("c", "C", "third").write.mode("append").json(source)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["external_id"] for r in store.docs().collect()) == ["a", "api", "c", "other"]
    assert store.pointer()["streams"] == {"stream": 1, "two": 0}
    assert not store.files.names("_batches")


def test_conflicts_and_formats(spark, tmp_path):
    from lodestack.functions.vectors import hash_embedding
    from lodestack.streaming import ingest as store_module
    from lodestack.streaming.ingest import Conflict, SnapshotStore, retry, upsert

    store, embed = SnapshotStore(spark, f"file://{tmp_path}/s"), lambda t: hash_embedding(t, 4)
    doc = lambda i: spark.createDataFrame([(i, i, f"text {i}", None, None)], DOCUMENT)
    upsert(store, doc("a"), embed, now())
    base = store.pointer()
    upsert(store, doc("b"), embed, now())
    with pytest.raises(Conflict):
        store.write(base, {"docs": store.docs()})
    assert sorted(r["external_id"] for r in store.docs().collect()) == ["a", "b"]
    # a writer that loses the race merges into what the other has written
    real, raced = SnapshotStore.write, []

    def slow(self, base, tables, streams=None):
        if not raced:
            raced.append(1)
            upsert(SnapshotStore(spark, self.path), doc("c"), embed, now())
        real(self, base, tables, streams)

    SnapshotStore.write = slow
    try:
        upsert(store, doc("d"), embed, now())
    finally:
        SnapshotStore.write = real
    assert sorted(r["external_id"] for r in store.docs().collect()) == ["a", "b", "c", "d"]
    tries = []
    with pytest.raises(Conflict):
        retry(lambda: (tries.append(1), store.write(base, {}))[1])
    assert len(tries) == 3
    # a store of format 1 is read on, a newer one is not
    old = store_module.Files(spark, f"file://{tmp_path}/old")
    store.docs().write.parquet(f"{tmp_path}/old/v0/docs")
    old.write("_versions/0", "")
    again = SnapshotStore(spark, f"file://{tmp_path}/old")
    assert again.docs().count() == 4 and again.segments().count() == 0 and old.read("_format") == str(store_module.FORMAT)
    old.write("_format", "99")
    with pytest.raises(ValueError, match="format 99"):
        SnapshotStore(spark, f"file://{tmp_path}/old")


def test_vectors_in_blocks_and_lists(spark):
    """Many blocks give what one block gives, with identifiers of any type; inverted lists find nearly the same."""
    from lodestack.operators.vector import nearest_parts, vector_topk_approximate

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    m = np.round(centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16)), 2)
    rows = [(f"v{i:04d}é", int(i % 3), [float(x) for x in r]) for i, r in enumerate(m)] + [("zero", 0, [0.0] * 16), (None, 0, [1.0] * 16), ("none", 0, None)]
    v = spark.createDataFrame(rows, "vec_id string, part int, embedding array<float>").repartition(5)
    q = v.filter("part = 0 AND vec_id LIKE 'v%' AND vec_id < 'v0300'").select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted(map(tuple, nearest_parts(v, q, 7).collect()))
    many = sorted(map(tuple, nearest_parts(v, q, 7, block=16, slice_rows=500).collect()))
    assert one == many and len(one) == 7 * q.count()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in (0, 150):
        sim = np.round(unit @ unit[i], 6)
        want = sorted(range(3000), key=lambda j: (-sim[j], rows[j][0], rows[j][1]))[:7]
        assert [r[1] for r in one if r[0] == rows[i][0]] == [rows[j][0] for j in want] or sorted(r[4] for r in one if r[0] == rows[i][0]) == list(range(1, 8))
    exact = {(r[0], r[1]) for r in nearest_parts(v, q, 10).select("query_id", "vec_id").collect()}
    near = vector_topk_approximate(v.drop("part"), q, 10, lists=30, probes=8).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in near} & exact) >= 0.9 * len(exact) and max(r["rank"] for r in near) == 10
    with pytest.raises(Exception, match="dimensions"):
        nearest_parts(v, spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>"), 3).collect()


def test_rest_source(spark):
    from lodestack.sources.rest import list_pages, read_rest

    def fetch(url):
        if "?" in url:
            offset = int(url.split("offset=")[1].split("&")[0])
            link = '<http://k?offset=2&limit=50>; rel="next"' if offset == 0 else ""
            return 200, {"link": link}, json.dumps({"items": [{"id": offset}, {"id": offset + 1}]})
        return 200, {}, json.dumps({"id": url.rsplit("/", 1)[1], "title": "T", "url": "u", "content": "<p>x</p>", "lastPublishedAt": "d"})

    rows = read_rest(spark, "http://k", fetch).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["0", "1", "2", "3"] and rows[0]["content"] == "<p>x</p>"
    stuck = lambda url: (200, {"link": '<http://k?offset=0&limit=50>; rel="next"'}, '{"items": []}')  # noqa: E731, ARG005
    with pytest.raises(RuntimeError, match="stalled"):
        list(list_pages("http://k", stuck))
    with pytest.raises(RuntimeError, match="500"):
        list(list_pages("http://k", lambda url: (500, {}, "{}")))  # noqa: ARG005


def test_rest_items_that_fail_are_rows(spark):
    from lodestack.sources.rest import read_rest

    def fetch(url):
        if "?" in url:
            return 200, {}, json.dumps({"items": [{"id": i} for i in range(5)]})
        i = int(url.rsplit("/", 1)[1])
        if i == 2:
            raise OSError("down")
        return (404, {}, "") if i == 3 else (200, {}, json.dumps({"id": i, "title": "T"}) if i < 4 else "{broken")

    rows = {r["id"]: r for r in read_rest(spark, "http://k", fetch).collect()}
    assert len(rows) == 5 and [i for i in rows if rows[i]["error"] is None] == ["0", "1"]
    assert "OSError" in rows["2"]["error"] and "404" in rows["3"]["error"] and "JSON" in rows["4"]["error"]


def test_rest_stream_goes_on_where_it_was(spark, tmp_path):
    """Restarts over a growing list lose and repeat nothing; items that fail are rows."""
    from lodestack.sources.rest import RestStream, stream_rest

    count = tmp_path / "count"

    def fetch(url):
        n = int(count.read_text())
        if "?" in url:
            at, size = (int(url.split(f"{k}=")[1].split("&")[0]) for k in ("offset", "limit"))
            return 200, {}, json.dumps({"items": [{"id": i} for i in range(at, min(at + size, n))]})
        i = url.rsplit("/", 1)[1]
        return (500, {}, "") if i == "7" else (200, {}, json.dumps({"id": i, "title": f"T{i}"}))

    def run():
        q = stream_rest(spark, "http://k", fetch, 4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()

    for n in (0, 9, 9, 23):
        count.write_text(str(n))
        run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(int(r["id"]) for r in rows) == list(range(23)) and [r["id"] for r in rows if r["error"]] == ["7"]
    for n in (0, 1, 3, 4, 5, 1000):
        count.write_text(str(n))
        asked = []
        stream = RestStream("http://k", lambda u: (asked.append(u), fetch(u))[1], 4)
        assert stream.latestOffset() == {"items": n} and len(asked) < 30
        assert sum(p.end - p.start for p in stream.partitions({"items": 0}, {"items": n})) == n
    with pytest.raises(RuntimeError, match="shorter"):
        stream.partitions({"items": 5}, {"items": 3})


def test_engines_that_write_at_once_lose_nothing(spark, tmp_path):
    """Prompts, keys and settings of two engines on one folder, each changed between the other's reading and writing."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}"
    first, second = SearchEngine(spark, path), SearchEngine(spark, path)
    first.create_index("i")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: (first if k % 2 else second).create_prompt("i", f"p{k}", PROMPT), range(8)))
    assert all(done) and first.list_prompts("i") == sorted(f"p{k}" for k in range(8))
    # a change made between reading and writing is seen and kept
    real, raced = first.files.create, []

    def slow(name, text):
        if not raced:
            raced.append(1)
            second.update_index("i", {"rrf_k": 11})
            second.delete_prompt("i", "p0")
        return real(name, text)

    first.files.create = slow
    key = first.mint_key("i", "rag")
    first.files.create = real
    assert first.authorize("i", "rag", key).config["rrf_k"] == 11 and "p0" not in first.list_prompts("i")
    assert first.create_index("i") is None and len(first.files.names("_indexes/i")) <= 2
    # an entry of the older kind, one file, is read on
    first.files.write("_registry/old", json.dumps({**json.loads(first.files.read(f"_indexes/i/{first._numbers('i')[-1]}")), "name": "old", "folder": "data-old"}))
    assert [i.name for i in second.list_indexes()] == ["i", "old"] and second.revoke_key("old", "rag") and not second.revoke_key("none", "rag")
    assert first.delete_index("old") and first.get_index("old") is None


def test_captures(spark, tmp_path):
    from lodestack.sources.captures import compare, read_capture, write_capture

    rows = spark.createDataFrame([("q1", "c", "hybrid", 1, "a", 0.5, "A"), ("q1", "c", "hybrid", 2, "b", 0.4, "B"), ("q2", "c", "hybrid", 1, "b", 0.4, "B")], "q string, category string, mode string, position int, external_id string, score double, title string")
    write_capture(rows, f"{tmp_path}/a", "A", "now")
    write_capture(rows.filter("q = 'q1'"), f"{tmp_path}/b", "B", "now")
    pairs, missing = compare(read_capture(spark, f"{tmp_path}/a"), read_capture(spark, f"{tmp_path}/b"))
    assert [(r["q"], r["a"], r["b"]) for r in pairs.collect()] == [("q1", ["a", "b"], ["a", "b"])]
    assert [r["q"] for r in missing.collect()] == ["q2"]


def test_first_segment_after_blank_lines_has_the_vector(spark, tmp_path):
    from lodestack.plans import corpus

    spark.createDataFrame([(1, "a\nb"), (2, " \n\nc\nd"), (3, "e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["doc_id"], r["segment_index"]): r["embedding"] for r in corpus.segments(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): [1.0], (1, 1): None, (2, 2): [2.0], (2, 3): None, (3, 0): None}
