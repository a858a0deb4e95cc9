"""The layered store: what a batch writes, what readers see, compaction, retention, look-ups by file ranges, and the vector index."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.engine import SearchEngine
from lodestack.functions.vectors import hash_embedding
from lodestack.operators import vector_index
from lodestack.operators.vector import nearest_parts
from lodestack.streaming.ingest import DOCS, FORMAT, SnapshotStore, delete, upsert

DOCUMENT = "external_id string, title string, body string, kind string, metadata string"


def now():
    return F.lit(datetime.datetime(2026, 7, 13))


def embed(text):
    return hash_embedding(text, 8)


def batch(spark, rows):
    return spark.createDataFrame([(i, t, b, "k", None) for i, t, b in rows], DOCUMENT)


def many(spark, n):
    return spark.range(n).select(
        F.format_string("d%05d", "id").alias("external_id"), F.format_string("Title %d", "id").alias("title"),
        F.format_string("word%d common\n\nmore of %d", F.col("id") % 50, F.col("id")).alias("body"), F.lit("k").alias("kind"), F.lit(None).cast("string").alias("metadata"),
    )


def content(store):
    """All that a reader sees, without times."""
    docs = sorted(map(str, store.docs().drop("created_at", "updated_at").collect()))
    segments = sorted(map(str, store.segments().collect()))
    index = store.index()
    sizes = sorted((r["doc_id"], r["n_title"], tuple(sorted(map(tuple, r["fields"])))) for r in index.sizes.collect())
    return docs, segments, sorted(map(str, index.postings.collect())), sizes


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", file_rows=300)
    upsert(store, many(spark, 2000), embed, now(), max_tokens=20)
    base, before = store.files.size(), store.pointer()
    assert base > 100_000 and store.pointer()["counters"] == {"docs": 2000, "segments": store.segments().count()}
    upsert(store, batch(spark, [("d00007", "New", "other text")]), embed, now())
    assert store.files.size() - base < base / 5 and len(store.pointer()["layers"]) == 2
    assert store.pointer()["layers"][0] == before["layers"][0]  # the base is not written again
    one = store.docs().filter("external_id = 'd00007'").first()
    assert one["title"] == "New" and store.docs().count() == 2000 and one["created_at"] == datetime.datetime(2026, 7, 13)
    # a delete writes ids only, and hides the rows at once
    size = store.files.size()
    delete(store, spark.createDataFrame([("d00008",), ("missing",), ("d00007",)], "external_id string"))
    assert store.files.size() - size < 10_000 and store.docs().filter("external_id IN ('d00007', 'd00008')").isEmpty()
    assert store.segments().filter("external_id = 'd00008'").isEmpty() and store.index().postings.filter("doc_id = 'd00008'").isEmpty()
    assert store.pointer()["counters"] == {"docs": store.docs().count(), "segments": store.segments().count()}
    version = store.version()
    delete(store, spark.createDataFrame([("missing",)], "external_id string"))
    assert store.version() == version
    # readers keep what they opened
    assert store.read("docs", before).count() == 2000


def test_layers_equal_a_rewrite(spark, tmp_path):
    """Random upserts and deletes, written together or not: always what a store that was written at once has."""
    rnd = random.Random(1)
    store, kept = SnapshotStore(spark, f"file://{tmp_path}/s", max_layers=3), {}
    for step in range(7):
        if step and rnd.random() < 0.4:
            gone = rnd.sample(sorted(kept), min(3, len(kept)))
            delete(store, spark.createDataFrame([(g,) for g in gone], "external_id string"))
            kept = {i: d for i, d in kept.items() if i not in gone}
        else:
            new = {f"d{rnd.randrange(12)}": (f"T{step}", " \n\n".join(rnd.choices(["alpha beta", "gamma", "delta alpha"], k=rnd.randint(0, 3)))) for _ in range(5)}
            upsert(store, batch(spark, [(i, *d) for i, d in new.items()]), embed, now(), max_tokens=5)
            kept |= new
        assert len(store.pointer()["layers"]) <= 4
    whole = SnapshotStore(spark, f"file://{tmp_path}/whole")
    upsert(whole, batch(spark, [(i, *d) for i, d in kept.items()]), embed, now(), max_tokens=5)
    assert content(store) == content(whole)
    counters = store.pointer()["counters"]
    for which in ("upper", "all"):
        store.compact(which)
        assert content(store) == content(whole) and store.pointer()["counters"] == counters == whole.pointer()["counters"]
    assert len(store.pointer()["layers"]) == 1 and "gone" not in store.pointer()["layers"][0]["tables"]


def test_layers_of_deletes_only(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", max_layers=2)
    upsert(store, many(spark, 40), embed, now(), max_tokens=20)
    for i in range(5):
        delete(store, spark.createDataFrame([(f"d{i:05d}",)], "external_id string"))
    assert len(store.pointer()["layers"]) <= 3 and store.pointer()["counters"]["docs"] == 35 == store.docs().count()
    assert sorted(r["external_id"] for r in store.docs().collect()) == [f"d{i:05d}" for i in range(5, 40)]
    assert {r["doc_id"] for r in store.index().find(["common"]).collect()} == {f"d{i:05d}" for i in range(5, 40)}


def test_old_versions_go(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", keep_versions=2, keep_seconds=0, max_layers=50)
    for i in range(4):
        upsert(store, batch(spark, [("a", f"T{i}", f"text {i}")]), embed, now())
    assert len(store.versions()) == 2
    listed = lambda: {x["folder"] for v in store.versions() for x in store.pointer(v)["layers"]}
    store.compact("all")
    store.vacuum(keep=1)
    assert store.versions() == [store.version()] and {n for n in store.files.names("") if n.startswith("layer-")} - {store.pointer()["report"]} == listed() and len(listed()) == 1
    assert store.docs().first()["title"] == "T3" and store.report().count() == 1
    store.keep_seconds = 600  # young versions stay
    for i in range(3):
        upsert(store, batch(spark, [("a", f"U{i}", f"text {i}")]), embed, now())
    assert len(store.versions()) == 4
    assert store.vacuum(older_than=600) == [] and len(store.versions()) == 4
    store.vacuum()
    assert len(store.versions()) == 2 and store.docs().first()["title"] == "U2"


def test_lookups_read_few_files(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", file_rows=100)
    upsert(store, many(spark, 2000), embed, now(), max_tokens=20)
    p = store.pointer()
    assert set(p["layers"][0]["ranged"]) == {"docs", "segments", "postings", "sizes"}
    every = len(store.docs(p).inputFiles())
    found = store.find("docs", ["d00003", "d01234", "none"], p)
    assert every >= 15 and len(found.inputFiles()) <= 3 and sorted(r["external_id"] for r in found.collect()) == ["d00003", "d01234"]
    assert len(store.find("segments", ["d00003"], p).inputFiles()) <= 2 and store.find("segments", ["d00003"], p).count() == store.segments().filter("external_id = 'd00003'").count()
    assert store.find("docs", ["zzz"], p).count() == 0
    # words: few files for a rare one, none for an unknown one
    words = store.index(p)
    assert len(words.find(["word7"]).inputFiles()) < len(words.postings.inputFiles()) / 5 and words.find(["word7"]).count() == 40
    assert words.find(["unknown"]).count() == 0
    # pages in order, across layers, without what is hidden
    upsert(store, batch(spark, [("d00001x", "X", "x"), ("d00500", "Y", "y")]), embed, now())
    delete(store, spark.createDataFrame([("d00002",), ("d00004",)], "external_id string"))
    after = store.after("docs", "d00001", 3)
    assert len(after.inputFiles()) <= 5  # two of the base, one of the layer, two lists of gone ids
    assert [r["external_id"] for r in after.orderBy("external_id").limit(3).collect()] == ["d00001x", "d00003", "d00005"]
    everything = sorted(r["external_id"] for r in store.docs().collect())
    seen, cursor = [], None
    while len(rows := store.after("docs", cursor, 700).orderBy("external_id").limit(700).collect()):
        seen += [r["external_id"] for r in rows]
        cursor = seen[-1]
    assert seen == everything
    assert store.find_all("docs", spark.range(0).select(F.lit("x").alias("external_id"))).count() == 0


def test_search_reads_few_files_and_the_index(spark, tmp_path):
    """A search over a stored index of vectors gives what the exact one gives nearly always, and looks its rows up."""
    e = SearchEngine(spark, f"file://{tmp_path}")
    e.create_index("i", config={"embedding": {"provider": "test", "dimensions": 8}, "text_search_config": "simple", "max_segment_tokens": 20})
    docs = many(spark, 3000)
    e.ingest("i", docs, now())
    store = e.store("i")
    store.file_rows, store.index_from = 300, 1000
    queries = spark.createDataFrame([(i, f"word{i} common") for i in range(12)], "query_id long, q string")
    exact = {(r["query_id"], r["external_id"]) for r in e.search_batch("i", queries, now(), mode="semantic").collect()}
    store.compact("all")
    p = store.pointer()
    assert p["index"] and "vectors" in p["layers"][0]["tables"]
    assert store.vectors(None, p).count() == store.segments(p).count()
    near = {(r["query_id"], r["external_id"]) for r in e.search_batch("i", queries, now(), mode="semantic").collect()}
    assert len(near & exact) >= 0.95 * len(exact) == 0.95 * 120
    # new vectors go to the lists that are there, replaced ones are hidden
    e.ingest("i", batch(spark, [("d00000", "Changed", "entirely new words"), ("new", "N", "word3 common")]), now())
    p = store.pointer()
    assert p["index"] and store.vectors(None, p).count() == store.segments(p).count() and "vectors" in p["layers"][1]["tables"]
    found = e.search("i", "entirely new words", mode="semantic", now=now())["results"]
    assert len(found) == 10 and e.search("i", "word3 common", now=now())["total"] > 0
    plain = e.search("i", "word3 common", mode="lexical", limit=5, now=now())["results"]
    assert {r["external_id"] for r in plain} <= {f"d{i:05d}" for i in range(3, 3000, 50)} | {"new"}


def test_vector_index_probes_and_partitions(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    m = centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 16))
    rows = [(int(i), 0, [float(x) for x in r]) for i, r in enumerate(m)] + [(7000, 0, [0.0] * 16), (7001, 0, None)]
    v = spark.createDataFrame(rows, "vec_id long, part int, embedding array<float>").repartition(4)
    lists = vector_index.fit(v, 6000)
    assert 1 <= lists.probes < len(lists.centres) / 3 and (vector_index.fit(v.repartition(7), 6000).centres == lists.centres).all()
    vector_index.assign(v, lists).write.partitionBy("list").parquet(f"{tmp_path}/v")
    table, opened = spark.read.parquet(f"{tmp_path}/v"), []

    def read(some):
        opened.append(some)
        return table if some is None else table.filter(F.col("list").isin(some))

    q = v.filter("vec_id % 50 = 0 AND vec_id < 7000").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r[0], r[1]) for r in nearest_parts(v, q, 10).select("query_id", "vec_id").collect()}
    for block in (4096, 16):
        near = vector_index.nearest_in_lists(read, lists, q, 10, block).collect()
        assert len({(r["query_id"], r["vec_id"]) for r in near} & exact) >= 0.95 * len(exact) and max(r["rank"] for r in near) == 10
    one = vector_index.nearest_in_lists(read, lists, q.limit(1), 10)
    assert len(opened[-1]) == lists.probes and one.count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "IN (" in plan.split("PartitionFilters")[1][:400].upper()
    # vectors without structure: the lists are searched widely instead of losing neighbours
    wild = spark.createDataFrame([(int(i), 0, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(2000, 32)))], "vec_id long, part int, embedding array<float>")
    wide = vector_index.fit(wild, 2000)
    assert wide.probes > len(wide.centres) / 2
    lists.write(spark, f"{tmp_path}/lists")
    again = vector_index.Lists.read(spark, f"{tmp_path}/lists")
    assert again.probes == lists.probes and np.allclose(again.centres, lists.centres)
    assert vector_index.fit(v.filter("vec_id >= 7000"), 2) is None


def test_documents_without_an_id_are_rejected(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        said = upsert(store, batch(spark, [(None, "A", "text"), (None, "B", "text"), ("x", "X", "text")]), embed, now()).collect()
        assert sorted((r["external_id"] or "", r["status"], r["error"]) for r in said)[:2] == [("", "rejected", "document has no external_id")] * 2 and len(said) == 3
    assert [r["external_id"] for r in store.docs().collect()] == ["x"]


def test_old_formats_keep_their_keyword_search(spark, tmp_path):
    """Stores of formats 1 and 2 find their documents by words after the migration, and after an upsert."""
    made = SnapshotStore(spark, f"file://{tmp_path}/made")
    upsert(made, batch(spark, [("a", "Alpha", "one two"), ("b", "Beta", "two three"), ("c", "C", "")]), embed, now())
    for number in (1, 2):
        path = tmp_path / f"f{number}"
        for name, df in (("docs", made.docs()), ("segments", made.segments())):
            df.write.parquet(f"{path}/v0/{name}")
        old = SnapshotStore(spark, f"file://{tmp_path}/none").files.__class__(spark, f"file://{path}")
        if number == 2:
            made.index().postings.write.parquet(f"{path}/v0/postings")
            made.index().sizes.write.parquet(f"{path}/v0/sizes")
            old.write("_format", "2")
        old.write("_versions/0", "" if number == 1 else json.dumps({"folder": "v0", "streams": {"s": 4}}))
        store = SnapshotStore(spark, f"file://{path}")
        assert content(store) == content(made) and old.read("_format") == str(FORMAT)
        assert store.pointer()["streams"] == ({} if number == 1 else {"s": 4}) and store.pointer()["counters"] == made.pointer()["counters"]
        upsert(store, batch(spark, [("d", "Delta", "two")]), embed, now())
        assert sorted({r["doc_id"] for r in store.index().find(["two"]).collect()}) == ["a", "b", "d"]
    # a table that a layer names and that is gone is an error, not an empty table
    store.files.delete("v0/docs")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.docs().count()
    assert DOCS.startswith("external_id")


def test_frequent_words_are_read_by_levels(spark, tmp_path):
    """The k best of queries with frequent words, by levels that can reach them, are the k best of all matches; fewer postings are read."""
    from lodestack.operators import lexical
    from lodestack.operators.lexical import TITLE, blocks_of, level_cuts, lexical_scores, text_index, top

    rnd = random.Random(9)
    docs, segments = [], []
    for i in range(1500):
        docs.append((i, " ".join(rnd.choices(["common", "often", "rare", "x", "y"], [4, 3, 0.1, 9, 9], k=rnd.randint(1, 6)))))
        for j in range(rnd.randint(1, 3)):
            segments.append((i, j, " ".join(rnd.choices(["common", "often", "rare", "x", "y", "z"], [3, 3, 0.05, 20, 20, 20], k=rnd.choice([3, 20, 200])))))
    d, s = spark.createDataFrame(docs, "doc_id long, title string"), spark.createDataFrame(segments, "doc_id long, segment_index int, body string")
    made = text_index(s, d)
    made.postings.sort("term", "level").write.option("parquet.page.row.count.limit", 100).option("parquet.block.size", 20_000).parquet(f"{tmp_path}/p")
    postings = spark.read.parquet(f"{tmp_path}/p")
    blocks = blocks_of(postings)
    index = lexical.TextIndex(postings, made.sizes, lambda w: postings.filter(F.col("term").isin(w)), lambda w: blocks.filter(F.col("term").isin(w)))
    texts = {0: "common", 1: "common often", 2: "rare", 3: "often rare common", 4: "none common", 5: "common common", 6: "z"}
    q = spark.createDataFrame(list(texts.items()), "query_id long, q string")
    # an upper bound of every rank, by the levels of its words
    levels = {(r["term"], r["doc_id"], r["segment_index"]): r["level"] for r in postings.collect()}
    scores = lexical_scores(index, q).collect()
    for r in scores:
        words = set(texts[r["query_id"]].split())
        bound = sum(levels.get((w, r["doc_id"], r["segment_index"])) or levels.get((w, r["doc_id"], TITLE), lexical.TITLED) - lexical.TITLED for w in words)
        assert r["lexical_score"] <= bound / lexical.LEVELS + 1e-6
    for k, weights in ((20, (3.0, 1.0)), (100, (1.0, 2.0))):
        cuts = level_cuts(index, q, *weights, lexical.simple_tokens, k, heavy_rows=100, sample_rows=400)
        assert {c[0] for c in cuts} >= {0, 5} and any(c[2] > 0 for c in cuts) and 4 not in {c[0] for c in cuts}
        want = sorted(map(tuple, top(lexical_scores(index, q, *weights), "lexical_score", k).collect()))
        assert sorted(map(tuple, top(lexical_scores(index, q, *weights, cuts=cuts), "lexical_score", k).collect())) == want
    one = q.filter("query_id = 0")
    cuts = level_cuts(index, one, 3.0, 1.0, lexical.simple_tokens, 20, heavy_rows=100, sample_rows=400)

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        out, todo = 0, [plan]
        while todo:
            node = todo.pop()
            if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
                todo.append(node.plan())
            if node.getClass().getSimpleName() == "FileSourceScanExec" and "segment_index" in str(node.output()):
                out += node.metrics().apply("numOutputRows").value()
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
        return out

    whole, part = scanned(lexical_scores(index, one)), scanned(lexical_scores(index, one, cuts=cuts))
    titled = postings.filter(f"term = 'common' AND segment_index = {TITLE}").count()  # words of titles are always read
    assert titled < part and part - titled < 0.6 * (whole - titled), (part, whole, titled)


def test_places_of_terms(spark):
    from lodestack.operators.lexical import places

    rows = [(["b", "a", None, "b", "é"],), ([],), ([None],), (["x"] * 50_000 + ["y"],)]
    got = [{x["term"]: x["at"] for x in r[0]} for r in spark.createDataFrame(rows, "t array<string>").select(places(F.col("t"))).collect()]
    assert got == [{"b": [0, 3], "a": [1], "é": [4]}, {}, {}, {"x": list(range(50_000)), "y": [50_000]}]
