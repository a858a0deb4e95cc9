import datetime
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.config import DEFAULT_CONFIG, merge_config
from lodestack.functions import evalmetrics, html, scores, text, vectors
from lodestack.functions.english import stem
from lodestack.operators import rag, state
from lodestack.plans import params


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_token_estimate_and_chunks(spark):
    df = spark.createDataFrame([("", 5), ("abc", 5), ("abcd", 5), ("日本", 5)], "t string, n int")
    assert [r[0] for r in df.select(text.estimate_tokens(F.col("t"))).collect()] == [0, 1, 2, 2]
    words = "Para one is here.\n\nPara two. It has more words. " + "x" * 100 + " 😀日本語 end"
    got = one(spark, text.chunk_text(F.lit(words), 12))[0]
    assert all(math.ceil(len(c.encode()) / 3) <= 12 for c in got)
    assert "".join("".join(got).split()) == "".join(words.split())
    assert one(spark, text.chunk_text(F.lit(None).cast("string"), 5))[0] == []
    assert one(spark, text.chunk_text(F.lit(" \n  "), 5))[0] == []


def test_chunks_keep_all_characters(spark):
    texts = ["a b\n\nc", ". . . ", "ééé ßß\n" * 9, "word " * 50, " x﻿"]

    @settings(max_examples=20, deadline=None)
    @given(st.text(alphabet="ab. \né😀", max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = lambda s: "".join(c for c in s if not c.isspace() and c not in "﻿")
    for r in df.select("t", text.chunk_text(F.col("t"), 4).alias("c")).collect():
        assert strip("".join(r["c"])) == strip(r["t"])
        assert all(math.ceil(len(c.encode()) / 3) <= 4 for c in r["c"])


def plain_chunks(t, budget):
    """The chunking rule in plain Python: cut from coarse to fine, join greedily, trim, drop blank ones."""
    size = lambda x: math.ceil(len(x.encode()) / 3)

    def cut(piece, seps):
        if size(piece) <= budget or not seps:
            return [piece] if size(piece) <= budget else list(piece)
        parts = [p + seps[0] for p in piece.split(seps[0])]
        parts[-1] = parts[-1].removesuffix(seps[0])
        return [x for p in parts if p for x in cut(p, seps[1:])]

    out, now = [], ""
    for piece in cut(t, text.SEPARATORS):
        if now and size(now + piece) > budget:
            out.append(now)
            now = ""
        now += piece
    white = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    return [x for x in (y.strip(white) for y in [*out, now]) if x]


def test_chunks_and_segments_against_plain_python(spark):
    import hashlib

    from lodestack.operators.ingest import to_segments

    rnd = random.Random(3)
    words = ["alpha", "be. ta", "gamma\n\n", "\n", "日本語", "x" * 70, "y. ", "\u00a0"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(80)] + ["same line\n\n" * 30, "", "  ", "w" * 3000, None]
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, title string, body string")
    want = []
    for i, t in enumerate(texts):
        chunks, seen = plain_chunks(t or "", 20), set()
        for n, c in enumerate(chunks):
            if c not in seen:
                seen.add(c)
                want.append((i, n, hashlib.sha256(c.encode()).hexdigest(), len(chunks)))
    got = to_segments(docs, 20).select("doc_id", "segment_index", "content_hash", "n_chunks").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_run_counters_and_empty_queries(spark):
    from lodestack.operators.ingest import run_counters

    ended = spark.createDataFrame([("a", "indexed", None), ("a", "skipped", None), ("b", "rejected", "too long"), ("b", "indexed", None), ("b", "skipped", "e")], "kind string, status string, error string")
    assert tuple(run_counters(ended).first()) == (2, 1, 2)
    assert sorted(map(tuple, run_counters(ended, ["kind"]).collect())) == [("a", 1, 1, 0), ("b", 1, 0, 2)]
    asked, found = spark.range(5).withColumnRenamed("id", "query_id"), spark.createDataFrame([(1,), (1,), (4,)], "query_id long")
    assert tuple(evalmetrics.empty_queries(asked, found).first()) == (5, 3)


def test_driver_twins_of_the_prompt_columns(spark):
    for answer in ("[2] then [1] and [2], Source [3]: x [9] [0] [99999999999999999999]", "Source [1]: yes", ""):
        assert rag.markers_in(answer, 5) == one(spark, rag.citation_markers(F.lit(answer), F.lit(5)))[0]
    for chunks in ([("T", "s"), ("U", "v\nw")], []):
        cell = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(s).alias("snippet")) for t, s in chunks]) if chunks else F.array().cast("array<struct<title: string, snippet: string>>")
        assert rag.user_turn_text(chunks, "f", "q?") == one(spark, rag.user_turn(rag.context_block(cell), F.lit("f"), F.lit("q?")))[0]


def test_rrf_and_weights(spark):
    none = F.lit(None).cast("int")
    r = one(spark, scores.rrf(F.lit(1), F.lit(3), 60), scores.rrf(F.lit(1), none, 60), scores.rrf(none, none, 60), scores.rrf(F.lit(1), F.lit(1), 60, 2.0, 0.5))
    assert r[0] == pytest.approx(1 / 61 + 1 / 63)
    assert r[1] == pytest.approx(1 / 61)
    assert r[2] == 0
    assert r[3] == pytest.approx(2.5 / 61)
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [x[0] for x in df.select(scores.kind_weight(F.col("k"), {"a": 0.5})).collect()] == [0.5, 1.0, 1.0]


def test_recency(spark):
    rule = scores.RecencyRule(("posts",), 180.0, 0.85)
    now = F.lit(datetime.datetime(2026, 7, 13))
    rows = [("posts", "2026-07-13"), ("posts", "2026-01-14"), ("posts", "1990-01-01"), ("posts", "2030-01-01"), ("faq", "1990-01-01"), (None, "1990-01-01"), ("posts", "not-a-date"), ("posts", None)]
    df = spark.createDataFrame(rows, "k string, p string")
    got = [round(x[0], 3) for x in df.select(scores.recency_multiplier(rule, F.col("k"), F.col("p"), now)).collect()]
    assert got == [1.0, 0.925, 0.85, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.cosine_similarity(a, a), vectors.cosine_similarity(a, zero), vectors.hash_embedding(F.lit("x"), 384).alias("v"))
    assert r[0] == 1 and r[1] is None and len(r["v"]) == 384
    assert sum(x * x for x in r["v"]) == pytest.approx(1, abs=1e-5)


def test_eval_metrics(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    overlap = lambda a, b, k: one(spark, evalmetrics.overlap_at_k(arr(*a), arr(*b), k))[0]
    rho = lambda a, b: one(spark, evalmetrics.spearman_shared(arr(*a), arr(*b)))[0]
    assert overlap("abcd", "abcx", 4) == 0.75
    assert overlap("ab", "abcd", 10) == 0.5
    assert overlap("", "", 10) is None
    assert rho("abc", "abc") == 1 and rho("abc", "cba") == -1 and rho("abc", "acb") == 0.5 and rho("ab", "bx") is None
    assert rho("axbyc", "zabwc") == 1


def test_config_merge():
    c = merge_config({"field_weights": {"title": 5.0}, "kind_weights": {"a": 1}})
    assert c["field_weights"] == {"title": 5.0, "body": 1.0} and c["rrf_k"] == 60
    assert merge_config({"kind_weights": {"b": 2}}, c)["kind_weights"] == {"b": 2}
    assert DEFAULT_CONFIG["kind_weights"] == {}


def test_params():
    assert params.kind_weights("a:0.5,b:c:2,a:1") == {"a": 1.0, "b:c": 2.0}
    assert params.kind_weights("") is None
    for bad in ("a", "a:-1", "a:x", ":1"):
        with pytest.raises(params.BadRequest):
            params.kind_weights(bad)
    assert params.recency("a,b:30:0.5") == scores.RecencyRule(("a", "b"), 30.0, 0.5)
    assert params.recency("a:30:").floor == 0
    for bad in ("a", "a:0:0.5", "a:30:2", ":30:1"):
        with pytest.raises(params.BadRequest):
            params.recency(bad)
    assert params.kinds("a, b,") == ("a", "b")
    with pytest.raises(params.BadRequest):
        params.kinds(" , ")
    with pytest.raises(params.BadRequest, match=r"messages\[0\].role"):
        params.RAG({"question": "q", "messages": [{"role": "system", "content": "x"}]})
    params.DOCUMENT({"external_id": "a", "title": "t", "body": "b"})


def test_citations_and_pages(spark):
    marks = lambda a, n: one(spark, rag.citation_markers(F.lit(a), F.lit(n)))[0]
    assert marks("[2] then [1] and [2], Source [3]: x [9] [0]", 5) == [1, 2]
    assert marks("According to Source [1]: yes", 3) == []
    urls = spark.createDataFrame([('{"source_url":"u"}',), ('{"source_url":3}',), ("{}",), (None,), ("broken",)], "m string")
    assert [r[0] for r in urls.select(rag.citation_url(F.col("m"))).collect()] == ["u", "", "", "", ""]
    assert [state.clamp_limit(x) for x in (None, "abc", "0", "7x", "99999", -3)] == [1000, 1000, 1, 7, 5000, 1]
    assert state.next_cursor([], 1) is None and state.next_cursor([{"external_id": "a"}], 1) == "a" and state.next_cursor([{"external_id": "a"}], 2) is None


def test_stems():
    pairs = {"running": "run", "flies": "fli", "happily": "happili", "relational": "relat", "hopping": "hop", "conditional": "condit", "generously": "generous", "parking": "park", "permits": "permit", "cry": "cri", "by": "by", "say": "say"}
    assert {w: stem(w) for w in pairs} == pairs


def test_html():
    page = """<!-- c --><html lang="en"><head><title> T </title><meta name="viewport" content="x"><meta property="og:title" content=" OG "><link rel="canonical" href="http://c"></head>
    <body><h1>Head  line</h1><p>before</p><p> </p><p>after <strong>b</strong> <a href="u">l</a></p><ul><li>one<li>two</ul><ol start="3"><li>x</li><li>y</li></ol>
    <table><tr><th>A</th></tr><tr><td>1</td></tr></table><script>no</script></body></html>"""
    title, body, meta = html.run(page, (html.extract_meta(), html.extract_title(), html.clean_whitespace(), html.to_markdown()))
    assert title == "Head line" or title == "Head  line"
    assert meta == {"og_title": "OG", "html_title": "T", "language": "en", "canonical_url": "http://c"}
    assert "before\n\nafter **b** [l](u)" in body and "- one\n- two" in body and "3. x\n4. y" in body and "| A |\n| --- |\n| 1 |" in body and "no" not in body.split()
    assert html.run("<p>a<em>b</em></p>", (html.unwrap("em"), html.to_markdown()))[1] == "ab"
    assert html.run("<div><main>m</main>x</div>", (html.select_content("main"), html.to_markdown()))[1] == "m"
    assert html.run("<p>b</p>", (lambda p: (p.metadata.update(k="v"), p)[1], html.inject_into_body("k", "prepend"), html.to_markdown()))[1] == "v\n\nb"
    with pytest.raises(ValueError):
        html.run("<p>b</p>", (html.extract_title(required=True),))
    assert html.run(None, (html.to_markdown(),))[1] == ""


def test_deeply_nested_page_and_error_rows(spark):
    deep = "<div>" * 5000 + "<p>core <b>x</b></p>" + "</div>" * 5000
    assert html.run(deep, (html.clean_whitespace(), html.to_markdown()))[1] == "core **x**"
    quoted = html.run("<blockquote><p>a</p><ul><li>b<ol><li>c</li></ol></li></ul></blockquote><p><code>x_y</code> z_</p>", (html.to_markdown(),))[1]
    assert quoted == "> a\n>\n> - b\n>   1. c\n\n`x_y` z\\_"

    def broken(p):
        raise ValueError("no such page")

    pages = spark.createDataFrame([("<p>x</p>",), (None,)], "html string")
    assert [(r["p"]["body"], r["p"]["error"]) for r in pages.select(html.pipeline(broken)(F.col("html")).alias("p")).collect()] == [(None, "no such page")] * 2
    articles = spark.createDataFrame([("1", "T", "u", "d", "<p>x</p>"), ("2", "B", "u", "d", " <table><tr><td>t</td></tr></table>"), ("3", "N", "u", "d", None)], "id string, title string, url string, last_published_at string, content string")
    assert [(r["external_id"], r["body"], r["error"]) for r in html.kb_transform(articles, "b/", "kb").collect()] == [("1", "x", None)]


def test_long_texts_are_cut_in_nearly_linear_time(spark):
    """Chunks of 1 and 4 MB are those that plain greedy joining gives, and four times the text takes no sixteen times as long."""
    import time

    from lodestack.functions.text import pack

    took = []
    for size in (1_000_000, 4_000_000):
        words = [f"w{i % 977}. " for i in range(size // 6)]
        want, now = [], ""
        for w in words:
            if now and -(-len(now + w) // 3) > 50:
                want.append(now.strip())
                now = ""
            now += w
        want.append(now.strip())
        df = spark.createDataFrame([("".join(words),)], "t string")
        began = time.time()
        got = df.select(pack(F.filter(F.split("t", "(?<= )"), lambda x: x != ""), 50).alias("c")).first()["c"]
        took.append(time.time() - began)
        assert got == want
    assert took[1] < 8 * took[0] + 10
