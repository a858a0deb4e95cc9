"""The corpus pipeline, stage by stage, against plain Python on a small table."""

import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from lodestack.llm import outliers, packing, simhash  # noqa: E402
from lodestack.llm.common import staged  # noqa: E402
from lodestack.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choices(["the", "re", "an", "in", "on", "ti"], k=rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(rnd.randint(40, 160)), "en", f"s{i % 4}") for i in range(260)]
    rows += [(300 + i, rows[i][1].replace(" ", "  " if i % 2 else "\n"), "en", "s1") for i in range(30)]  # exact copies
    rows += [(400 + i, rows[i][1] + " end", "en", "s2") for i in range(40, 60)]  # near copies
    rows += [(500 + i, " ".join(w + "###" for w in prose(60).split()), "en", "s3") for i in range(5)]
    rows += [(600, None, None, None), (601, "", "en", "s1"), (602, "too few words", "en", None), (603, "same " * 400, "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), "test-stage")
        rows = out.collect()
        before = docs.collect()
        if name != "packing":
            assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            kept.append(len(rows))
        if name == "quality rules":
            bad = {r["doc_id"] for r in before for n in [len(words(r["text"]))] if n < 10 or 100 * outliers.repeated_words(words(r["text"])) > 20 * n}
            ids = {r["doc_id"] for r in rows}
            assert not ids & bad and not ids & set(range(500, 505))
            assert ids == {r["doc_id"] for r in before} - bad - set(range(500, 505))
        elif name == "exact dedup":
            strip = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"])
            best = {}
            for r in before:
                best[strip(r)] = min(best.get(strip(r), (0, 10**9)), (-len(r["text"]), r["doc_id"]))
            assert {r["doc_id"] for r in rows} == {i for _, i in best.values()}
        elif name == "simhash near-dedup":
            fp = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in before}
            root = {i: i for i in fp}
            for _ in range(6):
                for a in fp:
                    root[a] = min(root[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 4)
            assert {r["doc_id"] for r in rows} == {i for i in fp if root[i] == i} and len(rows) < len(before)
        elif name == "mixing sources":
            size, taken = defaultdict(int), defaultdict(int)
            for r in before:
                size[r["source"]] += len(words(r["text"]))
            for r in rows:
                taken[r["source"]] += len(words(r["text"]))
                assert r["n_chars"] == len(r["text"])
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 30
            assert all(taken[s] <= 2 * size[s] + 5 for s in size)
        else:
            cache = packing.TokenCache(tokenizer_path())
            assert sum(r["length"] for r in rows) == sum(len(x) // 4 + 1 for x in cache.encode([r["text"] or "" for r in before]))
        docs = out
    assert kept[0] > kept[1] > kept[2]
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == sum(r["length"] for r in rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
