"""Outside models in batches: how often they are called, what is kept, and what failures do."""

import datetime
import json
import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestack.engine import EchoLlm, SearchEngine
from lodestack.operators.batched import Embedding, answered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks cannot import this file
DOCUMENT = "external_id string, title string, body string, kind string, metadata string"
PROMPT = {
    "system": "s", "response_format": "Cite.", "model": "test", "max_tokens": 10, "temperature": 0.0,
    "retrieval": {"limit": 3, "mode": "lexical", "max_chunks_per_doc": 1, "min_lexical_score": 0, "min_vector_score": 0},
}


def now():
    return F.lit(datetime.datetime(2026, 7, 13))


class Letters:
    """A model that counts letters and writes each call down."""

    name = "letters-1"

    def __init__(self, log, fail=0):
        self.log, self.fail = str(log), fail
        os.makedirs(self.log, exist_ok=True)

    def embed(self, texts):
        with open(f"{self.log}/{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        if len(os.listdir(self.log)) <= self.fail:
            raise OSError("busy")
        return [[float(t.count(c)) + 0.1 for c in "aeiou"] for t in texts]

    def calls(self):
        return [json.loads(open(f"{self.log}/{n}").read()) for n in os.listdir(self.log)]


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    model = Letters(tmp_path / "log")
    e = Embedding(spark, model, f"file://{tmp_path}/kept", size=10)
    rows = spark.createDataFrame([(i, f"text a{'e' * (i % 25)}") for i in range(100)] + [(200, None)], "id long, t string").repartition(4)
    got = {r["id"]: r["embedding"] for r in e.fill(rows, F.col("t")).collect()}
    assert len(got) == 101 and got[200] is None and round(got[3][1], 3) == 4.1 + 0.0 and got[3] == got[28]
    texts = [t for c in model.calls() for t in c]
    assert len(texts) == len(set(texts)) == 25 and max(map(len, model.calls())) <= 10
    more = spark.createDataFrame([(1, "text aeee", None), (2, "new", None), (3, "kept", [1.0])], "id long, t string, embedding array<float>")
    again = {r["id"]: r["embedding"] for r in e.fill(more, F.col("t")).collect()}
    assert again[1] == got[3] and again[3] == [1.0] and sorted(t for c in model.calls() for t in c)[:1] == ["new"] and len([t for c in model.calls() for t in c]) == 26


def test_engine_with_an_outside_model(spark, tmp_path):
    model = Letters(tmp_path / "log", fail=1)  # the first call fails, and is tried again
    e = SearchEngine(spark, f"file://{tmp_path}/e", {"letters": model})
    e.create_index("i", config={"embedding": {"provider": "letters", "dimensions": 5}, "text_search_config": "simple"})
    docs = [("a", "A", "banana", None, '{"source_url": "http://a"}'), ("b", "B", "kiwi", None, None), ("c", "A", "banana", None, None)]
    said = e.ingest("i", spark.createDataFrame(docs, DOCUMENT), now()).collect()
    assert sorted(r["status"] for r in said) == ["indexed"] * 3 and e.store("i").segments().filter("embedding IS NULL").isEmpty()
    before = len(model.calls())
    e.ingest("i", spark.createDataFrame([("d", "B", "kiwi", None, None)], DOCUMENT), now())  # title and text are known
    assert len(model.calls()) == before
    for _ in range(2):
        assert e.search("i", "banana", mode="semantic", now=now())["results"][0]["external_id"] in ("a", "c")
    assert len(model.calls()) == before + 1


class Asked(EchoLlm):
    def __init__(self, log, **more):
        super().__init__(**more)
        self.log = str(log)
        os.makedirs(self.log, exist_ok=True)

    def complete(self, system, messages, max_tokens, temperature):
        open(f"{self.log}/{uuid.uuid4().hex}", "w").close()
        if "broken" in messages[-1]["content"] and not os.path.exists(f"{self.log}/../mended"):
            raise OSError("no answer")
        return super().complete(system, messages, max_tokens, temperature)


def test_batch_answers(spark, tmp_path):
    """The answers of a batch are those of single questions; one that fails is an error, and is asked again later, alone."""
    e = SearchEngine(spark, f"file://{tmp_path}/e")
    e.create_index("i", config={"embedding": {"provider": "test", "dimensions": 8}, "text_search_config": "simple"})
    docs = [("a", "Apples", "red apples", None, '{"source_url": "http://a"}'), ("b", "Pears", "green pears and apples", None, None)]
    e.ingest("i", spark.createDataFrame(docs, DOCUMENT), now())
    e.create_prompt("i", "p", PROMPT)
    llm = Asked(tmp_path / "log", markers=2)
    asked = [(1, "apples"), (2, "pears"), (3, "broken"), (4, "nothing there"), (5, "apples")]
    got = {r["question_id"]: r for r in e.answer_batch("i", "p", spark.createDataFrame(asked, "question_id long, question string"), llm, now()).collect()}
    for i, q in asked:
        if q != "broken":
            one = e.answer("i", "p", q, EchoLlm(markers=2))
            assert got[i]["answer"] == one["answer"] and [c.asDict() for c in got[i]["citations"]] == one["citations"] and got[i]["error"] is None
            assert sorted((x["external_id"], x["score"], x["used"]) for x in got[i]["retrieved"]) == sorted((x["external_id"], x["score"], x["used"]) for x in one["retrieved"])
    assert got[3]["answer"] is None and "no answer" in got[3]["error"]
    n = len(os.listdir(llm.log))
    assert n == 3 + 3  # three distinct prompts, and three tries of the broken one
    (tmp_path / "mended").touch()
    again = {r["question_id"]: r for r in e.answer_batch("i", "p", spark.createDataFrame(asked, "question_id long, question string"), llm, now()).collect()}
    assert len(os.listdir(llm.log)) == n + 1 and again[3]["error"] is None and again[1]["answer"] == got[1]["answer"]


def test_answers_are_kept_slice_by_slice(spark, tmp_path):
    prompts = spark.createDataFrame([(i, json.dumps({"q": i})) for i in range(30)], "id long, prompt string")
    path = f"file://{tmp_path}/kept"

    def complete(d):
        open(f"{tmp_path}/{uuid.uuid4().hex}.asked", "w").close()
        return {"text": str(d["q"])}

    rows = answered(spark, path, prompts, complete, slice_rows=7).collect()
    assert {r["id"]: json.loads(r["answer"])["text"] for r in rows} == {i: str(i) for i in range(30)}
    answered(spark, path, prompts, complete).collect()
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".asked")]) == 30
