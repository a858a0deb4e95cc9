"""The facade: indexes with keys, documents, prompts, search and grounded answers over snapshot stores."""

from __future__ import annotations

import base64
import datetime
import hashlib
import hmac
import json
import secrets
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol, TypeVar
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.config import merge_config
from lodestack.functions.text import simple_tokens
from lodestack.functions.vectors import hash_embedding
from lodestack.operators import rag, state
from lodestack.operators.batched import Embedding, TextEmbedder, answered, with_vectors
from lodestack.operators.lexical import Analyser
from lodestack.operators.fusion import SearchOptions, Stored, hybrid_search
from lodestack.operators.vector import check_dimensions
from lodestack.operators.vector_index import nearest_in_lists
from lodestack.plans import params
from lodestack.sources.files import Files, forget, kept
from lodestack.streaming.ingest import TABLES, Conflict, SnapshotStore, delete, retry, stream_upserts, upsert

KEY_PREFIX = {"index": "idx", "search": "srch", "rag": "rag"}


class Unauthorized(PermissionError):
    pass


class NotFound(KeyError):
    pass


def generate_key(kind: str) -> str:
    return f"{KEY_PREFIX[kind]}_{base64.urlsafe_b64encode(secrets.token_bytes(24)).decode().rstrip('=')}"


def hash_key(key: str) -> str:
    salt = secrets.token_bytes(16)
    return f"{salt.hex()}:{hashlib.scrypt(key.encode(), salt=salt, n=2**12, r=8, p=1).hex()}"


def verify_key(key: str, stored: str | None) -> bool:
    if not stored:
        return False
    salt, _, digest = stored.partition(":")
    return hmac.compare_digest(hashlib.scrypt(key.encode(), salt=bytes.fromhex(salt), n=2**12, r=8, p=1).hex(), digest)


class Llm(Protocol):
    def complete(self, system: str, messages: list[dict], max_tokens: int, temperature: float) -> dict: ...


class EchoLlm:
    """The test model: repeats the last user message, with markers if asked."""

    def __init__(self, markers: int = 0, text: str | None = None):
        self.markers, self.text = markers, text

    def complete(self, system: str, messages: list[dict], max_tokens: int, temperature: float) -> dict:  # noqa: ARG002
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        text = (self.text or f"[test] {last}") + "".join(f" [{i + 1}]" for i in range(self.markers))
        return {"text": text, "model": "test", "usage": {"input_tokens": sum(len(m["content"]) for m in messages), "output_tokens": len(text)}}


def check_model(model: str) -> str:
    if not params.MODEL_ID.match(model):
        raise ValueError(f"unsupported model: {model}")
    return model


class Rejected(ValueError):
    """A document that the index does not take."""


@dataclass
class Index:
    """What the registry keeps of an index; its data are in `folder`, which a new index of the same name does not share."""

    name: str
    description: str | None
    config: dict
    keys: dict[str, str | None]
    folder: str
    created_at: str
    prompts: dict[str, dict] = field(default_factory=dict)


Embedder = Callable[[Column, int], Column]
T = TypeVar("T")


class SearchEngine:
    """Indexes under one folder: a registry of small files (an index's settings, key hashes and prompts) and a snapshot store each.

    Every call reads the registry, so engines on the same folder see the same indexes. `embedders` maps a provider's name to a column
    function, or to an outside model that is called in batches; what such a model says is kept under the folder.
    """

    def __init__(self, spark: SparkSession, path: str, embedders: dict[str, Embedder | TextEmbedder] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.embedders = {"test": hash_embedding, **(embedders or {})}

    # -- administration

    # An entry is a folder of numbered files, each written only if it is not there yet; the last one counts. So of two engines that change an
    # entry at once the second sees the first one's change and makes its own again.

    @staticmethod
    def _entry(name: str) -> str:
        return f"_indexes/{quote(name, safe='')}"

    def _numbers(self, name: str) -> list[int]:
        old = f"_registry/{quote(name, safe='')}"  # entries were single files once
        if self.files.exists(old) and not self.files.exists(self._entry(name)):
            self.files.create(f"{self._entry(name)}/0", self.files.read(old))
            self.files.delete(old)
        return sorted(int(n) for n in self.files.names(self._entry(name)) if n.isdigit())

    def _change(self, name: str, change: Callable[[Index], T | None]) -> T | None:
        """What `change` says of the index, which it changes; nothing is written if it says None. None if there is no such index."""

        def once() -> T | None:
            if not (numbers := self._numbers(name)):
                return None
            index = self._read(name, numbers[-1])
            said = change(index)
            if said is not None:
                if not self.files.create(f"{self._entry(name)}/{numbers[-1] + 1}", json.dumps(asdict(index))):
                    raise Conflict(f"{name} has been changed by another")
                for n in numbers[:-1]:  # the one before stays for readers that have seen its name
                    self.files.delete(f"{self._entry(name)}/{n}")
            return said

        return retry(once, attempts=20)

    def _read(self, name: str, number: int) -> Index:
        return Index(**json.loads(self.files.read(f"{self._entry(name)}/{number}")))

    def _index(self, name: str) -> Index:
        if (index := self.get_index(name)) is None:
            raise NotFound(name)
        return index

    def create_index(self, name: str, description: str | None = None, config: dict | None = None) -> dict | None:
        """The two new keys, shown once; None if the name is taken."""
        merged = merge_config(config or {})
        check_dimensions(merged["embedding"]["dimensions"])
        plain = {k: generate_key(k) for k in ("index", "search")}
        keys = {**{k: hash_key(v) for k, v in plain.items()}, "rag": None}
        now = datetime.datetime.now(datetime.UTC).isoformat()
        index = Index(name, description, merged, keys, f"data-{uuid.uuid4().hex}", now)
        if self._numbers(name) or not self.files.create(f"{self._entry(name)}/0", json.dumps(asdict(index))):
            return None
        return {"name": name, "index_key": plain["index"], "search_key": plain["search"]}

    def ensure_index(self, name: str, description: str | None = None, config: dict | None = None) -> dict:
        """Get or create: {"created": True, ...keys} for a new index, {"created": False} for one that is there."""
        made = None if self.get_index(name) else self.create_index(name, description, config)
        return {"created": True, **made} if made else {"created": False}

    def get_index(self, name: str) -> Index | None:
        numbers = self._numbers(name)
        return self._read(name, numbers[-1]) if numbers else None

    def list_indexes(self) -> list[Index]:
        """In order of creation."""
        names = {unquote(n) for folder in ("_indexes", "_registry") for n in self.files.names(folder) if not n.endswith(".part")}
        return sorted(filter(None, map(self.get_index, names)), key=lambda i: (i.created_at, i.name))

    def update_index(self, name: str, config: dict) -> Index | None:
        def change(index: Index) -> Index:
            index.config = merge_config(config, index.config)
            return index

        return self._change(name, change)

    def delete_index(self, name: str) -> bool:
        """Drop the index with its documents, prompts and keys; False if there is none."""
        index = self.get_index(name)
        if index:
            self.files.delete(self._entry(name))
            self.files.delete(index.folder)
        return index is not None

    def mint_key(self, name: str, kind: str) -> str | None:
        """A new key in place of the old one, which stops working."""
        key = generate_key(kind)
        hashed = hash_key(key)

        def change(index: Index) -> str:
            index.keys[kind] = hashed
            return key

        return self._change(name, change)

    def revoke_key(self, name: str, kind: str) -> bool:
        def change(index: Index) -> bool:
            index.keys[kind] = None
            return True

        return self._change(name, change) is not None

    def authorize(self, name: str, kind: str, key: str | None) -> Index:
        if not key:
            raise Unauthorized("missing key")
        index = self._index(name)
        if not verify_key(key, index.keys.get(kind)):
            raise Unauthorized("invalid key")
        return index

    def create_prompt(self, name: str, prompt: str, content: dict) -> dict | None:
        """The prompt; None if its name is taken."""
        params.PROMPT(content)
        self._index(name)
        return self._change(name, lambda index: None if prompt in index.prompts else index.prompts.setdefault(prompt, content))

    def update_prompt(self, name: str, prompt: str, content: dict) -> dict | None:
        params.PROMPT(content)
        self._index(name)

        def change(index: Index) -> dict | None:
            if prompt not in index.prompts:
                return None
            index.prompts[prompt] = content
            return content

        return self._change(name, change)

    def get_prompt(self, name: str, prompt: str) -> dict | None:
        return self._index(name).prompts.get(prompt)

    def list_prompts(self, name: str) -> list[str]:
        return sorted(self._index(name).prompts)

    def delete_prompt(self, name: str, prompt: str) -> bool:
        self._index(name)
        return self._change(name, lambda index: index.prompts.pop(prompt, None) and True) is not None

    def status(self, name: str) -> dict[str, DataFrame]:
        """tables: the stored tables with files, bytes and rows; dimensions: the size of a sampled vector; totals: documents and segments."""
        store = self.store(name)
        p = store.pointer()
        folders = {t: [f"{store.path}/{x['folder']}/{t}" for x in p["layers"] if t in x["tables"]] for t in TABLES}
        stored = {t: (found, store.read(t, p)) for t, found in folders.items() if found}
        total = (name, p["counters"].get("docs", 0), p["counters"].get("segments", 0))
        return {
            "tables": state.tables(self.spark, stored),
            "dimensions": state.dimensions(store.segments(p).withColumn("index", F.lit(name)), "index", "content_hash"),
            "totals": self.spark.createDataFrame([total] if total[1] else [], "index string, total_documents long, total_segments long"),
        }

    def healthy(self) -> bool:
        return self.spark.range(1).count() == 1

    # -- documents

    def store(self, name: str) -> SnapshotStore:
        index = self._index(name)
        return SnapshotStore(self.spark, f"{self.path}/{index.folder}", self.analyser(index.config))

    def embedder(self, config: dict) -> Callable[[Column], Column] | Embedding:
        e = config["embedding"]
        if e["provider"] not in self.embedders:
            raise ValueError(f"unknown embedding provider: {e['provider']}")
        model = self.embedders[e["provider"]]
        if hasattr(model, "embed"):
            return Embedding(self.spark, model, f"{self.path}/_vectors/{quote(model.name, safe='')}")
        return lambda text: model(text, e["dimensions"])

    @staticmethod
    def analyser(config: dict) -> Analyser:
        if config["text_search_config"] == "english":
            from lodestack.functions.english import english_tokens

            return english_tokens
        return simple_tokens

    def ingest(self, name: str, docs: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
        """Merge documents (external_id, title, body, kind, metadata as JSON text): external_id, segments, changed, unchanged, removed, status, error.

        Of repeated ids the last row stays, by the column `order` if given.
        """
        c = self._index(name).config
        now = F.current_timestamp() if now is None else now
        return upsert(self.store(name), docs, self.embedder(c), now, c["max_segment_tokens"], c["max_segments_per_document"], self.analyser(c), order)

    def ingest_document(self, name: str, document: dict, now: Column | None = None) -> dict:
        """Ingest one document; Rejected if it has too many segments."""
        params.DOCUMENT(document)
        row = tuple(document.get(k) for k in ("external_id", "title", "body", "kind")) + (json.dumps(document.get("metadata") or {}),)
        frame = self.spark.createDataFrame([row], "external_id string, title string, body string, kind string, metadata string")
        said = self.ingest(name, frame, now).first().asDict()
        if error := said.pop("error"):
            raise Rejected(error)
        return {k: said[k] for k in ("external_id", "segments", "changed", "unchanged", "status")}

    def ingest_stream(self, name: str, docs: DataFrame, checkpoint: str, stream: str = "stream"):
        """Start a query that merges a document stream into the index."""
        c = self._index(name).config
        return stream_upserts(
            docs, self.store(name), self.embedder(c), checkpoint, stream=stream, max_tokens=c["max_segment_tokens"], max_segments=c["max_segments_per_document"], analyse=self.analyser(c)
        )

    def delete_documents(self, name: str, ids: list[str]) -> None:
        delete(self.store(name), self.spark.createDataFrame([(i,) for i in ids], "external_id string"))

    def documents(self, name: str, limit: object = None, after: str | None = None) -> dict:
        n = state.clamp_limit(limit)
        rows = state.page(self.store(name).after("docs", after, n), n, after).collect()
        return {"documents": [{**r.asDict(), "metadata": json.loads(r["metadata"])} for r in rows], "next_cursor": state.next_cursor(rows, n)}

    # -- retrieval

    def search_batch(self, name: str, queries: DataFrame, now: Column | None = None, **options) -> DataFrame:
        """hybrid_search over the index for queries(query_id, q)."""
        return self._search(self._index(name).config, self.store(name), None, queries, now, **options)

    def _search(self, config: dict, store: SnapshotStore, pointer: dict | None, queries: DataFrame, now: Column | None, held: list | None = None, **options) -> DataFrame:
        """`held` takes the small tables that the result reads."""
        p = pointer or store.pointer()  # one version for all that a search reads
        held = [] if held is None else held
        keep = lambda df: held.append(kept(df, "search")) or held[-1]
        docs = lambda d: d.withColumn("doc_id", F.col("external_id")).withColumn("published_at", rag.text_field(F.col("metadata"), "published_at"))
        segments = lambda s: s.withColumnsRenamed({"external_id": "doc_id", "segment": "body"})
        ids = lambda found: found.select(F.col("doc_id").alias("external_id"))
        lists = store.lists(p)
        stored = Stored(
            lambda found: docs(store.find_all("docs", ids(found), p)), lambda found: segments(store.find_all("segments", ids(found), p)), keep,
            (lambda q, k: nearest_in_lists(lambda some: store.vectors(some, p), lists, q, k)) if lists else None,
        )
        q = with_vectors(queries.drop("embedding"), self.embedder(config), F.col("q"))
        now = F.current_timestamp() if now is None else now
        o = SearchOptions.from_config(config, **options)
        return hybrid_search(segments(store.segments(p)), docs(store.docs(p)), q, o, now, self.analyser(config), store.index(p), stored)

    def search(self, name: str, q: str, limit: int = 10, mode: str = "hybrid", kinds: str | None = None, kind_weights: str | None = None, recency: str | None = None, now: Column | None = None, **more) -> dict:
        if not q or not q.strip():
            raise params.BadRequest("q is required")
        options = {"limit": limit, "mode": mode, "kinds": params.kinds(kinds), "kind_weights": params.kind_weights(kind_weights), "recency": params.recency(recency), **more}
        one = self.spark.createDataFrame([(0, q)], "query_id long, q string")
        store = self.store(name)
        p = store.pointer()
        held: list[DataFrame] = []
        rows = self._search(self._index(name).config, store, p, one, now, held, **options).orderBy("position").collect()
        forget(*held)
        found = {r["external_id"]: r["metadata"] for r in store.find("docs", [r["external_id"] for r in rows], p).select("external_id", "metadata").collect()} if rows else {}
        rows = [{**r.asDict(), "metadata": found[r["external_id"]]} for r in rows]
        results = [{k: r[k] for k in ("external_id", "score", "title", "snippet", "kind")} | {"metadata": json.loads(r["metadata"] or "{}")} for r in rows]
        return {"results": results, "total": rows[0]["total"] if rows else 0, "query": q}

    def answer(self, name: str, prompt: str, question: str, llm: Llm, messages: list[dict] | None = None) -> dict:
        """A grounded answer: retrieval by the prompt's settings, one completion, citations of the chunks it names."""
        params.RAG({"question": question, "messages": messages})
        content = self.get_prompt(name, prompt)
        if content is None:
            raise NotFound(prompt)
        r = content["retrieval"]
        chunks = self.search(name, question, r["limit"], r["mode"], max_chunks_per_doc=r["max_chunks_per_doc"], min_lexical_score=r["min_lexical_score"], min_vector_score=r["min_vector_score"])["results"]
        turn = rag.user_turn_text([(c["title"], c["snippet"]) for c in chunks], content["response_format"], question)
        done = llm.complete(content["system"], [*(messages or []), {"role": "user", "content": turn}], content["max_tokens"], content["temperature"])
        marks = rag.markers_in(done["text"], len(chunks))
        cited = [{"marker": m, **{k: chunks[m - 1][k] for k in ("external_id", "title", "snippet")}, "url": chunks[m - 1]["metadata"].get("source_url", "")} for m in marks]
        for c in cited:
            c["url"] = c["url"] if isinstance(c["url"], str) else ""
        best: dict[str, float] = {}
        for c in chunks:
            best[c["external_id"]] = max(c["score"], best.get(c["external_id"], c["score"]))
        used = {c["external_id"] for c in cited}
        return {
            "answer": done["text"], "citations": cited, "retrieved": [{"external_id": i, "score": s, "used": i in used} for i, s in best.items()],
            "model": done["model"], "prompt": prompt, "usage": done["usage"],
        }

    def answer_batch(self, name: str, prompt: str, questions: DataFrame, llm: Llm, now: Column | None = None) -> DataFrame:
        """question_id, question, answer, citations, retrieved, model, error for questions(question_id, question): as answer, for all at once.

        One retrieval for the batch; the model is asked in the tasks, each distinct prompt once, and what it said is kept under the folder. A question that fails
        has an error. The model has to reach the tasks.
        """
        content = self.get_prompt(name, prompt)
        if content is None:
            raise NotFound(prompt)
        store, r = self.store(name), content["retrieval"]
        p = store.pointer()
        options = {k: r[k] for k in ("limit", "mode", "max_chunks_per_doc", "min_lexical_score", "min_vector_score")}
        asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("q"))
        found = kept(rag.contexts(self._search(self._index(name).config, store, p, asked, now, **options)), "answer-chunks")
        full = questions.select("question_id", "question").join(found, F.col("question_id") == F.col("query_id"), "left").drop("query_id")
        full = full.withColumn("chunks", F.coalesce("chunks", F.array().cast(found.schema["chunks"].dataType)))
        turn = rag.user_turn(rag.context_block(F.col("chunks")), F.lit(content["response_format"]), F.col("question"))
        fixed = {"model": content["model"], "system": content["system"], "max_tokens": content["max_tokens"], "temperature": content["temperature"]}
        said = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], F.array(F.struct(F.lit("user").alias("role"), turn.alias("content"))).alias("messages")))
        complete = lambda d: llm.complete(d["system"], d["messages"], d["max_tokens"], d["temperature"])
        done = answered(self.spark, f"{self.path}/_answers", full.withColumn("prompt", said), complete)
        done = done.withColumn("a", F.from_json("answer", "text string, model string")).withColumn("answer", F.col("a.text"))
        marks = rag.citation_markers(F.coalesce("answer", F.lit("")), F.size("chunks"))
        at = F.transform(marks, lambda m: F.struct(m.alias("marker"), *[F.get("chunks", m - 1)[c].alias(c) for c in ("external_id", "title", "snippet")]))
        done = kept(done.select("question_id", "question", "answer", "chunks", at.alias("cited"), F.col("a.model").alias("model"), "error"), "answer-rows")
        # addresses of the cited documents
        cited = done.select("question_id", F.explode("cited").alias("c")).select("question_id", "c.*")
        docs = store.find_all("docs", cited.select("external_id"), p).select("external_id", rag.citation_url(F.col("metadata")).alias("url"))
        each = cited.join(docs, "external_id", "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("marker", "external_id", "title", "snippet", F.coalesce("url", F.lit("")).alias("url")))).alias("citations"))
        none = F.array().cast("array<struct<marker:int,external_id:string,title:string,snippet:string,url:string>>")
        used = F.transform("citations", lambda c: c["external_id"])
        best = F.transform(F.array_distinct(F.transform("chunks", lambda c: c["external_id"])), lambda i: F.struct(
            i.alias("external_id"), F.array_max(F.transform(F.filter("chunks", lambda c: c["external_id"] == i), lambda c: c["score"])).alias("score"), F.array_contains(F.col("used"), i).alias("used"),
        ))
        whole = done.join(each, "question_id", "left").withColumn("citations", F.coalesce("citations", none)).withColumn("used", used)
        return whole.select("question_id", "question", "answer", "citations", best.alias("retrieved"), "model", "error")
