"""Continuous ingest: every batch of documents becomes a layer of a store.

A store (sources.layers) has documents, segments and their text index. A batch reads what is stored of its own documents, writes a layer with these
documents only, and publishes a pointer that lists the layer. The pointer carries, apart from the version's own number, counters of
documents and segments, and the last batch number of each stream, so a micro-batch that is run again after a failure changes nothing
(exactly once by idempotence), whatever else has been written in between. Layers are written together when there are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.functions.text import chunk_text, simple_tokens
from lodestack.operators import ingest, vector_index
from lodestack.operators.batched import Embedding, with_vectors
from lodestack.operators.lexical import Analyser, TextIndex, analysed, blocks_of, index_of, text_index
from lodestack.sources.files import Files
from lodestack.sources.layers import Conflict, LayeredStore, Table

__all__ = ["Conflict", "Files", "SnapshotStore", "delete", "retry", "stream_upserts", "upsert"]

FORMAT = 3
DOCS = "external_id string, title string, body string, kind string, metadata string, segment_count int, created_at timestamp, updated_at timestamp"
SEGMENTS = "external_id string, segment_index int, segment string, content_hash string, embedding array<float>"
POSTINGS = "term string, doc_id string, segment_index int, level int, at array<int>"
BLOCKS = "term string, titled boolean, level int, n long"
SIZES = "doc_id string, n_title int, fields array<struct<segment_index: int, n: int>>"
VECTORS = "external_id string, segment_index int, embedding array<float>, list int"
REPORT = "external_id string, segments int, changed long, unchanged long, removed long, status string, error string"
TABLES = {
    "docs": Table(DOCS, "external_id", ("external_id",)), "segments": Table(SEGMENTS, "external_id", ("external_id", "segment_index")),
    "postings": Table(POSTINGS, "doc_id", ("term", "level", "doc_id")), "blocks": Table(BLOCKS, None, ("term",)), "sizes": Table(SIZES, "doc_id", ("doc_id",)),
    "vectors": Table(VECTORS, "external_id", ("external_id", "segment_index"), "list"),
}
NO_ID = "document has no external_id"
T = TypeVar("T")
#: a column function, or an outside model with what it has said before
Embed = Callable[[Column], Column] | Embedding


def retry(work: Callable[[], T], attempts: int = 3, on: type[Exception] = Conflict) -> T:
    """work(), again after an error of the kind `on`, at most `attempts` times in all."""
    for left in reversed(range(attempts)):
        try:
            return work()
        except on:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def _to_format_2(store: SnapshotStore) -> None:
    """Format 1 had empty pointers and folders named by version."""
    for v in store.versions():
        if not store.files.read(f"_versions/{v}"):
            store.files.write(f"_versions/{v}", json.dumps({"folder": f"v{v}", "streams": {}}))


def _to_format_3(store: SnapshotStore) -> None:
    """Format 2 had one folder for each version, and no text index or one of another kind: the last version becomes the base, with an index made anew."""
    v = store.version()
    told = json.loads(store.files.read(f"_versions/{v}"))
    if "layers" not in told:
        folder, words = told["folder"], store.new_folder()
        if not store.files.exists(f"{folder}/segments"):  # documents without text
            store.spark.createDataFrame([], SEGMENTS).write.parquet(f"{store.path}/{folder}/segments")
        docs, segments = (store.spark.read.schema(TABLES[n].schema).parquet(f"{store.path}/{folder}/{n}") for n in ("docs", "segments"))
        made = text_index(segments.selectExpr("external_id AS doc_id", "segment_index", "segment AS body"), docs.selectExpr("external_id AS doc_id", "title"), store.analyse)
        rows = {"docs": docs.count(), "segments": segments.count()}
        text = store._write(words, {"postings": made.postings, "blocks": blocks_of(made.postings), "sizes": made.sizes}, {"postings": made.postings.count(), "sizes": rows["docs"]})
        layer = {"folder": folder, "tables": ["docs", "segments"], "ranged": [], "rows": rows}
        report = folder if store.files.exists(f"{folder}/report") else None
        told = {"layers": [layer, text], "streams": told["streams"], "counters": rows, "report": report}
        store.files.write(f"_versions/{v}", json.dumps(told))
    for old in store.versions()[:-1]:
        before = json.loads(store.files.read(f"_versions/{old}"))
        store.files.delete(f"_versions/{old}")
        if before.get("folder") not in (None, told["layers"][0]["folder"]):
            store.files.delete(before["folder"])


#: what brings a store of the format before to the one of the key
MIGRATIONS: dict[int, Callable[[SnapshotStore], None]] = {2: _to_format_2, 3: _to_format_3}


class SnapshotStore(LayeredStore):
    """Versions of a document table, a segment table, their text index and, from `index_from` segments, an index of the vectors.

    The vector index is fitted when all layers are written together; the vectors of later batches go to its lists.
    """

    def __init__(self, spark: SparkSession, path: str, analyse: Analyser = simple_tokens, index_from: int = 50_000, **layout):
        super().__init__(spark, path, TABLES, **layout)
        self.analyse, self.index_from = analyse, index_from
        self._migrate()

    def _migrate(self) -> None:
        """Bring an older store to FORMAT, one step after the other; a newer one is an error."""
        found = int(self.files.read("_format")) if self.files.exists("_format") else 1 if self.files.exists("_versions") else None
        if found is None:
            return
        if found > FORMAT:
            raise ValueError(f"the store has format {found}, this version reads up to {FORMAT}")
        for step in range(found + 1, FORMAT + 1):
            if self.versions():
                MIGRATIONS[step](self)
            self.files.write("_format", str(step))

    def docs(self, pointer: dict | None = None) -> DataFrame:
        return self.read("docs", pointer)

    def segments(self, pointer: dict | None = None) -> DataFrame:
        return self.read("segments", pointer)

    def index(self, pointer: dict | None = None) -> TextIndex:
        """The stored text index; doc_id is the external_id."""
        p = pointer or self.pointer()
        return TextIndex(self.read("postings", p), self.read("sizes", p), lambda terms: self.find("postings", terms, p), lambda terms: self.find("blocks", terms, p))

    def prepare(self, base: dict, which: str, tables: dict[str, DataFrame], rows: dict[str, int]) -> dict:
        """Words are counted again; a new base gets new lists, if it has enough vectors."""
        if "postings" in tables:  # not in layers of deletes only
            tables["blocks"] = blocks_of(tables["postings"])
        if which != "all":
            return base
        tables.pop("vectors", None)
        n, lists = rows.get("segments", 0), None
        if n >= self.index_from:
            lists = vector_index.fit(tables["segments"], n)
        if lists is None:
            return {**base, "index": None}
        folder = f"lists-{uuid.uuid4().hex}"
        lists.write(self.spark, f"{self.path}/{folder}")
        tables["vectors"], rows["vectors"] = vector_index.assign(tables["segments"].select("external_id", "segment_index", "embedding"), lists), n
        return {**base, "index": folder}

    def lists(self, pointer: dict) -> vector_index.Lists | None:
        return vector_index.Lists.read(self.spark, f"{self.path}/{pointer['index']}") if pointer["index"] else None

    def vectors(self, lists: list[int] | None, pointer: dict) -> DataFrame:
        """vec_id, part, embedding, list of the visible vectors in some lists (None: all)."""
        parts = [self._scan(x, "vectors") for x in pointer["layers"]]
        named = [d if d is None or lists is None else d.filter(F.col("list").isin(lists)) for d in parts]
        return self.merged("vectors", named, pointer).withColumnsRenamed({"external_id": "vec_id", "segment_index": "part"})

    def report(self) -> DataFrame:
        """What became of each document of the batch that made the current version."""
        folder = self.pointer()["report"]
        return self.spark.read.schema(REPORT).parquet(f"{self.path}/{folder}/report") if folder else self.spark.createDataFrame([], REPORT)

    def write(self, base: dict, tables: dict[str, DataFrame], streams: dict[str, int] | None = None) -> None:
        """Write a layer over `base`, a pointer whose counters are already those of the new version; Conflict if another version has been published since.

        base["rows"], if there, has about how many rows the tables have.
        """
        if not self.files.exists("_format"):
            self.files.write("_format", str(FORMAT))
        self.add_layer(base, tables, base.get("rows", {}), streams)


def upsert(
    store: SnapshotStore, batch: DataFrame, embed: Embed, now: Column, max_tokens: int = 1000, max_segments: int = 150,
    analyse: Analyser = simple_tokens, order: str | None = None, stream: str | None = None, number: int | None = None,
) -> DataFrame:
    """Merge a batch (external_id, title, body, kind, metadata) into the store, and say what became of each document (REPORT).

    Of repeated ids the last row stays, by the column `order` if given, else by the batch's own partitions and rows, which says something only for a batch
    that has not been shuffled. A document without text is stored without segments. One of too many segments, or without an id, is rejected with an
    error, and what the store has of it stays. Only changed segments are embedded; only new documents are analysed. What is written and
    read grows with the batch, not with the store, until layers are written together. A micro-batch (stream, number) that the store has seen changes nothing.
    """
    if stream is not None and number is not None and number <= store.pointer()["streams"].get(stream, -1):
        return store.spark.createDataFrame([], REPORT)
    fields = F.struct("title", "body", "kind", "metadata")
    last = F.col(order) if order else F.monotonically_increasing_id()
    one = batch.withColumn("_last", last).groupBy("external_id").agg(F.max_by(fields, "_last").alias("m"), F.count(F.lit(1)).alias("n")).select("external_id", "n", "m.*")
    staged = f"{store.path}/_batches/{uuid.uuid4().hex}"
    one.withColumn("chunks", chunk_text(F.col("body"), max_tokens)).write.parquet(f"{staged}/batch")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{staged}/{name}")
        return store.spark.read.schema(df.schema).parquet(f"{staged}/{name}")

    def merge() -> DataFrame:
        base = store.pointer()
        every = store.spark.read.schema("external_id string, n long, title string, body string, kind string, metadata string, chunks array<string>").parquet(f"{staged}/batch")
        good, bad = ingest.split_by_limit(every.filter("external_id IS NOT NULL"), F.size("chunks"), max_segments)
        gone = good.select("external_id")
        new = ingest.segments_of(good.select("external_id", "title", "chunks"))
        old_docs, old = (kept(f"old-{name}", store.find_all(name, gone, base)) for name in ("docs", "segments"))
        counts = good.select("external_id", "title", "body", "kind", "metadata", F.size(ingest.distinct_segments(F.col("chunks"))).alias("segment_count"))
        docs = kept("docs", ingest.merge_documents(old_docs, counts.withColumn("created_at", now), now))
        merged = ingest.merge_segments(old, new.select("external_id", "segment_index", "segment", "content_hash"), gone)
        titled = merged.join(new.select("external_id", "content_hash", "title"), ["external_id", "content_hash"], "left")
        whole = with_vectors(titled, embed, F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("segment")))
        fields = kept("fields", analysed(new.selectExpr("external_id AS doc_id", "segment_index", "segment AS body", "title"), good.selectExpr("external_id AS doc_id", "title"), analyse))
        fresh = index_of(fields)
        changes = ingest.report(ingest.diff(new, old, "external_id", gone), "external_id")
        said = good.select("external_id").join(changes, "external_id", "left").select(
            "external_id", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("segments", "int"), ("changed", "long"), ("unchanged", "long"), ("removed", "long"))],
            F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"),
        )
        nameless = every.filter("external_id IS NULL").select("external_id", F.explode(F.array_repeat(F.lit(NO_ID), F.col("n").cast("int"))).alias("error"))
        refused = bad.select("external_id", "error").union(nameless)
        refused = refused.select("external_id", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit("rejected"), "error")
        size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("segment_count"), F.lit(0)).alias("segments")).first().asDict()
        words = fields.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
        before = {"docs": old_docs.count(), "segments": old.count()}
        counters = {n: base["counters"].get(n, 0) + size[n] - before[n] for n in before}
        rows = {**size, "postings": words, "sizes": size["docs"], "gone": size["docs"]}
        tables = {
            "docs": docs, "segments": whole.select("external_id", "segment_index", "segment", "content_hash", "embedding"),
            "postings": fresh.postings, "blocks": blocks_of(fresh.postings), "sizes": fresh.sizes, "gone": gone, "report": said.union(refused),
        }
        if (lists := store.lists(base)) is not None:
            tables["segments"] = kept("segments", tables["segments"])  # embedded once
            tables["vectors"], rows["vectors"] = vector_index.assign(tables["segments"].select("external_id", "segment_index", "embedding"), lists), size["segments"]
        store.write({**base, "counters": counters, "rows": rows}, tables, {stream: number} if stream is not None and number is not None else None)
        return store.report()

    try:
        said = retry(merge)
    finally:
        store.files.delete(staged.removeprefix(f"{store.path}/"))
        if store.files.names("_batches") == []:
            store.files.delete("_batches")
    compact_if_wanted(store)
    return said


def compact_if_wanted(store: SnapshotStore) -> None:
    """Write layers together if there are many; if another writer is faster, it is left to the next batch."""
    if which := store.wants(store.pointer()):
        try:
            store.compact(which)
        except Conflict:
            pass


def delete(store: SnapshotStore, ids: DataFrame) -> None:
    """Drop documents (external_id) with their segments and postings; ids that are not there change nothing. Streams go on where they are.

    Only the ids are written; the rows are hidden from then on, and go when layers are written together.
    """

    def merge() -> None:
        base = store.pointer()
        found = store.find_all("docs", ids.select("external_id"), base).select("external_id", "segment_count")
        n, segments = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("segment_count"), F.lit(0))).first()
        if n:
            counters = {"docs": base["counters"].get("docs", n) - n, "segments": base["counters"].get("segments", segments) - segments}
            store.write({**base, "counters": counters, "rows": {"gone": n}}, {"gone": found.select("external_id")})

    retry(merge)
    compact_if_wanted(store)


def stream_upserts(
    source: DataFrame, store: SnapshotStore, embed: Embed, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, stream: str = "stream", **options
) -> StreamingQuery:
    """Start a query that merges each micro-batch of a document stream into the store; `stream` names it, for as long as its checkpoint lives."""

    def run(batch: DataFrame, number: int) -> None:
        upsert(store, batch, embed, now(), stream=stream, number=number, **options)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
