"""Calls to outside models in batches, each distinct input once: embeddings of texts and answers to prompts.

Inputs are named by a hash of the model and the text. What a model has said is kept in a layered store in ranges of that name, so a
batch looks up its own names, calls the model for the others, one call for each distinct input, and keeps what it said. Calls are made
in the tasks: texts go in lists of `size`, prompts one by one with a bounded number at a time. A call that fails is tried again; an
input that keeps failing is an error of its own and the others go on. Answers are kept slice by slice, so what is lost with an executor or
a driver is a slice at most.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.files import forget, kept
from lodestack.sources.layers import Conflict, LayeredStore, Table

#: texts of one call, and tries of a call
SIZE, TRIES = 64, 3
#: prompts at a time in a task, and of one slice that is kept as a whole
AT_ONCE, SLICE = 8, 2_000


class TextEmbedder(Protocol):
    """An outside model of vectors: a name that changes with the model, and a list of vectors for a list of texts."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def tried(call: Callable[[], object], tries: int = TRIES, wait: float = 0.05) -> object:
    """call(), again after an error, with longer and longer waits."""
    for left in reversed(range(tries)):
        try:
            return call()
        except Exception:  # noqa: BLE001  any error of an outside service
            if not left:
                raise
            time.sleep(wait * 2 ** (tries - left - 1))
    raise ValueError("tries must be at least 1")


class Kept:
    """name -> what a model said, in a layered store; of two writers of one name either is right."""

    def __init__(self, spark: SparkSession, path: str, said: str):
        self.store = LayeredStore(spark, path, {"said": Table(f"name string, {said}", "name", ("name",))})

    def known(self, names: DataFrame) -> DataFrame:
        """name and what was said, of those of names(name) that are kept."""
        found = self.store.find_all("said", names.select(F.col("name").alias("external_id")))
        return found.dropDuplicates(["name"])

    def add(self, rows: DataFrame) -> None:
        n = rows.count()
        for _ in range(20 if n else 0):
            try:
                self.store.add_layer(self.store.pointer(), {"said": rows}, {"said": n})
                break
            except Conflict:
                continue
        if which := self.store.wants(self.store.pointer()):
            try:
                self.store.compact(which)
            except Conflict:
                pass


@dataclass
class Embedding:
    """A TextEmbedder with what it has said before."""

    spark: SparkSession
    model: TextEmbedder
    path: str
    size: int = SIZE
    kept: Kept = field(init=False)

    def __post_init__(self) -> None:
        self.kept = Kept(self.spark, self.path, "embedding array<float>")

    def fill(self, rows: DataFrame, text: Column, column: str = "embedding") -> DataFrame:
        """rows with `column`: the vector of `text`, where the column is null or not there. Null texts have none."""
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("array<float>"))
        name = F.when(F.col(column).isNull() & text.isNotNull(), F.sha2(F.concat(F.lit(self.model.name), F.lit("\n"), text), 256))
        named = rows.withColumn("_name", name)
        asked = kept(named.filter("_name IS NOT NULL").groupBy(F.col("_name").alias("name")).agg(F.first(text).alias("text")), "embed-asked")
        new = asked.join(self.kept.known(asked), "name", "left_anti")
        made = kept(embedded(new, self.model, self.size), "embed-made")
        self.kept.add(made)
        found = self.kept.known(asked).select(F.col("name").alias("_name"), F.col("embedding").alias("_made"))
        out = kept(named.join(found, "_name", "left").withColumn(column, F.coalesce(column, "_made")).select(*rows.columns), "embed-rows")
        forget(asked, made)
        return out


def with_vectors(rows: DataFrame, embed: Callable[[Column], Column] | Embedding, text: Column) -> DataFrame:
    """rows with `embedding`, which stays where it is not null: by a column function, or by an outside model."""
    if isinstance(embed, Embedding):
        return embed.fill(rows, text)
    return rows.withColumn("embedding", F.coalesce("embedding", embed(text)) if "embedding" in rows.columns else embed(text))


def embedded(texts: DataFrame, model: TextEmbedder, size: int = SIZE) -> DataFrame:
    """name, embedding for texts(name, text): a call for each `size` of them in a task. A call that keeps failing fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                vectors = tried(lambda: model.embed(part.column(1).to_pylist()))
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["name", "embedding"])

    return texts.select("name", "text").mapInArrow(run, "name string, embedding array<float>")


def completed(prompts: DataFrame, complete: Callable[[dict], dict], at_once: int = AT_ONCE) -> DataFrame:
    """name, answer (JSON; null if it failed), error for prompts(name, prompt: JSON of what the model gets)."""

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(tried(lambda: complete(json.loads(prompt)))), None
        except Exception as e:  # noqa: BLE001  one item's failure is its own
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                said = list(pool.map(ask, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in said], pa.string()), pa.array([e for _, e in said], pa.string())], names=["name", "answer", "error"])

    return prompts.select("name", "prompt").mapInArrow(run, "name string, answer string, error string")


def answered(spark: SparkSession, path: str, prompts: DataFrame, complete: Callable[[dict], dict], at_once: int = AT_ONCE, slice_rows: int = SLICE) -> DataFrame:
    """prompts(.., prompt) with answer and error: each distinct prompt is asked once, and never again once it has an answer.

    Slices of the open prompts are asked and kept one after the other. Failures are not kept: another call asks them again.
    """
    store = Kept(spark, path, "answer string")
    named = kept(prompts.withColumn("name", F.sha2("prompt", 256)), "answer-asked")
    distinct = named.groupBy("name").agg(F.first("prompt").alias("prompt"))
    todo = kept(distinct.join(store.known(distinct), "name", "left_anti"), "answer-open")
    slices, failed = max(1, -(-todo.count() // slice_rows)), []
    for i in range(slices):
        part = todo.filter(F.pmod(F.xxhash64("name"), F.lit(slices)) == i)
        said = kept(completed(part.repartition(spark.sparkContext.defaultParallelism), complete, at_once), "answer-said")
        store.add(said.filter("error IS NULL").select("name", "answer"))
        failed.append(said.filter("error IS NOT NULL").select("name", "error"))
    errors = failed[0]
    for f in failed[1:]:
        errors = errors.union(f)
    return named.join(store.known(distinct), "name", "left").join(errors, "name", "left").drop("name")
