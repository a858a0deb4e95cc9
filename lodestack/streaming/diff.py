"""Changes of documents' segments as a stream: each document's segment hashes are state of its own, so a micro-batch joins no stored table.

The state is kept per document by Spark's state store (RocksDB, with the stream's checkpoint), so a restart goes on where it was, and a batch that
is run again starts from the state before it. A document's state is no more than its hashes and indexes, which the segment limit bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestack.functions.text import chunk_text
from lodestack.operators.ingest import distinct_segments

CHANGES = "external_id string, content_hash string, old_index int, new_index int, state string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SegmentDiff(StatefulProcessor):
    """Rows (external_id, at, segments: array of content_hash and segment_index; null: the document is deleted) against the hashes of the row before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("segments", "content_hash string", "segment_index int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ARG002, N802, N803
        last = None
        for r in rows:  # of rows of one batch the last counts
            if last is None or (r["at"] is not None and (last["at"] is None or r["at"] >= last["at"])):
                last = r
        new = {s["content_hash"]: s["segment_index"] for s in last["segments"] or []}
        old = {h[0]: i[0] for h, i in self.seen.iterator()}
        for h, i in old.items():
            if h not in new:
                self.seen.removeKey((h,))
                yield Row(external_id=key[0], content_hash=h, old_index=i, new_index=None, state="removed")
        for h, i in new.items():
            if old.get(h) != i:
                self.seen.updateValue((h,), (i,))
            yield Row(external_id=key[0], content_hash=h, old_index=old.get(h), new_index=i, state="unchanged" if h in old else "changed")

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """Set the state store that per-document state needs, where the session has another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def diff_stream(docs: DataFrame, max_tokens: int = 1000, order: str | None = None) -> DataFrame:
    """CHANGES for a stream docs(external_id, body), as ingest.diff gives them for each micro-batch against what the stream has brought before.

    Of a batch's rows of one document the last by the column `order` counts (without one, any). A column `deleted`, if there, drops documents. Rows
    without an id are left out.
    """
    use_state(docs.sparkSession)
    chunks = chunk_text(F.col("body"), max_tokens)
    told = F.transform(distinct_segments(chunks), lambda s: F.struct(s["content_hash"].alias("content_hash"), s["segment_index"].alias("segment_index")))
    told = F.when(~F.coalesce(F.col("deleted"), F.lit(False)), told) if "deleted" in docs.columns else told
    at = F.col(order).cast("long") if order else F.lit(None).cast("long")
    rows = docs.filter("external_id IS NOT NULL").select("external_id", at.alias("at"), told.alias("segments"))
    return rows.groupBy("external_id").transformWithState(statefulProcessor=SegmentDiff(), outputStructType=CHANGES, outputMode="Append", timeMode="None")
