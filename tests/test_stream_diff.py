"""The stateful diff of a document stream against ingest.diff over stored tables, with restarts."""

import random

from pyspark.sql import functions as F

from lodestack.operators import ingest
from lodestack.streaming.diff import diff_stream

SCHEMA = "external_id string, body string, number int, deleted boolean"


def test_stateful_diff_equals_the_joined_one(spark, tmp_path):
    rnd, stored, source = random.Random(2), {}, f"{tmp_path}/in"
    got, want = [], []
    for step in range(4):
        rows = []
        for n in range(8):
            text = "\n\n".join(rnd.choices(["alpha beta", "gamma", "delta", "epsilon zeta"], k=rnd.randint(1, 4)))
            rows.append((f"d{rnd.randrange(6)}", text, n, rnd.random() < 0.15))
        rows.append((None, "no id", 99, False))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        out = f"{tmp_path}/out{step}"
        # a new query for every batch: the state comes from the checkpoint
        stream = diff_stream(spark.readStream.schema(SCHEMA).json(source), 5, "number")
        q = stream.writeStream.foreachBatch(lambda df, _, out=out: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        got.append(sorted(map(str, spark.read.parquet(out).select("external_id", "content_hash", "old_index", "new_index", "state").collect())))
        last = {i: (body, gone) for i, body, _, gone in rows if i is not None}
        new = spark.createDataFrame([(i, b) for i, (b, gone) in last.items() if not gone], "external_id string, body string")
        cut = ingest.to_segments(new, 5).select("external_id", "segment_index", "content_hash")
        old = spark.createDataFrame([(i, k, h) for i, segs in stored.items() for h, k in segs.items()], "external_id string, segment_index int, content_hash string")
        touched = spark.createDataFrame([(i,) for i in last], "external_id string")
        joined = ingest.diff(cut, old, "external_id", touched).select("external_id", "content_hash", "old_index", "new_index", "state")
        want.append(sorted(map(str, joined.collect())))
        for i in last:
            stored.pop(i, None)
        for r in cut.collect():
            stored.setdefault(r["external_id"], {})[r["content_hash"]] = r["segment_index"]
    assert got == want and all(any(state in x for b in got for x in b) for state in ("'unchanged'", "'changed'", "'removed'"))
    assert len(got) == 4 and sum(map(len, got)) > 20
