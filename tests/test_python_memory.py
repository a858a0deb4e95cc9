"""What a task's Python holds at once does not grow with the tables."""

import numpy as np
import pyarrow as pa


def test_vectors_go_to_their_lists_in_pieces():
    from lodestack.operators import vector

    rng = np.random.default_rng(3)
    m, centres = rng.normal(size=(3000, 16)), rng.normal(size=(200, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(m.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["query_id", "embedding"])
    unit = m.astype(np.float32).astype(np.float64)
    order = np.argsort(-(unit / np.linalg.norm(unit, axis=1, keepdims=True) @ centres.T), axis=1, kind="stable")
    for n in (1, 180):
        pieces = list(vector._dealt_to_lists(iter([batch]), centres, n))
        assert max(p.num_rows * 16 for p in pieces) <= vector.CELLS  # 180 lists each: 8.6 million numbers in all
        got = np.concatenate([p.column(2).to_numpy() for p in pieces]).reshape(3000, n)
        assert (got == order[:, :n]).all() and np.concatenate([p.column(0).to_numpy() for p in pieces]).tolist() == np.repeat(np.arange(3000), n).tolist()


def test_documents_are_scored_in_pieces_with_the_same_result(monkeypatch):
    from lodestack.operators import covers

    rng = np.random.default_rng(5)
    rows = []
    for d in range(90):
        for k in range(-1, 3):
            words = rng.integers(0, 3, 6)
            rows.append((d, k, None, [], 6))
            rows += [(d, k, f"w{t}", np.flatnonzero(words == t).tolist(), 0) for t in set(words.tolist())]
    schema = pa.schema([("doc_id", pa.int64()), ("segment_index", pa.int32()), ("term", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.int32())])
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    terms = pa.table({"query_id": [1, 1, 2, 3], "n_terms": [2, 2, 1, 1], "term_no": [0, 1, 0, 0], "term": ["w0", "w1", "w1", "w1"]})
    asked = covers.Covers.of(terms, -1, 1.0, 1 / 3)
    run = lambda size: list(asked.run(iter(table.to_batches(max_chunksize=size))))
    every = lambda found: sorted(map(tuple, (r.values() for r in pa.Table.from_batches(found).to_pylist())))
    want = every(run(10_000))
    monkeypatch.setattr(covers, "PAIRS", 100)
    pieces = run(10_000)
    assert len(want) > 500 and len(pieces) > 10 and every(pieces) == want and every(run(7)) == want
