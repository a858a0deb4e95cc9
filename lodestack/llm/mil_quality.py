"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Every passage is described by dense statistics (character classes, word
lengths, variety, repetition of earlier passages) and encoded by a learned layer. Gated attention (a tanh and a sigmoid branch) gives each passage
a weight, learned from document labels alone, and the weighted sum of encodings is scored.

The model is trained by Adam on at most MAX_LABELLED labelled documents of at most MAX_PASSAGES passages (documented bounds; the choice is
by hash, the texts are whole, and of rows that share a doc_id one is taken) and is a few kilobytes; scoring reads every whole text once where it lies, without a shuffle. Language, source and identifier are never
inputs. Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are not read.

Defined results: null and empty texts are one passage of zeros and are scored; without labelled rows of both kinds every score is the
share of good labels (0.5 if none); several labels of one doc_id count as their largest; a null doc_id is not held
out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import small_batches
from lodestack.llm.toxicity import held_out, labelled_texts, training_labels

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
MAX_LABELLED = 8_000
#: passages of the longest document that is learned from; every document is scored
MAX_PASSAGES = 200
PASSAGE = 100
HIDDEN, GATE, EPOCHS, BATCH = 24, 12, 40, 64

FEATURES = (
    "length", "word_length", "symbols", "marks", "exclamations", "pipes", "capitals", "shouted", "digits", "other_script",
    "distinct", "commonest", "seen_words", "seen_pairs", "breaks", "long_words", "short_words", "titled",
)
_SYMBOLS, _MARKS = b"#*$%&<>=^~@\\{}", b".,;:?"
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def passages(text: str | None, size: int = PASSAGE) -> np.ndarray:
    """One row of FEATURES per passage of `size` words; the last takes what is left."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros((1, len(FEATURES)), np.float32)
    out, seen, seen_pairs = [], set(), set()
    breaks = raw.count(b"\n") / len(words)
    n_bags = max(1, round(len(words) / size))
    edges = [len(words) * k // n_bags for k in range(n_bags + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        some = words[a:b]
        joined, n = b" ".join(some), b - a
        chars = len(joined) - n + 1
        counts = Counter(some)
        kinds = set(counts)
        pairs = set(zip(some, some[1:], strict=False))
        without = lambda drop: (len(joined) - len(joined.translate(None, drop))) / chars  # noqa: E731, B023
        lengths = [len(w) for w in some]
        out.append((
            math.log(n) / 5, chars / n / 8, without(_SYMBOLS), without(_MARKS), without(b"!"), joined.count(b"|") / n, without(_CAPITALS),
            sum(map(bytes.isupper, some)) / n, without(_DIGITS), without(_HIGH), len(kinds) / n, max(counts.values()) / n,
            len(kinds & seen) / len(kinds), len(pairs & seen_pairs) / max(1, len(pairs)), breaks, sum(x > 14 for x in lengths) / n,
            sum(x < 3 for x in lengths) / n, sum(w[:1].isupper() for w in some) / n,
        ))
        seen |= kinds
        seen_pairs |= pairs
    return np.array(out, np.float32)


class GatedAttention:
    """encode -> gated attention -> weighted sum -> logistic; bags are runs of rows of one matrix."""

    def __init__(self, n_inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / math.sqrt(a), (a, b)).astype(np.float32)
        self.w = {
            "E": draw(n_inputs, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "a": draw(GATE, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32),
        }
        self.mean, self.scale = np.zeros(n_inputs, np.float32), np.ones(n_inputs, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, sizes = self.w, np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["a"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        att = s / np.add.reduceat(s, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "att": att, "z": z, "p": p, "bag": bag}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(y)
        d = (f["p"] - y) / n
        dz = d[:, None] * w["o"]
        dzb = dz[f["bag"]]
        da = (dzb * f["h"]).sum(1)
        ds = f["att"] * (da - np.add.reduceat(f["att"] * da, starts)[f["bag"]])
        dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["att"][:, None] * dzb + dt @ w["V"].T + dg @ w["U"].T
        dh *= 1 - f["h"] ** 2
        return {
            "E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds,
            "o": f["z"].T @ d, "b": d.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> GatedAttention:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for epoch in range(epochs):
            rate = 0.01 * 0.5 * (1 + math.cos(math.pi * epoch / epochs)) + 1e-4
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                some = [bags[k] for k in order[i : i + BATCH]]
                starts = np.cumsum([0, *map(len, some[:-1])])
                g = self.gradients(self.forward(np.concatenate(some), starts), y[order[i : i + BATCH]], starts)
                step += 1
                for k in self.w:
                    grad = g[k] + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["p"]


def bags_of(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages of the labelled sample, in order of doc_id.

    As numbers they come to the driver: one row of at most MAX_LABELLED documents, of at most MAX_PASSAGES passages each
    (a longer document is not learned from).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [passages(t.as_py()) for t in b.column(1)]
            few = pa.array([len(r) <= MAX_PASSAGES for r in rows], pa.bool_())
            cells = pa.array([r.tobytes() if k else None for r, k in zip(rows, few.to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), cells], names=["doc_id", "label", "bag"]).filter(few)

    small_batches(docs.sparkSession)
    some = labelled_texts(docs, labels).select("doc_id", "text", "label")
    rows = some.mapInArrow(run, "doc_id long, label double, bag binary").toPandas().sort_values("doc_id")
    return [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)) for x in rows["bag"]], rows["label"].to_numpy(np.float32)


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text), learned from labels(doc_id, quality)."""
    bags, y = bags_of(docs, training_labels(labels, "quality", FOLDS, HELD_OUT, limit))
    prior = float(y.mean()) if len(y) else 0.5
    model = GatedAttention(len(FEATURES)).fit(bags, y) if len(set(y.tolist())) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.full(b.num_rows, prior)
            if model:
                for i in range(0, b.num_rows, 256):
                    scores[i : i + 256] = model.predict([passages(t.as_py()) for t in b.column(1).slice(i, 256)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
