"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features of a text: density and strength of lexicon words, lexicon words within NEAR words of a second-person word, capitals, punctuation,
and obfuscated words (letters mixed with digits or symbols, and lexicon words found after undoing that). The
lexicon is learned: words and word beginnings whose document frequency is far higher in toxic documents. Labelled rows are dealt by a
hash of their identifier to three parts, for the lexicon, the trees and the calibration, so that none sees what another has
fitted.
At most MAX_LABELLED labelled documents (a documented bound, by hash), one row of each, are learned from; everything is scored.

Language, source and identifier are never inputs of a score. Rows whose crc32(doc_id as text) mod 4 is 2 are held
out: their labels are not read.

Defined results: null and empty texts have all features zero and are scored; without labelled rows of both kinds every score
is the share of toxic labels (0 if none); several labels of one doc_id count as toxic if any is; a null doc_id is not held out; very
long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import small_batches, staged

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
MAX_LABELLED = 40_000
LEXICON_WORDS = 400
#: a lexicon word is in at least this many toxic documents, and in at least this share of them
MIN_DOCUMENTS, MIN_SUPPORT = 3, 0.004
#: characters of a word's beginning that is an entry of its own, written with a star
STEM = 7
NEAR = 5
#: a step of the calibration nearer than this to raw score 0 or 1 lies at that end
END = 1e-9
SECOND_PERSON = frozenset(
    "you your yours u ur yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes su vosotros".split()
)
FEATURES = (
    "lexicon_density", "lexicon_strength", "lexicon_hits", "strongest", "near_person", "person_density", "capitals", "shouted_words",
    "marks", "exclamations", "mixed_words", "undone_density", "log_words",
)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_~`"
_MARKS = b".,;:!?"
_UNDO = str.maketrans("013457@$!|", "oleastasil")
_CAPITALS = bytes(range(65, 91))
_SIGNS = str.maketrans("", "", "".join(chr(x) for x in range(33, 127) if not chr(x).isalpha()))


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """FEATURES of one text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), sum(map(len, words))
    # one rule for words: bytes split at ASCII white space only
    plain = [w.decode("utf-8", "surrogatepass").strip(_EDGE) for w in text.lower().encode("utf-8", "surrogatepass").split()]
    strong = {w: max(lexicon.get(w, 0.0), lexicon.get(w[:STEM] + "*", 0.0)) for w in set(plain)}
    bad = {w for w, x in strong.items() if x > 0}
    hits = [i for i, w in enumerate(plain) if w in bad] if bad else []
    persons = [i for i, w in enumerate(plain) if w in SECOND_PERSON] if hits else []
    # words with a digit or sign between letters
    mixed = {w for w in strong if len(w) > 3 and w[:1].isalpha() and w.translate(_SIGNS) != w}
    undone = {w for w in mixed if w.translate(_UNDO) in lexicon or w.translate(_SIGNS) in lexicon}
    n_mixed, n_undone = (sum(w in s for w in plain) if s else 0 for s in (mixed, undone))
    near = 0
    if hits and persons:
        at = np.searchsorted(persons, hits)
        p = np.array([-(10**9), *persons, 10**9])
        near = int((np.minimum(np.array(hits) - p[at], p[at + 1] - np.array(hits)) <= NEAR).sum())
    strengths = [strong[plain[i]] for i in hits]
    shouted = sum(w.isupper() for w in words if len(w) > 2)
    return [
        (len(hits) + n_undone) / n, sum(strengths) / n, math.log1p(len(hits)), max(strengths, default=0.0), near / n, len(persons) / n,
        (len(raw) - len(raw.translate(None, _CAPITALS))) / size, shouted / n, (len(raw) - len(raw.translate(None, _MARKS))) / size,
        raw.count(b"!") / n, n_mixed / n, n_undone / n, math.log(n),
    ]


def featured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t.as_py(), lexicon) for t in b.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES)
    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)


def held_out(folds: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == which, F.lit(False))


def training_labels(labels: DataFrame, column: str, folds: int, which: int, limit: int) -> DataFrame:
    """doc_id, label, part (0 to 3, by hash) of the labelled rows that may be learned from, about `limit` of them at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(folds, which)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known.withColumn("unit", F.pmod(F.xxhash64("doc_id", F.lit(column)), F.lit(1 << 20))), "labels")
    share = min(1.0, limit / max(1, known.count()))
    return known.filter(F.col("unit") < share * (1 << 20)).select("doc_id", "label", (F.col("unit") % 4).alias("part"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, part, text: one row for each of `labels` (of training_labels, so a bounded number) that docs has.

    Of rows that share a doc_id the one with the least hash of its text is learned from, however many there are.
    """
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "coalesce(text, '') AS text").join(F.broadcast(labels), "doc_id")
    return rows.groupBy("doc_id", "label", "part").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("m")).select("doc_id", "label", "part", "m.text")


def learn_lexicon(texts: DataFrame, size: int = LEXICON_WORDS) -> dict[str, float]:
    """Entry -> log odds, for words and beginnings (with a star) in far more toxic than other documents of `texts` (label, text).

    The odds are shrunk towards 0 for entries of few documents.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{2,})"), F.lit(1)))
    stems = F.transform(F.filter(words, lambda w: F.char_length(w) >= STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    rows = texts.select("label", F.explode(F.concat(words, F.array_distinct(stems))).alias("word"))
    total = texts.agg(F.expr("count_if(label > 0)").alias("bad"), F.expr("count_if(label <= 0)").alias("good")).first()
    bad, good = total["bad"] or 0, total["good"] or 0
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    counted = rows.groupBy("word").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g")).filter(F.col("b") >= max(MIN_DOCUMENTS, MIN_SUPPORT * bad))
    ranked = counted.withColumn("odds", odds).filter("odds > 1").withColumn("odds", F.col("odds") * F.col("b") / (F.col("b") + 5))
    return {r["word"]: r["odds"] for r in ranked.orderBy(F.desc(F.col("odds") * F.sqrt("b")), "word").limit(size).collect()}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text), learned from labels(doc_id, toxic)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = staged(training_labels(labels, "toxic", FOLDS, HELD_OUT, MAX_LABELLED), "toxic-labels")
    texts = staged(labelled_texts(docs, known), "toxic-texts")
    lexicon = learn_lexicon(texts.filter("part < 2"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    table = staged(featured(docs, lexicon), "toxic-features")
    marked = staged(featured(texts, lexicon).join(F.broadcast(known), "doc_id"), "toxic-marked")
    labelled = vectors.transform(marked).select("features", "label", "part")
    both = lambda df: {r["label"] for r in df.select("label").distinct().collect()} >= {0.0, 1.0}
    fit = labelled.filter("part = 2").coalesce(8).cache()
    if both(fit):
        trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, maxBins=64, seed=7).fit(fit)
        raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
        scored = calibrate(raw(labelled.filter("part = 3")).select("raw", "label")).transform(raw(vectors.transform(table)).select("doc_id", "raw"))
        scored = scored.withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    else:
        prior = known.agg(F.avg("label")).first()[0] or 0.0
        scored = table.withColumn("score", F.lit(float(prior)))
    fit.unpersist()
    return scored.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def calibrate(held: DataFrame):
    """The isotonic curve of label on raw, centred: a model with inputs raw and output prediction.

    Equal raw scores are joined before the fit, so no task holds more than the distinct ones. Each step of the curve becomes
    one point in the middle of its raw scores, at its share of labels with half a row of each kind added; (0, 0) and (1, 1)
    close it, and stand for a step that lies at raw score 0 or 1 itself. Between the points it is linear, so that raw scores keep their order and few become equal (centred isotonic regression).
    """
    from pyspark.ml.regression import IsotonicRegression

    regression = lambda: IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="n", predictionCol="prediction")
    rows = staged(held.groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n")), "toxic-held")
    ends = rows.sparkSession.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "raw double, label double, n double")
    if rows.isEmpty():
        return regression().fit(ends)
    steps = regression().fit(rows).transform(rows).groupBy("prediction").agg(F.sum(F.col("raw") * F.col("n")).alias("raw"), F.sum(F.col("label") * F.col("n")).alias("bad"), F.sum("n").alias("n"))
    points = steps.select((F.col("raw") / F.col("n")).alias("raw"), ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("label"), "n")
    inner = points.filter(f"raw > {END} AND raw < 1 - {END}")
    return regression().fit(inner.union(ends).coalesce(1))
