"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source.

Every document has counts (base rules judge those) and a vector of transformed statistics. For each group of language and
source the location and scatter of the tightest share H of its vectors are estimated (minimum covariance
determinant), and documents far from it by Mahalanobis distance are rejected. The statistics vary in ordinary text
too (rates of marks and capitals, word lengths, variety), so the scatter is estimated on every axis. PSEUDO words of a common text
are added to each document, since rates of a few words say little.

The estimate covers all rows of a group and runs as aggregations: two deterministic starts (medians with quartile
scales; spatial signs), then concentration steps, each of which finds the H quantile of the distances from counts in
narrow bins and sums the moments of the rows up to it. After BOTH_STARTS steps the start with the smaller determinant goes on alone, and
a group's steps end when its own determinant falls no more. Only counts and whole-numbered sums leave a task, so one group may hold any part of all rows, and reruns agree.

Small groups borrow: estimates are also made per language and over all, and a group of n rows takes n parts of its own estimate and
BORROW parts of its language's, which has taken as many of the whole's. Behind all stands a broad PRIOR scale of as little weight.

Defined results: null text has no words (base_failed); null language and null source are groups of their own; rows that
repeat count each; documents that fail the base rules take no part in the estimates; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WHITE_BYTES, dropped, maybe_broadcast, small_batches, staged, without

WINDOW = 5
H = 0.75
#: rows' worth of the wider group's estimate that each group takes
BORROW = 50
#: steps that both starts take
BOTH_STARTS = 2
#: a group's steps end when the logarithm of its determinant falls by less than this; exact steps never raise it, and those over bins by
#: a row or two at the edge, so MAX_STEPS is not met (groups that do meet it are told of in a warning)
TOLERANCE, MAX_STEPS = 0.005, 40
#: rows of a group from which its model is always broadcast: there are few such groups, and a join by their names would put each in one task
LARGE = 5_000_000
#: Chi-squared tail beyond which a document is rejected; at sf0.1 it rejects 0.1 % of the documents labelled good.
TAIL = 1e-9
#: bins in a doubling of the squared distance, and in a unit of a statistic
DISTANCE_BINS, VALUE_BINS = 128, 256
#: deviations are summed as whole numbers of 1 / UNIT
UNIT = 4096.0
PSEUDO = 50
#: transformed statistics, and the scale of each that stands behind the smallest tables
STATS = ("log_words", "log_word_length", "log_marks", "log_capitals", "log_variety")
PRIOR = (1.0, 0.15, 0.4, 0.4, 0.3)
#: the least spread of a group in any direction, in these scales: directions in which statistics follow from the others in nearly all of its texts (no
#: capitals at all, say) get it, the others keep their own
RIDGE = (0.2, 0.015, 0.1, 0.1, 0.05)
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct")
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    bits = max(1, (len(known) - 1).bit_length())
    if bits * size <= 63:
        code = ids[:n].copy()
        for k in range(1, size):
            code = (code << bits) | ids[k : k + n]
    else:  # rank prefixes, one more word at a time, so that codes stay exact
        code = ids[:n]
        for k in range(1, size):
            code = np.unique(code * len(known) + ids[k : k + n], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    full = [x for x in raw.split(b"\n") if x.strip(WHITE_BYTES)]
    return (
        len(words),
        len(text) - (len(raw) - sum(map(len, words))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(full) - len(set(full)),
        repeated_words(words),
        len(full),
        len(raw) - len(raw.translate(None, _CAPITALS)),
        len(raw) - len(raw.translate(None, _MARKS)),
        len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and the transformed statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=["doc_id", "lang", "source", *COUNTS])

    small_batches(docs.sparkSession)
    raw = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(lang AS STRING) AS lang", "CAST(source AS STRING) AS source", "text")
    counted = raw.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    n, chars = F.col("n_words"), F.col("word_chars")
    vector = {
        "log_words": F.log(n + float(PSEUDO)),
        "log_word_length": F.log((chars + 5.0 * PSEUDO) / (n + PSEUDO)),
        "log_marks": F.log((F.col("n_marks") + 3.0) / (chars + 100)),
        "log_capitals": F.log((F.col("n_capitals") + 3.0) / (chars + 100)),
        "log_variety": F.log((F.col("n_distinct") + float(PSEUDO)) / (n + PSEUDO)),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumns(vector)


def chi2_cdf(x: float, dof: int) -> float:
    """By the series of the incomplete gamma function."""
    a, h, k = dof / 2, x / 2, 0
    if h <= 0:
        return 0.0
    term = total = 1 / a
    while term > 1e-17 * total:
        k += 1
        term *= h / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return high


#: Makes the scatter of the tightest H of normal vectors unbiased.
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)
LEVELS = ("whole", "of_lang", "of_source")
MODEL = "g string, start int, n long, mean array<double>, scatter array<double>, precision array<double>, logdet double"


def _full(packed) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, packed, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _row(g: str, start: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    """A model's row; a hair's breadth on the diagonal lets a group of equal rows have a determinant."""
    scatter = scatter + 1e-8 * np.eye(P)
    inverse = np.linalg.inv(scatter)
    precision = [float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS]
    return (g, start, int(n), [float(x) for x in mean], [float(scatter[i, j]) for i, j in PAIRS], precision, float(np.linalg.slogdet(scatter)[1]))


def _models(rows: DataFrame, make: Callable[[tuple], list[tuple]]) -> DataFrame:
    """Models from small tables of sums; `make` gives MODEL rows for one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([m for r in f.itertuples(index=False) for m in make(r)], columns=[x.split()[0] for x in MODEL.split(", ")])

    return rows.mapInPandas(run, MODEL)


def _sums(xs: list[Column]) -> list[Column]:
    """Exact sums of whole numbers: count, first and second moments."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x) for x in xs]).alias("s1"),
        F.array(*[F.sum(xs[i] * xs[j]) for i, j in PAIRS]).alias("s2"),
    ]


def _distance() -> Column:
    gaps = [F.col(x) - F.col("mean")[i] for i, x in enumerate(STATS)]
    return reduce(Column.__add__, [F.col("precision")[k] * gaps[i] * gaps[j] for k, (i, j) in enumerate(PAIRS)])


def _names() -> dict[str, Column]:
    """A name for each level's group; null is a value like any other."""
    name = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    return {"whole": F.lit("whole"), "of_lang": name("lang"), "of_source": name("lang", "source")}


def _quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys and, for each name, the least bin up to which that share of the key's rows lies; exact on bins."""
    of = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of))
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))).alias(name) for name, q in wanted.items()])


def _centre(vectors: DataFrame) -> DataFrame:
    """g, mid, scale: medians, and quartile ranges as standard deviations (at least a bin)."""
    stats = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * VALUE_BINS).alias("bin")) for i, x in enumerate(STATS)]))
    q = _quantiles(vectors.select("g", stats.alias("s")).select("g", "s.i", "s.bin"), ["g", "i"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    scale = F.greatest(F.col("high") - F.col("low"), F.lit(1)) / (1.349 * VALUE_BINS)
    each = q.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("mid") + 0.5) / VALUE_BINS).alias("mid"), scale.alias("scale")))).alias("s"))
    return each.select("g", F.col("s.mid").alias("mid"), F.col("s.scale").alias("scale"))


def _with(rows: DataFrame, table: DataFrame, keys: list[str], limit: int, large: DataFrame) -> DataFrame:
    """rows joined to a table of one row for each group: broadcast up to `limit` rows; beyond it the rows of `large` groups (g) are, the others shuffle."""
    small = maybe_broadcast(table, limit)
    if small is not table:
        return rows.join(small, keys)
    few = F.broadcast(large)
    return rows.join(F.broadcast(table.join(few, "g", "left_semi")), keys).unionByName(rows.join(few, "g", "left_anti").join(table, keys))


def estimate(vectors: DataFrame, n_groups: int) -> DataFrame:
    """One row (MODEL) per group g of `vectors` (g and STATS): the minimum covariance determinant estimate; n counts the group's rows."""
    centre = staged(_centre(vectors), "mcd-centre", n_groups)
    # second start: the scatter of the directions from the centre
    z = [(F.col(x) - F.col("mid")[i]) / F.col("scale")[i] for i, x in enumerate(STATS)]
    norm = F.greatest(F.sqrt(reduce(Column.__add__, [v * v for v in z])), F.lit(1e-9))
    signed = vectors.join(maybe_broadcast(centre, 50_000), "g").select("g", *[F.round(v / norm * UNIT).cast("long").alias(x) for v, x in zip(z, STATS, strict=True)])
    signs = signed.groupBy("g").agg(*_sums([F.col(x) for x in STATS])).join(centre, "g")

    def begin(r: tuple) -> list[tuple]:
        sign = _full(r.s2) / r.n / UNIT**2
        shapes = (np.eye(P), P * sign + 0.05 * np.eye(P))
        return [_row(r.g, start, r.n, np.array(r.mid), shape * np.outer(r.scale, r.scale)) for start, shape in enumerate(shapes)]

    def solve(r: tuple) -> list[tuple]:
        mean = np.array(r.s1) / r.n
        return [_row(r.g, r.start, r.n_all, np.array(r.mean) + mean / UNIT, CONSISTENCY * (_full(r.s2) / r.n - np.outer(mean, mean)) / UNIT**2)]

    columns = [c.split()[0] for c in MODEL.split(", ")]
    least = lambda df: df.groupBy("g").agg(F.min_by(F.struct(*columns[1:]), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
    moving, settled = staged(_models(signs, begin), "mcd-start", n_groups), None
    large = staged(moving.filter(F.col("n") >= LARGE).select("g").distinct(), "mcd-large", n_groups)
    for step in range(MAX_STEPS):
        bin_ = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * DISTANCE_BINS)
        whole = [F.round((F.col(x) - F.col("mean")[i]) * UNIT).cast("long").alias(x) for i, x in enumerate(STATS)]
        far = _with(vectors, moving.select("g", "start", "mean", "precision"), ["g"], 20_000, large).select("g", "start", *whole, bin_.alias("bin"))
        edge = staged(_quantiles(far, ["g", "start"], {"edge": H}), "mcd-edge", n_groups)
        near = _with(far, edge, ["g", "start"], 50_000, large).filter("bin <= edge")
        sums = near.groupBy("g", "start").agg(*_sums([F.col(x) for x in STATS]))
        before = moving.select("g", "start", "mean", F.col("n").alias("n_all"), F.col("logdet").alias("was"))
        after = _models(sums.join(before, ["g", "start"]), solve)
        if step == BOTH_STARTS - 1:
            after = least(after)
        after = staged(after.join(before.select("g", "start", "was"), ["g", "start"]), "mcd-step", n_groups)
        dropped(edge)
        falls = F.col("was") - F.col("logdet") > TOLERANCE if step >= BOTH_STARTS else F.lit(True)
        done, moving = after.filter(~falls).select(columns), after.filter(falls).select(columns)
        settled = done if settled is None else settled.union(done)
        if moving.isEmpty():
            break
    else:
        warnings.warn(f"{moving.count()} groups were still moving after {MAX_STEPS} steps", stacklevel=2)
    return settled.union(moving)


def lifted(scatter: np.ndarray, least=RIDGE) -> np.ndarray:
    """The scatter with the variance of its degenerate directions, those below one in units of `least`, raised to one."""
    scale = np.outer(least, least)
    values, vectors = np.linalg.eigh(scatter / scale)
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * scale


def borrow(models: DataFrame, groups: DataFrame, prior=PRIOR) -> DataFrame:
    """of_source, mean, precision: each group's estimate with its share of its language's and the whole's.

    models: MODEL rows of all levels; groups: the names of LEVELS, one row for each group of a source.
    """
    joined = groups
    for level in LEVELS:
        joined = joined.join(models.select(F.col("g").alias(level), *[F.col(c).alias(f"{level}_{c}") for c in ("n", "mean", "scatter")]), level)

    def mix(r: tuple) -> list[tuple]:
        mean, scatter = None, np.diag(np.square(prior))
        for level in LEVELS:
            n, own, around = (getattr(r, f"{level}_{c}") for c in ("n", "mean", "scatter"))
            own = np.array(own)
            mean = own if mean is None else (n * own + BORROW * mean) / (n + BORROW)
            scatter = (n * _full(around) + BORROW * scatter) / (n + BORROW)
        return [_row(r.of_source, 0, n, mean, lifted(scatter))]

    return _models(joined, mix).select(F.col("g").alias("of_source"), "mean", "precision")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, group_name."""
    stats = staged(statistics(docs).withColumns(_names()), "mcd-stats")
    good = stats.filter("not base_failed")
    groups = staged(good.select(*LEVELS).distinct(), "mcd-groups")
    n_groups = 2 * groups.count() + 2  # all levels together have at most so many
    vectors = good.select(F.explode(F.array(*LEVELS)).alias("g"), *STATS)
    models = staged(estimate(vectors, 2 * n_groups), "mcd-models", n_groups)
    model = staged(borrow(models, groups), "mcd-model", n_groups)
    dropped(models, groups)
    judged = stats.join(maybe_broadcast(model, 20_000), "of_source", "left")
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= cutoff))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2", F.col("of_source").alias("group_name")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected ones; columns stay as they are. Rows that share a doc_id go if any of them is rejected."""
    return without(docs, staged(quality_rules(docs).filter("not kept").select("doc_id").distinct(), "mcd-gone"))
