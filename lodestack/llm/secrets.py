"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame operations only.

Base spans are the matches of three patterns (assignments, access keys, hexadecimal runs). Added to them are spans of
kind `random`: long tokens of an inferred encoding (hexadecimal, base32, base36, base64, or letters alone) that look like random
characters. Three tests ask for evidence against a uniform random string over the token's alphabet: chi-squared uniformity over classes of
the alphabet (common and rare letters, capitals, digits; each hexadecimal digit), runs above and below the middle of the alphabet, and
serial correlation of neighbours; Fisher's rule joins their p-values.

Which tokens are reported is decided over the whole corpus, separately per encoding and band of length. Tokens of random
characters have p-values spread evenly over (0, 1), while those of ordinary tokens crowd near 0. So the p-values above one half tell how many
random tokens there are (Storey's estimate; at most so many, with two standard errors added, so that few tokens get the benefit of the
doubt), and with that how many of the tokens above any p-value are ordinary: the
false discoveries. The cut is the least p-value above which their share is at most the band's rate; short tokens, on which the tests have
little power, have a larger one. Two levels bound the cut: below the first every token is given up (so few random ones are lost),
above the second none is (so a corpus of mostly ordinary tokens cannot take more than that share of its random ones).

A token that as a whole fits no encoding (a path with a hyphen, say) is cut at its separators in three ways (at + and /, at - and
_, at all four), and every part of 20 or more characters that fits one is judged. Of nested random parts that of the first cut is
reported; parts that cross are all reported, as any of them may be the secret.

The p-values are counted in bins of their logarithm, so the procedure needs counts per (encoding, band, bin) and never a
ranking of all tokens; at most len(ENCODINGS) * len(BANDS) cuts come back. Texts are read once and are not shuffled. Places come from
running sums by doubling steps, and overlaps from binary searches in sorted spans, so a text of very many spans takes n log n time.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are scanned each by itself; very
long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import staged


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "(?:" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + ")"
ASSIGN = NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = "^" + NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # a run of fewer never holds one of more
TOKEN = "[A-Za-z0-9+/_-]{20,}"
#: parts of a token that fits no encoding, by what they are cut at; no encoding holds separators of both pairs
PARTS = ("[A-Za-z0-9_-]{20,}", "[A-Za-z0-9+/]{20,}", "[A-Za-z0-9]{20,}")
KINDS = ("assign", "access", "hex", "random")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: the commonest letters of European languages (fixed values), and the others
_COMMON = "etaoinsrldu"
_RARE = "".join(c for c in _LOWER if c not in _COMMON)
#: name, what a token must match, its alphabet, and the classes of it that the chi-squared test counts; the first that fits is taken
ENCODINGS = (
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef", tuple(_DIGITS + "abcdef")),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF", tuple(_DIGITS + "ABCDEF")),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567", (_COMMON.upper(), _RARE.upper(), "234567")),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER, (_COMMON, _RARE, _DIGITS)),
    ("lower", "^[a-z]+$", _LOWER, (_COMMON, _RARE)),
    ("letters", "^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", _UPPER + _LOWER, (_COMMON, _RARE, _UPPER)),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", (_COMMON, _RARE, _UPPER, _DIGITS + "+/")),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", (_COMMON, _RARE, _UPPER, _DIGITS + "-_")),
)
#: least length of a band, the share of ordinary tokens among those reported that it aims at, and the two levels that bound its cut
BANDS = ((20, 0.3, 0.01, 0.2), (28, 0.2, 0.01, 0.1), (40, 0.1, 0.005, 0.05), (64, 0.05, 0.002, 0.05))
BINS_PER_E = 20
LAST_BIN = 600
#: the first bin below a p-value of one half
HALF = math.ceil(math.log(2) * BINS_PER_E)
#: more doubling steps than an array can have
STEPS = 31


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubling(n: Column) -> Column:
    """1, 2, 4, ... up to n."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(STEPS)]), lambda k: k <= n)


def _running(values: Column, join) -> Column:
    """Running join (a sum, a maximum) of an array, in doubling steps over all of it."""
    step = lambda v, k: F.transform(v, lambda x, i: F.when(i >= k, join(x, F.get(v, i - k))).otherwise(x))
    return _let(values, lambda v: F.aggregate(_doubling(F.size(v)), v, step))


def _last(sorted_: Column, below) -> Column:
    """The last place of a sorted array whose element is `below`, by binary search; -1 if none is."""
    step = lambda at, k: F.when(F.coalesce(below(F.get(sorted_, at + k)), F.lit(False)), at + k).otherwise(at)
    return F.aggregate(F.reverse(_doubling(F.size(sorted_))), F.lit(-1), step)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind, end, token>>, in code points.

    Each piece is the text from the end of one match to the end of the next, so running lengths give the places.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"\\G(?s:.*?){pattern}"), F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def placed(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, lambda p: F.char_length(p)), lambda a, b: a + b)
        tokens = F.transform(pieces, lambda p: F.regexp_extract(p, f"(?s)^.*?({pattern})$", 1))
        one = lambda end, token: F.struct((end - F.char_length(token)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), token.alias("token"))
        return F.zip_with(ends, tokens, one)

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(empty)


def base_spans(text: Column) -> Column:
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["token"], ASSIGN_VALUE, 1)) >= 12)
    access = F.filter(_spans(text, ACCESS, 1), lambda s: F.char_length(s["token"]) >= 18)
    return F.concat(assign, access, _spans(text, HEX, 2))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a normal deviate (Abramowitz and Stegun 7.1.26; fixed coefficients)."""

    def tail(x: Column) -> Column:
        poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.greatest(_let(1 / (1 + F.lit(0.3275911) * x), poly) * F.exp(-x * x), F.lit(1e-7))

    return _let(F.abs(z) / F.lit(2**0.5), tail)


def _chi_squared(token: Column, n: Column, classes: tuple[str, ...]) -> Column:
    """One-sided p-value of uniformity over classes of the alphabet, by the Wilson-Hilferty deviate."""
    m, dof = sum(map(len, classes)), len(classes) - 1

    def cell(c: str) -> Column:
        rest = F.char_length(F.regexp_replace(token, "[" + c.replace("-", "\\-") + "]", ""))
        return F.pow(n - rest, F.lit(2.0)) * float(m / len(c)) / n

    ratio = F.greatest(reduce(Column.__add__, map(cell, classes)) - n, F.lit(0.0)) / float(dof)
    z = (F.pow(ratio, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / (2 / (9 * dof)) ** 0.5
    upper = lambda z: _let(_normal_tail(z) / 2, lambda h: F.when(z > 0, h).otherwise(1 - h))
    return F.greatest(_let(z, upper), F.lit(1e-7))


def _runs(codes: Column, n: Column, m: int) -> Column:
    above = F.size(F.filter(codes, lambda c: c >= m / 2)).cast("double")
    high = lambda i: F.get(codes, i) >= m / 2
    crossings = F.size(F.filter(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: high(i) != high(i - 1)))

    def test(pairs: Column) -> Column:
        var = pairs * (pairs - n) / (n * n * (n - 1))
        return F.when(var > 0, _normal_tail((crossings - pairs / n) / F.sqrt(var))).otherwise(F.lit(1e-7))

    return _let(above, lambda a: _let(2 * a * (n - a), test))


def _serial(codes: Column, n: Column) -> Column:
    def test(mean: Column) -> Column:
        about = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        next_to = F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda a, i: a + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean))
        return _let(about, lambda v: F.when(v > 0, _normal_tail((next_to / v + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-7)))

    return _let(F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n, test)


def randomness(token: Column) -> Column:
    """struct<encoding, p>: the inferred encoding (null if none) and the joined p-value of its tests."""
    out = None
    n = F.char_length(token).cast("double")
    fisher = lambda x: F.exp(-x) * (1 + x + x * x / 2)  # noqa: E731  three tests
    for name, fits, alphabet, classes in ENCODINGS:
        uniform = -F.log(_chi_squared(token, n, classes))
        joined = lambda c, m=len(alphabet), u=uniform: _let(u - F.log(_runs(c, n, m)) - F.log(_serial(c, n)), fisher)
        found = F.struct(F.lit(name).alias("encoding"), _let(_codes(token, alphabet), _bind(joined)).alias("p"))
        out = F.when(token.rlike(fits), found) if out is None else out.when(token.rlike(fits), found)
    return out


def _bind(f):
    """A one-parameter function: a second parameter would be taken for the element's index."""
    return lambda x: f(x)


def _codes(token: Column, alphabet: str) -> Column:
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(letters, lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("double"))


def _band(length: Column) -> Column:
    out = F.lit(BANDS[0][0])
    for least, *_ in BANDS[1:]:
        out = F.when(length >= least, F.lit(least)).otherwise(out)
    return out


def _fits(token: Column) -> Column:
    return reduce(Column.__or__, [token.rlike(fits) for _, fits, *_ in ENCODINGS])


def _candidates(token: Column) -> Column:
    """The token itself if it fits an encoding, else its parts that do: an array of sorted spans for each cut of PARTS."""

    def parts(pattern: str) -> Column:
        moved = lambda s: F.struct((token["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), (token["start"] + s["end"]).alias("end"), s["token"].alias("token"))
        return F.filter(F.transform(_spans(token["token"], pattern, 3), moved), lambda t: _fits(t["token"]))

    def cuts(a: Column, b: Column, both: Column) -> Column:  # a part that two cuts share is judged once
        other = lambda mine, s: F.get(mine, _last(mine, lambda x: x["start"] <= s["start"]))
        new = lambda mine, spans: F.filter(spans, lambda s: ~F.coalesce((other(mine, s)["start"] == s["start"]) & (other(mine, s)["end"] == s["end"]), F.lit(False)))
        return F.array(a, new(a, b), new(b, new(a, both)))

    cut = _let(parts(PARTS[0]), lambda a: _let(parts(PARTS[1]), lambda b: _let(parts(PARTS[2]), lambda both: cuts(a, b, both))))
    return F.when(_fits(token["token"]), F.array(F.array(token))).otherwise(cut)


def _apart(cuts: Column) -> Column:
    """The spans of a token's cuts (sorted and apart in each) that neither hold one of an earlier cut nor lie in one."""

    def alone(done: Column, spans: Column) -> Column:
        def clear(s: Column) -> Column:
            upto = F.get(done, _last(done, lambda x: x["start"] <= s["start"]))
            inside = F.get(done, _last(done, lambda x: x["end"] <= s["end"]))
            return ~(F.coalesce(upto["end"] >= s["end"], F.lit(False)) | F.coalesce(inside["start"] >= s["start"], F.lit(False)))

        return F.filter(spans, clear)

    second = lambda a: _let(alone(a, F.coalesce(F.get(cuts, F.lit(1)), F.slice(a, 1, 0))), lambda b: F.concat(a, b, alone(b, alone(a, F.coalesce(F.get(cuts, F.lit(2)), F.slice(a, 1, 0))))))
    return _let(F.get(cuts, F.lit(0)), second)


def _free(spans: Column, base: Column, reach: Column) -> Column:
    """Those of `spans` that no base span overlaps; base is sorted by start, and reach is the furthest end so far at each."""

    def clear(t: Column) -> Column:
        return ~F.coalesce(F.get(reach, _last(base, lambda b: b["start"] < t["end"])) > t["start"], F.lit(False))

    return F.filter(spans, clear)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans, sorted), tested (per token and cut its candidates with encoding, band and bin of the p-value); one row per document.

    The texts are read once; what the patterns find in them is written before tokens are tested.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), _spans(text, TOKEN, 3).alias("tokens"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    reach = _running(F.transform("base", lambda b: b["end"]), lambda a, b: F.greatest(a, b))
    found = staged(found.withColumn("base", F.array_sort(base)).withColumn("reach", reach), "secrets-found")
    # whole tokens that overlap a base span hold candidates that do not
    cuts = F.flatten(F.transform("tokens", lambda t: F.array(_candidates(t))))
    judge = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), randomness(t["token"]).alias("r"))
    judged = F.transform(cuts, lambda c: F.transform(c, lambda spans: F.transform(_free(spans, F.col("base"), F.col("reach")), judge)))
    test = lambda t: F.struct(
        t["start"].alias("start"),
        t["end"].alias("end"),
        F.concat_ws("/", t["r"]["encoding"], _band(t["end"] - t["start"]).cast("string")).alias("family"),
        F.least(F.floor(-F.log(t["r"]["p"]) * BINS_PER_E), F.lit(LAST_BIN)).cast("int").alias("bin"),
    )
    tested = F.transform(F.filter("judged", lambda c: F.exists(c, lambda spans: F.size(spans) > 0)), lambda c: F.transform(c, lambda spans: F.transform(spans, test)))
    return found.select("doc_id", "base", judged.alias("judged")).select("doc_id", "base", tested.alias("tested"))


def thresholds(scanned: DataFrame) -> dict[str, int]:
    """family -> the first bin that is given up: see the rule of false discoveries above. A row per encoding and band at most comes back."""
    counts = scanned.select(F.explode(F.flatten(F.flatten("tested"))).alias("t")).groupBy("t.family", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    family = Window.partitionBy("family")
    upto = family.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    half = 1 - math.exp(-HALF / BINS_PER_E)
    upper = F.coalesce(F.sum(F.when(F.col("bin") < HALF, F.col("n"))).over(family), F.lit(0)) + 1
    random = (upper + 2 * F.sqrt(upper)) / F.lit(half)
    band = F.create_map(*[F.lit(x) for least, *rates in BANDS for x in (str(least), F.array(*map(F.lit, rates)))])
    rated = counts.withColumn("rates", F.element_at(band, F.split("family", "/")[1])).withColumn("above", F.sum("n").over(upto)).withColumn("random", random)
    edge = F.exp(-(F.col("bin") + 1) / F.lit(float(BINS_PER_E)))
    false = 1 - F.col("random") * (1 - edge) / F.col("above")
    given_up = lambda p: F.ceil(-F.log(p) * BINS_PER_E)
    cut = rated.groupBy("family", "rates").agg(F.coalesce(F.max(F.when(false <= F.col("rates")[0], F.col("bin") + 1)), F.lit(0)).alias("cut"))
    cut = cut.select("family", F.greatest(F.least("cut", given_up(F.col("rates")[1])), given_up(F.col("rates")[2])).cast("int").alias("cut"))
    return {r["family"]: r["cut"] for r in cut.collect()}


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind), n_random."""
    scanned = staged(scan(docs), "secrets-scan")
    cut = thresholds(scanned)
    limit = F.create_map(*[F.lit(x) for f, b in cut.items() for x in (f, b)]) if cut else F.create_map().cast("map<string,int>")
    random = lambda t: t["bin"] < F.coalesce(F.element_at(limit, t["family"]), F.lit(LAST_BIN + 1))
    kept = F.transform("tested", lambda c: _apart(F.transform(c, lambda spans: F.filter(spans, random))))
    added = F.transform(F.flatten(kept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
