"""Spelling variant grouping over a variable-length gram index.

* Words and their counts come from one pass over the texts, combined on the map side; everything after works on the vocabulary.
* Gram dictionary: all grams of SHORTEST characters, and longer ones up to LONGEST where the gram without its last character occurs more than
  a FREQUENT_GRAMS-th of all grams of the vocabulary. So long lists are divided into those of longer grams, and there are at
  most FREQUENT_GRAMS such grams of a length, whatever the vocabulary holds; with the extensions over the 90 letters of the alphabet that bounds what goes to the tasks.
* Decomposition: from each place of a word the longest dictionary gram, without those that an earlier gram covers.
* Bound: one edit at a place can change a gram only if the place was read to find the gram, or one from an earlier place that can come to cover it. The most
  grams that any one edit affects are the word's bound; near words share all grams but so many, each at the same place or the next.
* List merging: in the order from rare to frequent grams, the first two shared grams of near words are among the first bound + 2 of both, so only
  pairs of these are put in lists, keyed by both grams, their places and the length of the word. A word is looked up in the lists of its own
  length and the next. Gram sets are merged as 64-bit maps: a word may miss no more grams than its bound in the other. What passes is verified by edit
  distance inside the join, so only near pairs leave it.
* Two words of which an edit may leave less than two grams are looked up in a second index, of such words only, whose
  dictionary is the shortest grams; there every word of six letters has at least three grams beyond its bound of two.

Forms are followed to the last by pointer jumping; counts grow fivefold with each step, so chains are short.

Defined results: a null text has no words; a null doc_id is written as nothing in `<doc_id>:<run>`; an empty table gives no rows; rows that repeat count; one
very long word is a word like any other; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import dropped, staged

LETTERS = "A-Za-zÀ-ÿ"
#: fixed values of the contract: one run in DEALT loses a letter; least length and count of a word; how many times its count a form has
DEALT, MIN_LENGTH, MIN_COUNT, TIMES = 199, 6, 5, 5
#: lengths of grams, the most grams of one length that are extended, and the grams of one list
SHORTEST, LONGEST, FREQUENT_GRAMS, TOGETHER = 2, 3, 3_000, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, doc_id: Column) -> Column:
    """The run without one of its letters, where crc32 of `<doc_id>:<run>` says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DEALT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs(doc_id, text) of MIN_LENGTH letters and MIN_COUNT occurrences at least."""
    # shorter runs give no word, damaged or not
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"([{LETTERS}]{{{MIN_LENGTH},}})"), F.lit(1))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(damaged(F.col("run"), F.col("doc_id")).alias("word"))
    return words.filter(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def gram_counts(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """gram, f: occurrences of every gram of SHORTEST to `longest` characters in words(word)."""
    size = F.char_length("word")
    of_length = lambda q: F.transform(F.sequence(F.lit(1), size - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))
    grams = [of_length(q) for q in range(SHORTEST, longest + 1)]
    return words.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))


@dataclass(frozen=True)
class Grams:
    """order: gram -> place from rare to frequent; deepest: length of the longest gram that begins so, for grams that longer ones begin with."""

    longest: int
    order: dict[str, int]
    deepest: dict[str, int]

    @classmethod
    def of(cls, counts: list[tuple[str, int]], longest: int) -> Grams:
        deepest: dict[str, int] = {}
        for g, _ in counts:
            for k in range(SHORTEST, len(g)):
                deepest[g[:k]] = max(deepest.get(g[:k], 0), len(g))
        return cls(longest, {g: i for i, (g, _) in enumerate(sorted(counts, key=lambda r: (r[1], r[0])))}, deepest)


def dictionary(words: DataFrame, longest: int = LONGEST, frequent_grams: int = FREQUENT_GRAMS) -> Grams:
    """The grams of words(word); with every gram its beginnings of SHORTEST characters or more are in it."""
    if longest == SHORTEST:
        kept = gram_counts(words, longest)
    else:
        counts = staged(gram_counts(words, longest), "spelling-grams")
        total = counts.filter(F.char_length("gram") == SHORTEST).agg(F.sum("f")).first()[0] or 0
        frequent = counts.filter((F.col("f") > total / frequent_grams) & (F.char_length("gram") < longest)).select(F.col("gram").alias("start"))
        longer = counts.withColumn("start", F.expr("substring(gram, 1, char_length(gram) - 1)")).join(frequent, "start", "left_semi").select("gram", "f")
        kept = counts.filter(F.char_length("gram") == SHORTEST).union(longer)
    return Grams.of([(r["gram"], r["f"]) for r in kept.collect()], longest)  # bounded by frequent_grams and the alphabet


def decompose(word: str, grams: Grams) -> tuple[list[tuple[int, int]], int]:
    """(order, place) of the grams of a word, and the most of them that one edit affects."""
    n, longest, order, deepest, end, kept, stops = len(word), grams.longest, grams.order, grams.deepest, -1, [], []
    for p in range(n - SHORTEST + 1):
        gram = word[p : p + SHORTEST]
        while gram in deepest:  # a longer gram may begin here: the next letter is read
            more = word[p : p + len(gram) + 1]
            if len(more) == len(gram) or more not in order:
                stops.append(p + len(gram))
                break
            gram = more
        else:
            stops.append(p + len(gram) - 1)
        if p + len(gram) - 1 > end:
            end = p + len(gram) - 1
            kept.append((p, end))
    starts = [a for a, _ in kept]
    most = 0
    for i in range(n + 1):
        # grams that read letter i, and how far they may reach once it is another, gone, or comes after a new one
        reach = []
        for p in range(max(0, i - longest + 1), min(i + 1, len(stops))):
            if stops[p] >= i:
                reach.append((p, p + (deepest.get(word[p:i], longest) if i - p >= SHORTEST else longest) - 1))
        other = max((r for _, r in reach), default=-1)
        before = max((r for p, r in reach if p < i), default=-1)
        replaced = gone = new = 0
        for a, b in kept[bisect_left(starts, i - longest) : bisect_right(starts, i + longest)]:
            if a > i:  # everything after i comes one place sooner if it is gone, one later after a new letter
                replaced += other >= b
                gone += before >= b - 1
                new += max(before, i + longest - 1) >= b + 1
            elif stops[a] >= i:
                replaced, gone = replaced + 1, gone + 1
                new += a < i or max(before, i + longest - 1) >= b + 1
            elif any(p < a and r >= b for p, r in reach):
                replaced, gone, new = replaced + 1, gone + 1, new + 1
        most = max(most, new, replaced if i < n else 0, gone if i < n else 0)
    return [(order[word[a : b + 1]], a) for a, b in kept], most


def listed(words: DataFrame, grams: Grams) -> DataFrame:
    """word, n, bound, beyond (grams more than the bound), bits, entries: pairs (gram, place, gram, place) of the rarest bound + 2."""
    known = words.sparkSession.sparkContext.broadcast(grams)
    entry = pa.list_(pa.struct([(c, pa.int32()) for c in ("g", "at", "h", "to")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            bounds, beyond, bits, entries = [], [], [], []
            for word in batch.column(0).to_pylist():
                found, bound = decompose(word, table)
                found.sort()
                m = 0
                for g, _ in found:
                    m |= 1 << (g * 0x9E3779B1 >> 7) % 64
                bounds.append(bound)
                beyond.append(len(found) - bound)
                bits.append(m - (1 << 64) if m >> 63 else m)
                entries.append([{"g": g, "at": a, "h": h, "to": b} for (g, a), (h, b) in combinations(found[: bound + TOGETHER], TOGETHER)])
            columns = [pa.array(bounds, pa.int32()), pa.array(beyond, pa.int32()), pa.array(bits, pa.int64()), pa.array(entries, entry)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["word", "n", "bound", "beyond", "bits", "entries"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, bound int, beyond int, bits long, entries array<struct<g: int, at: int, h: int, to: int>>")


def near_pairs(lists: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: pairs of one edit among the words of `lists` that share a list; a pair may come more than once."""
    size = F.char_length("word")
    # in a word of one letter more both grams stand where they are, or both one later, or only the later one does
    key = lambda i, j, more: F.xxhash64("e.g", F.col("e.at") + i, "e.h", F.col("e.to") + j, F.col("size") + more)
    later = F.col("e.at") > F.col("e.to")
    own = lists.select("word", "n", "bound", "bits", size.alias("size"), F.explode("entries").alias("e"))
    index = own.select(key(0, 0, 0).alias("key"), *[F.col(c).alias(f"b_{c}") for c in ("word", "n", "bound", "bits")])
    keys = F.array(key(0, 0, 0), key(0, 0, 1), key(1, 1, 1), key(later.cast("int"), (~later).cast("int"), 1))
    asked = own.select(F.explode(keys).alias("key"), *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "bound", "bits")])
    missing = lambda x, y: F.bit_count(F.col(f"{x}_bits").bitwiseAND(F.bitwise_not(F.col(f"{y}_bits")))) <= F.col(f"{x}_bound")
    longer = F.char_length("b_word") > F.char_length("a_word")
    near = (longer | (F.col("a_word") < F.col("b_word"))) & missing("a", "b") & missing("b", "a") & (F.levenshtein("a_word", "b_word", 1) == 1)
    return asked.join(index, "key").filter(near).select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def near_words(words: DataFrame, longest: int = LONGEST, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """a, a_n, b, b_n: each pair of words(word, n) that differ by exactly one edit, once."""
    lists = staged(listed(words, dictionary(words, longest, frequent_grams)), "spelling-lists")
    open_ = lists.filter(F.col("beyond") < TOGETHER).select("word", "n")
    pairs = near_pairs(lists)
    if longest > SHORTEST and not open_.isEmpty():
        again = staged(listed(open_, dictionary(open_, SHORTEST)), "spelling-short")
        pairs = pairs.union(near_pairs(again))
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that is reached from each word of forms(word, form)."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        last, now = now, staged(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        dropped(last)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, longest: int = LONGEST, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs(doc_id, text)."""
    words = staged(vocabulary(docs), "spelling-words")
    pairs = near_words(words, longest, frequent_grams)
    both = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{y}_n").alias("near_n"), F.col(y).alias("near")) for x, y in ("ab", "ba")])
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = staged(pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "spelling-near")
    full = words.join(near, "word", "left")
    has = -F.col("best.m") >= TIMES * F.col("n")
    found = full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    found = staged(found, "spelling-forms")
    joined = found.join(roots(found.filter("form IS NOT NULL")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
