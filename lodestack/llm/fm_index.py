"""Substring deduplication with a compressed FM-index per shard.

A window is WINDOW consecutive words of a document. A word is removed if a window covers it whose words also start
in a document with a smaller identifier; windows are judged on the input, not on what is left.

Sharding. Each window belongs to the least hash (minimizer) among its runs of GRAM words, so equal windows belong together
wherever they stand. Neighbouring windows with one minimizer form a segment, about half a dozen windows long. Pass one counts
the documents of each minimizer; a minimizer of one document holds no repeated window. Those of two documents or more pass as
a bitmap of a bounded size, in which a false bit costs work, never a result. Pass two cuts the segments and deals them
to shards by minimizer. Of minimizers in very many documents the equal segments are first joined, on the map side, so that
their shards get each distinct segment once, with the least identifier that has it, however many documents share it. A minimizer whose
distinct segments alone outgrow a shard (a common passage between ever different neighbours) is dealt window by window, over as
many tasks as there are windows.

In a shard. The distinct segments are the text of an FM-index: suffixes are sorted by prefix doubling as far as a window
reaches, and the Burrows-Wheeler transform is a wavelet tree (by levels) of packed bits with block counts. The segments
are streamed through it: backward search from every position gives matching statistics up to the window
length (a search whose interval holds one suffix has only found itself and ends), and where they reach it the suffix
interval gives the least identifier that has the window. The shard returns the intervals of each document.

Defined results: null and empty texts have no words; documents shorter than a window lose nothing; a null doc_id is neither smaller nor
greater than any; rows that repeat a doc_id are one document to each other (its windows do not remove its own) and each row is cut by
itself; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import dropped, maybe_broadcast, small_batches, staged

WINDOW = 13
GRAM = 5
#: words of distinct segments in one shard, about
SHARD_WORDS = 600_000
#: equal segments of minimizers in more documents than this are joined before they are dealt (in more, if there are over MOST_FREQUENT of those)
FREQUENT, MOST_FREQUENT = 2_000, 4_000_000
#: keys of a join with more rows than this are broadcast (with more, if there are over MOST_COMMON of those), the others shuffled
COMMON, MOST_COMMON = 5_000, 100_000
SEGMENT_WINDOWS = 64
BITMAP_BITS = (1 << 16, 1 << 29)
#: 64-bit words of a bitmap that come to the driver as one row
CHUNK_WORDS = 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def _roll(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` values; the last size - 1 places hold no whole run."""
    out = h.copy()
    for k in range(1, size):
        out[:-k] *= np.uint64(0x100000001B3)
        out[:-k] += h[k:]
    return _mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BASE = 0x9E6C63D0876A9A35  # odd, so it has an inverse modulo 2**64


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            back = pow(_BASE, -1, 1 << 64)
            cls.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, _BASE, np.uint64)))
            cls.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(size, back, np.uint64)))
        return cls.up, cls.down


class Minimizers:
    """Windows of many documents at once: where words and documents start, and each window's minimizer.

    A word's hash is a polynomial in its bytes, from running sums over the whole buffer.
    """

    def __init__(self, texts: list[str | None]):
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = b"\n".join(raws) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.first, self.last = edge[::2], edge[1::2]  # a word's bytes; the buffer ends in white space
        n = len(self.first)
        up, down = _Powers.of(len(buf))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(7)) * up[: len(buf)])])
        self.h = _mix((sums[self.last] - sums[self.first]) * down[self.first])
        bounds = np.cumsum([len(r) + 1 for r in raws])
        upto = np.searchsorted(self.first, bounds)
        self.sizes = np.diff(upto, prepend=0)
        self.starts = upto - self.sizes
        self.doc = np.repeat(np.arange(len(raws), dtype=np.int32), self.sizes)
        self.whole = np.zeros(n, bool)
        if n >= WINDOW:
            self.whole[: n - WINDOW + 1] = self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :]
        least, span = _roll(self.h, GRAM), 1
        grams = WINDOW - GRAM + 1
        while span < grams:  # the least of `span` runs, doubled until a window's runs are covered
            step = min(span, grams - span)
            least[: n - step] = np.minimum(least[: n - step], least[step:])
            span += step
        self.least = least

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and minimizer of each run of windows with one minimizer."""
        at = np.flatnonzero(self.whole)
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        v = self.least[at]
        new = np.ones(len(at), bool)
        new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)  # between documents places are left out
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(at)))
        if size.max() > SEGMENT_WINDOWS:  # runs of one minimizer that go on for long are cut
            nth = np.arange(len(at)) - np.repeat(run, size)
            run = np.flatnonzero(nth % SEGMENT_WINDOWS == 0)
            size = np.diff(np.append(run, len(at)))
        return at[run], size, v[run]

    def cut(self, first: np.ndarray, windows: np.ndarray) -> list[bytes]:
        """The words of segments, joined by one blank."""
        data = self.data
        a, z = self.first[first].tolist(), self.last[first + windows + (WINDOW - 2)].tolist()
        return [b" ".join(data[x:y].split()) for x, y in zip(a, z, strict=True)]


def _chunks(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def minimizers(docs: DataFrame) -> DataFrame:
    """v, n: a minimizer and how many documents of a batch have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _chunks(batch):
                m = Minimizers(b.column(1).to_pylist())
                first, _, v = m.segments()
                d = b.column(0).to_numpy(zero_copy_only=False)[m.doc[first]]
                order = np.lexsort((d, v))
                v, d = v[order], d[order]
                once = np.ones(len(v), bool)
                once[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                v = v[once]
                start = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
                n = np.diff(np.append(start, len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(v[start].view(np.int64)), pa.array(n, pa.int64())], names=["v", "n"])

    return docs.mapInArrow(run, "v long, n long")


def bitmap(counted: DataFrame, bits: int) -> np.ndarray:
    """The minimizers of several documents as packed 64-bit words. The size is fixed by `bits`.

    Words are put together by tasks, so the driver gets bits / 8 bytes in few rows, whatever the number of minimizers.
    """
    place = F.pmod("v", F.lit(bits))
    one = F.expr("shiftleft(1L, CAST(pmod(v, 64) AS INT))")
    words = counted.groupBy((F.shiftright(place, 6)).cast("int").alias("w")).agg(F.bit_or(one).alias("some"))
    side = CHUNK_WORDS

    def pack(table: pa.Table) -> pa.Table:
        table, out = table.combine_chunks(), np.zeros(side, np.int64)
        out[table["w"].to_numpy() % side] = table["some"].to_numpy()
        return pa.table({"chunk": pa.array([int(table["w"][0].as_py()) // side], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    chunks = words.groupBy(F.floor(F.col("w") / side).alias("c")).applyInArrow(pack, "chunk int, bits binary").toArrow()
    out = np.zeros(max(side, bits >> 6), np.int64)
    for chunk, raw in zip(chunks["chunk"].to_pylist(), chunks["bits"], strict=True):
        out[chunk * side : (chunk + 1) * side] = np.frombuffer(raw.as_py(), np.int64)
    return out[: bits >> 6].view(np.uint64)


def frequent_minimizers(counted: DataFrame) -> np.ndarray:
    """The sorted minimizers of more than FREQUENT documents, MOST_FREQUENT at most."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") > max(FREQUENT, total // MOST_FREQUENT)).select("v").toArrow()
    return np.sort(rows["v"].to_numpy().view(np.uint64))


def _has(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    place = v & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63))) & np.uint64(1) == 1


PLACES = "doc_id long, text_key long, start int, windows int, deal long, segment binary, digest binary"


def places(docs: DataFrame, shared) -> DataFrame:
    """Every segment that may hold a repeated window, with its place; `shared` is the broadcast bitmap and frequent minimizers.

    Only segments of frequent minimizers have a digest.
    """
    names = [x.split()[0] for x in PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        some, often = shared.value
        for batch in batches:
            for b in _chunks(batch):
                m = Minimizers(b.column(1).to_pylist())
                first, size, v = m.segments()
                keep = _has(some, v)
                first, size, v = first[keep], size[keep], v[keep]
                hot = (often[np.minimum(np.searchsorted(often, v), len(often) - 1)] == v) if len(often) else np.zeros(len(v), bool)
                words = m.cut(first, size)
                digests = [xxhash.xxh3_128_digest(w) if h else None for w, h in zip(words, hot.tolist(), strict=True)]
                doc = m.doc[first]
                ids, keys = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[doc] for i in (0, 2))
                cols = [pa.array(ids), pa.array(keys), pa.array((first - m.starts[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(_mix(v).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.binary()), pa.array(digests, pa.binary())], names=names)

    return docs.mapInArrow(run, PLACES)


class WaveletTree:
    """Rank over a sequence of symbols: one level per bit, packed in 32-bit words with counts before each word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now, every = symbols, np.arange(1 << bits, dtype=np.int32)
        self.start = np.zeros(1 << bits, np.int32)  # where a symbol's own run starts below the last level
        for level in range(bits - 1, -1, -1):
            ones = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-len(ones) % 32 + 32, bool)), bitorder="little").view(np.uint32)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = np.int32(len(now) - ones.sum())
            self.levels.append((level, packed, before, zeros))
            self.start = self._down(self.levels[-1], every, self.start)
            now = np.concatenate([now[~ones], now[ones]])

    @staticmethod
    def _down(level: tuple, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        bit, packed, before, zeros = level
        word = at >> 5
        below = packed[word] & ((np.uint32(1) << (at & 31).astype(np.uint32)) - np.uint32(1))
        ones = before[word] + np.bitwise_count(below)
        return np.where((symbol >> bit) & 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = self.start[symbol]
        for level in self.levels:
            at = self._down(level, symbol, at)
        return at - start


class FMIndex:
    """Segments of symbols >= 1, with 0 after each; suffixes are sorted by at least `reach` symbols."""

    def __init__(self, text: np.ndarray, reach: int):
        self.text, n = text, len(text)
        rank, span = text.astype(np.int64), 1
        while True:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            span *= 2
            if span >= reach or rank[order[-1]] == n - 1:
                break
        self.suffixes = order
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max(initial=1)).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 2))]).astype(np.int32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step for many intervals at once."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.before[symbol]
        return start + both[: len(low)], start + both[len(low) :]

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, limit: int, alone: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end place in `stream`: the longest match to its left (up to `limit`), and its suffix interval.

        A search stops early once its interval has at most `alone` suffixes.
        """
        low, high = np.zeros(len(ends), np.int32), np.full(len(ends), len(self.text), np.int32)
        length, live = np.zeros(len(ends), np.int32), np.arange(len(ends))
        for k in range(limit):
            at = ends[live] - k
            known = (at >= 0) & (stream[at] > 0)
            live, symbol = live[known], stream[at[known]]
            lo, hi = self.extend(symbol, low[live], high[live])
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
            low[live], high[live], length[live] = lo, hi, k + 1
            live = live[hi - lo > alone]
        return length, low, high


def shard_flags(segments: pa.Array, ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the distinct segments, in order: is it also in a segment with a smaller identifier? And windows per segment."""
    coded = pc.split_pattern(segments.cast(pa.large_string()), " ")
    sizes = np.diff(coded.offsets.to_numpy())
    symbols = coded.values.dictionary_encode().indices.to_numpy().astype(np.int32) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(symbols) + len(sizes), np.int32)
    text[np.arange(len(symbols)) + owner] = symbols
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    index = FMIndex(text, window)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    n_windows = sizes - window + 1
    ends = np.repeat(first + window - 1 - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    length, low, high = index.matching_statistics(text, ends, window, alone=1)
    again = np.flatnonzero(length == window)  # the others have found only themselves
    flags = np.zeros(len(ends), bool)
    if len(again):
        by_suffix = np.append(ids[of[index.suffixes]], np.iinfo(np.int64).max)
        starts, back = np.unique(low[again], return_inverse=True)
        stops = np.empty(len(starts), np.int64)
        stops[back] = high[again]
        least = np.minimum.reduceat(by_suffix, np.column_stack([starts, stops]).ravel())[::2]
        flags[again] = least[back] < np.repeat(ids, n_windows)[again]
    return flags, n_windows


FOUND = "doc_id long, text_key long, start int, windows int, flags binary, digest binary"


def judged(dealt: DataFrame) -> DataFrame:
    """From (shard, doc_id, text_key, start, segment, digest): the rows with repeated windows.

    flags has a byte per window; it is null where all windows are in a smaller document.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        coded = table["segment"].chunk(0).dictionary_encode()
        code, docs = coded.indices.to_numpy(), table["doc_id"].to_numpy()
        ids = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(ids, code, docs)
        flags, n = shard_flags(coded.dictionary, ids)
        stop = np.cumsum(n)
        some = np.add.reduceat(flags, stop - n) > 0
        raw = flags.astype(np.uint8).tobytes()
        later = docs > ids[code]
        keep = np.flatnonzero(later | some[code])
        cells = [None if late else raw[z - k : z] for late, z, k in zip(later[keep].tolist(), stop[code[keep]].tolist(), n[code[keep]].tolist(), strict=True)]
        kept = table.take(pa.array(keep))
        cols = [kept["doc_id"], kept["text_key"], kept["start"], pa.array(n[code[keep]].astype(np.int32)), pa.array(cells, pa.binary()), kept["digest"]]
        return pa.table(cols, names=[x.split()[0] for x in FOUND.split(", ")])

    return dealt.groupBy("shard").applyInArrow(run, FOUND)


def joined(many: DataFrame, one: DataFrame, key: str, rows: int) -> DataFrame:
    """many joined with one(key, n, ...), where n counts the rows of many: common keys by broadcast, so no task gets one whole."""
    limit = max(COMMON, rows // MOST_COMMON)  # so at most MOST_COMMON keys are common
    common, rest = one.filter(F.col("n") > limit).drop("n"), one.filter(F.col("n") <= limit).drop("n")
    others = many.join(F.broadcast(common.select(key)), key, "left_anti")
    return many.join(F.broadcast(common), key).unionByName(others.join(rest, key))


def window_flags(distinct: DataFrame) -> DataFrame:
    """digest, flags of distinct segments (digest, segment, lo), by their windows: equal windows are joined on the map side, byte for byte."""
    words = F.split(F.col("segment").cast("string"), " ")
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " "))
    windows = staged(distinct.select("digest", "lo", F.posexplode(F.get(F.transform(F.array(words), lambda w: each(w)), F.lit(0))).alias("at", "w")), "fm-windows")
    least = staged(windows.groupBy("w").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n")), "fm-least")
    byte = F.when(F.col("least") < F.col("lo"), "01").otherwise("00")
    of = joined(windows, least, "w", windows.count()).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", byte.alias("byte")))).alias("f"))
    return of.filter(F.exists("f", lambda x: x["byte"] == "01")).select("digest", F.unhex(F.array_join(F.col("f.byte"), "")).alias("flags"))


def cut_texts(docs: DataFrame) -> DataFrame:
    """From doc_id, text, found (array of start, windows, flags): what is left of each text."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(1), b.column(2), strict=True):
                t = t.as_py()
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                n, found = len(words), found.as_py()
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    for f in found:
                        at = f["start"] + (np.flatnonzero(np.frombuffer(f["flags"], np.uint8)) if f["flags"] is not None else np.arange(f["windows"]))
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + WINDOW, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                left = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    known = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counted = staged(minimizers(known.select("doc_id", "text")).groupBy("v").agg(F.sum("n").alias("n")).filter("n > 1"), "fm-minimizers")
    least, most = BITMAP_BITS
    bits = min(most, max(least, 1 << (16 * counted.count()).bit_length()))
    shared = spark.sparkContext.broadcast((bitmap(counted, bits), frequent_minimizers(counted)))
    found = staged(places(known, shared), "fm-places", compression="zstd")
    cold, hot = found.filter("digest IS NULL"), found.filter("digest IS NOT NULL")
    # equal segments of frequent minimizers, joined
    distinct = hot.groupBy("digest", "segment", "deal").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n"), F.min("windows").alias("windows"))
    distinct = staged(distinct, "fm-distinct", compression="zstd")
    n_words = F.col("windows") + (WINDOW - 1)
    wide = staged(distinct.groupBy("deal").agg(F.sum(n_words).alias("words")).filter(F.col("words") > shard_words).select("deal"), "fm-wide")
    narrow = distinct.join(maybe_broadcast(wide), "deal", "left_anti")
    row = lambda df, *keys: df.select("deal", *keys, "segment", "digest", "windows")
    dealt = row(cold, "doc_id", "text_key", "start").union(row(narrow, F.col("lo").alias("doc_id"), F.lit(None).cast("long"), F.lit(None).cast("int")))
    shards = max(1, -(-(dealt.agg(F.sum(n_words)).first()[0] or 0) // shard_words))
    by_shard = staged(judged(dealt.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int")).drop("deal", "windows")), "fm-judged")
    # back to the places of frequent minimizers: a later document loses the whole segment, the first one its flagged windows
    flags = by_shard.filter("digest IS NOT NULL").select("digest", "flags")
    if not wide.isEmpty():
        flags = flags.union(window_flags(distinct.join(maybe_broadcast(wide), "deal", "left_semi")))
    told = staged(distinct.select("digest", "lo", "n").join(flags, "digest", "left").filter("n > 1 OR flags IS NOT NULL"), "fm-told")
    back = joined(hot.select("doc_id", "text_key", "start", "windows", "digest"), told, "digest", hot.count())
    back = back.filter("doc_id > lo OR flags IS NOT NULL").withColumn("flags", F.when(F.col("doc_id") == F.col("lo"), F.col("flags")))
    gone = by_shard.filter("digest IS NULL").select("doc_id", "text_key", "start", "windows", "flags").union(back.select("doc_id", "text_key", "start", "windows", "flags"))
    # a set, so that rows that repeat one (doc_id, text) count once
    removal = staged(gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows", "flags")).alias("found")), "fm-found")
    dropped(counted, found, distinct, wide, by_shard, told)
    return cut_texts(texts.join(removal, ["doc_id", "text_key"], "left").select("doc_id", "text", "found"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT row_no, doc_id, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS window_words
      FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM d WHERE doc_id IS NOT NULL AND len(words) >= {WINDOW})),
least AS (SELECT window_words, min(doc_id) AS first_id FROM w GROUP BY ALL),
gone AS (SELECT DISTINCT row_no, unnest(range(pos, pos + {WINDOW})) AS pos FROM w JOIN least USING (window_words) WHERE first_id < doc_id),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
         FROM (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d) ANTI JOIN gone USING (row_no, pos) GROUP BY ALL)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_no)
"""
