"""Hierarchical multi-length packing of tokenised documents into sequences.

Every task packs the documents it reads in blocks of a bounded number of tokens, so nothing is shuffled and no
task sees more than its share. In a block:

1. Route: whole windows of the context size are cut off a document and stand alone; what is left goes to the smallest
   tier (a power of two) that holds it.
2. Pack each tier, the longest first: its longest piece opens a window of its size, and further pieces of the tier
   follow while they fit.
3. Fill: a window's gap takes the longest waiting piece that fits, from tier to shorter tier; when none
   fits, the gap is closed by cutting a waiting piece, whose rest waits in the tier of its new length. Pieces too few to
   fill a window of their tier wait for the next block of the task; at the end of the task they are cut at powers of two, so no
   sequence is padded.
4. Balance: sequences are dealt to step groups of equal token totals (largest first, to the emptiest group of
   the block).

Defined results: a null or empty text is its end-of-document id alone; very long texts are cut in many
windows; rows that repeat a doc_id are packed each by itself; other columns are ignored.
sequence_id is unique over tasks: the task's partition in the upper bits, its own count in the lower.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestack.llm.common import small_batches

TIERS = (1024, 512, 256, 128)
BLOCK_TOKENS = 1_000_000
STEP_TOKENS = 8 * 1024
END_ID = 0
#: Pieces of text whose ids a worker remembers; about 150 bytes each.
CACHE_PIECES = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, step_group long"
#: How the byte-level vocabulary parts text before it merges bytes (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than the blank and the line feed, and what starts a special token: such texts are encoded whole.
_RARE = [c.encode() for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u3000"] + [b"\xe2\x80", b"\xe2\x81\x9f", b"<|"]
#: A blank beside white space, or a line feed at an end, may belong to a longer token of white space.
_BESIDE = [b"  ", b" \n", b"\n "]


def _simple(text: bytes) -> bool:
    return not (text[:1] in b" \n" or text[-1:] in b" \n" or any(x in text for x in _BESIDE) or any(x in text for x in _RARE))


class TokenCache:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary never joins text across a blank that stands between two words, so a text is the sequence of its
    blank-led pieces. A batch's distinct pieces are found in Arrow, ids of known ones are remembered, and unknown ones are
    encoded together by the same vocabulary's ranks. Texts where that rule may not hold are encoded whole.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.ranks = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode unknown pieces, many to one text, and cut the ids where the pieces meet."""
        for i in range(0, len(pieces), 4000):
            some = pieces[i : i + 4000]
            text = " " + " ".join(some)
            ids = np.array(self.ranks.encode_ordinary(text), "<u4")
            blanks = np.flatnonzero(np.frombuffer((text + " ").encode(), np.uint8) == 32)[1:]
            cuts = (4 * np.searchsorted(np.cumsum(self.width[ids]), blanks, side="right")).tolist()
            raw = ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if _simple(t.encode())]
        odd = sorted(set(range(len(texts))) - set(plain))
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if not plain:
            return out
        pieces = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        ends = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        if len(self.known) > self.limit:
            self.known.clear()
        self._learn([p for p in distinct if p not in self.known])
        ids = [self.known[p] for p in distinct]
        # a text's first piece has no blank before it
        index[ends[:-1]] = len(ids) + np.arange(len(plain))
        ids += [np.array(self.ranks.encode_ordinary(distinct[h]), "<u4").tobytes() for h in coded.indices.to_numpy()[ends[:-1]].tolist()]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, flat = np.cumsum(n) - n, np.frombuffer(b"".join(ids), "<u4")
        per = n[index]
        upto = np.concatenate([[0], np.cumsum(per)])
        where = np.repeat((first[index] - upto[:-1]).astype(np.int32), per)
        where += np.arange(upto[-1], dtype=np.int32)
        raw = flat[where].tobytes()
        at = (4 * upto[ends]).tolist()
        for i, a, b in zip(plain, at, at[1:], strict=False):
            out[i] = raw[a:b]
        return out


class TierPacker:
    """Packs pieces of one task; a piece is (length, doc number, start) and waits in the queue of its tier, sorted."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers, reverse=True)), step_tokens
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.done: list[list[tuple[int, int, int]]] = []

    def route(self, doc: int, tokens: int) -> None:
        """Whole windows of the context size stand alone; what is left goes to the smallest tier that holds it."""
        whole = tokens // self.tiers[0]
        self.done += [[(self.tiers[0], doc, k * self.tiers[0])] for k in range(whole)]
        self._wait(tokens - whole * self.tiers[0], doc, whole * self.tiers[0])

    def _wait(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.waiting[next(t for t in reversed(self.tiers) if length <= t)], (length, doc, start))

    def pack(self, last: bool) -> None:
        """Fill windows of every tier, the longest first, as far as waiting pieces fill them; at the last, all that is left."""
        for k, tier in enumerate(self.tiers):
            queues = [self.waiting[t] for t in self.tiers[k:]]
            tokens = sum(p[0] for q in queues for p in q)
            while queues[0] and tokens >= tier:
                self.done.append(self._window(queues, tier))
                tokens -= tier
        if last:
            every = [self.waiting[t] for t in self.tiers]
            tokens = sum(p[0] for q in every for p in q)
            while tokens:  # powers of two need no padding
                size = min(self.tiers[0], 1 << tokens.bit_length() - 1)
                self.done.append(self._window(every, size))
                tokens -= size

    def _window(self, queues: list[list], size: int) -> list[tuple[int, int, int]]:
        """A full window: the longest piece that fits the gap, from the window's own tier to shorter ones; if none fits, one is cut."""
        window, gap = [], size
        while gap:
            for q in queues:
                at = bisect_right(q, (gap, float("inf"), 0))
                if at:
                    piece = q.pop(at - 1)
                    break
            else:
                n, doc, start = next(q for q in reversed(queues) if q).pop(0)
                self._wait(n - gap, doc, start + gap)
                piece = (gap, doc, start)
            window.append(piece)
            gap -= piece[0]
        return window

    def take(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The packed sequences with the number of their step group, balanced over the groups."""
        done, self.done = self.done, []
        sizes = [sum(p[0] for p in s) for s in done]
        groups = max(1, -(-sum(sizes) // self.step_tokens))
        load = [(0, g) for g in range(groups)]
        for i in sorted(range(len(done)), key=lambda i: (-sizes[i], i)):
            n, g = heapq.heappop(load)
            heapq.heappush(load, (n + sizes[i], g))
            yield g, done[i]


def pack_batches(batches: Iterable[pa.RecordBatch], cache: TokenCache, partition: int, tiers=TIERS, block_tokens: int = BLOCK_TOKENS) -> Iterator[pa.RecordBatch]:
    """Pack (doc_id, text) batches of one task; a block's ids are held only until its rows are out."""
    packer, held, number, n_seq, n_group = TierPacker(tiers), {}, 0, partition << 36, partition << 36
    tokens = 0
    end = np.array([END_ID], "<u4").tobytes()

    def block(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal n_seq, n_group, held
        packer.pack(last)
        rows, groups = [], 0
        for g, seq in packer.take():
            at = 0
            for length, doc, start in seq:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, n_seq, at, n_group + g))
                at += length
            groups, n_seq = max(groups, g + 1), n_seq + 1
        n_group += groups
        left = {p[1] for q in packer.waiting.values() for p in q}
        held = {d: v for d, v in held.items() if d in left}
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 50_000], strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, len(ids_of), 512):
            some = [t or "" for t in texts.slice(i, 512).to_pylist()]
            for doc_id, ids in zip(ids_of[i : i + 512], cache.encode(some), strict=True):
                held[number] = (doc_id, ids + end)
                packer.route(number, len(ids) // 4 + 1)
                tokens, number = tokens + len(ids) // 4 + 1, number + 1
            if tokens >= block_tokens:
                tokens = 0
                yield from block(False)
    yield from block(True)


_caches: dict[str, TokenCache] = {}


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of docs(doc_id, text): see SCHEMA; step_group balances sequences for training steps."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _caches:
            _caches[tokenizer_path] = TokenCache(tokenizer_path)
        yield from pack_batches(batches, _caches[tokenizer_path], TaskContext.get().partitionId(), tiers, block_tokens)

    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, SCHEMA)
