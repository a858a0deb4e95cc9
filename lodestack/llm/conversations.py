"""Conversation structure repair: the cheapest edits by bidirectional Dijkstra over an edit lattice.

The damage is dealt by crc32 of `conv_id:turn`. A conversation is then its rows in order of turn. A node of its lattice is (rows consumed, role that the
output ends in); edges keep, rerole or delete a row or insert an empty one. A forward and a reverse heap take turns by their least
cost; when their least costs together exceed the best meeting, every crossing of equal cost has been finished. The least audit
among all of them is read off by a walk over edges that lie on a cheapest path: a set of nodes that share the audit so far goes
on by the least letter. (Of two audits of one cost none begins the other, as what they differ by would be insertions, which cost.) A
path's first kept system row and its letters tell the roles of all repaired rows, so nodes of one audit repair alike.

One shuffle brings a conversation's rows together, sorted by Spark; a task reads one conversation after the other and holds the texts of one.
A conversation's audit and hash are one value over all its rows in order, so a conversation is the unit of work however long it is; its lattice has four
nodes a row, and time and memory are linear in its rows. Dropped rows are shuffled without their texts.

Defined results: null conv_id, turn, role and text are read as one space, where the row is damaged and after (a null conv_id is a conversation of its own
with a null conv_id in the result, null turns come first and do not count in gaps); rows of one turn are ordered by role, then text, by code
points, and repeated rows are rows; a role's initial is its first character (none for an empty role); very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import small_batches

DEALT = 20
#: fixed values of the contract: costs of the edits, and of a truncated row that stays
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: what the output ends in: nothing, a system row, a user row, an assistant row; and the rows that may follow
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
NEITHER, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = frozenset(("su", "ua", "au"))
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_WORDS = re.compile(r"[^\x20\x09-\x0D]")
_CUT = "\x20\x09\x0a\x0b\x0c\x0d"

#: (letter, cost without the row's own, next state, rows consumed) of the edges that leave a state, by the initial of the next row
_STAY = {s: [("I", INSERT_COST, FOLLOW[s][r], 0) for r in "ua" if r in FOLLOW[s]] for s in FOLLOW}


def _use(state: int, initial: str) -> list[tuple[str, int, int, int]]:
    keep = [("K", 0, FOLLOW[state][initial], 1)] if initial in FOLLOW[state] else []
    return keep + [("R", REROLE_COST, FOLLOW[state][r], 1) for r in "ua" if r in FOLLOW[state]]


_USE = {(s, i): _use(s, i) for s in FOLLOW for i in ("s", "u", "a", "")}


def _table(initial: str, fault: int) -> tuple[list, list]:
    """Edges out of each state at such a row, and edges into each state over it: (letter, cost, other state, rows)."""
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    out = [[(c, w + more, t, 1) for c, w, t, _ in ([] if fault in (BLANK, DUPLICATE) else _USE[s, initial])] + [("D", DELETE_COST, s, 1)] for s in range(4)]
    back = [[(c, w, s, 1) for s in range(4) for c, w, t2, _ in out[s] if t2 == t] for t in range(4)]
    return out, back


_TABLES = {(i, f): _table(i, f) for i in ("s", "u", "a", "") for f in range(4)}
_INTO = [[("I", w, s, 0) for s in range(4) for _, w, t2, _ in _STAY[s] if t2 == t] for t in range(4)]


def repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """cost and audit of the cheapest edits of rows (initial of the role, fault), the least audit of those."""
    n = len(rows)
    tables = [_TABLES[i if i in ("s", "u", "a") else "", f] for i, f in rows]
    edges = lambda i, state: tables[i][0][state] + _STAY[state] if i < n else _STAY[state]
    edges_into = lambda i, state: tables[i - 1][1][state] + _INTO[state] if i else _INTO[state]
    # nodes are 4 * rows consumed + state
    ahead, behind, done_ahead, done_behind = {START: 0}, {4 * n + s: 0 for s in ENDS}, set(), set()
    heap_ahead, heap_behind = [(0, START)], [(0, -4 * n - s) for s in ENDS]
    heapq.heapify(heap_behind)
    best = 0 if n == 0 else None
    while heap_ahead and heap_behind and (best is None or heap_ahead[0][0] + heap_behind[0][0] <= best):
        if heap_ahead[0][0] <= heap_behind[0][0]:
            cost, node = heapq.heappop(heap_ahead)
            if node in done_ahead:
                continue
            done_ahead.add(node)
            i, state = divmod(node, 4)
            for _, w, to, k in edges(i, state):
                other, total = 4 * (i + k) + to, cost + w
                if total < ahead.get(other, 1 << 60):
                    ahead[other] = total
                    heapq.heappush(heap_ahead, (total, other))
                if other in behind and (best is None or total + behind[other] < best):
                    best = total + behind[other]
        else:
            cost, node = heapq.heappop(heap_behind)
            node = -node
            if node in done_behind:
                continue
            done_behind.add(node)
            i, state = divmod(node, 4)
            for _, w, to, k in edges_into(i, state):
                other, total = 4 * (i - k) + to, cost + w
                if total < behind.get(other, 1 << 60):
                    behind[other] = total
                    heapq.heappush(heap_behind, (total, -other))
                if other in ahead and (best is None or total + ahead[other] < best):
                    best = total + ahead[other]
    final = {4 * n + s for s in ENDS}
    # forward nodes from which a crossing of the best cost is reached over edges that the forward search took
    good, todo = set(), []
    for u in done_ahead:
        meets = ahead[u] == best if u in final else ahead[u] + behind[u] == best if u in done_behind else False
        if meets or any(v in done_behind and ahead[u] + w + behind[v] == best for v, w in ((4 * (u // 4 + k) + to, w) for _, w, to, k in edges(u // 4, u % 4))):
            good.add(u)
            todo.append(u)
    while todo:
        v = todo.pop()
        i, state = divmod(v, 4)
        for _, w, to, k in edges_into(i, state):
            u = 4 * (i - k) + to
            if u in done_ahead and u not in good and ahead[u] + w == ahead[v]:
                good.add(u)
                todo.append(u)
    # the least audit: all nodes that share it so far, with their costs from the start
    audit, here = [], {START: 0}
    while not any(v in final and c == best for v, c in here.items()):
        steps = defaultdict(dict)
        for u, c in here.items():
            i, state = divmod(u, 4)
            for letter, w, to, k in edges(i, state):
                v = 4 * (i + k) + to
                if v in done_behind and c + w + behind[v] == best or v in good and c + w == ahead[v]:
                    steps[letter][v] = c + w
        letter = min(steps)
        audit.append(letter)
        here = steps[letter]
    return best, "".join(audit)


def repaired(rows: list[tuple[str, str]], audit: str) -> Iterator[str]:
    """`role:text` of the rows that are left, for rows (role, text) and the audit of their edits."""
    i, state = 0, START
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i]
        i += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = FOLLOW[state][role[:1]]
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the rows after damage; a dropped one stays as a row that is not present, so that its conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % DEALT).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), dealt.alias("dealt"))
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    text = F.when(F.col("dealt") == 0, None).otherwise(text)
    role = F.when(F.col("dealt") == 0, None).when(F.col("dealt") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(True), F.when(F.col("dealt") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("dealt") != 0).alias("present"), F.explode(times).alias("_t")).drop("_t")


def fault_of(role: str, text: str, seen: set[tuple[str, str]]) -> int:
    """The first fault of a row; `seen` holds the rows before it and takes it in."""
    twice = (role, text) in seen
    seen.add((role, text))
    if not _WORDS.search(text):
        return BLANK
    if twice:
        return DUPLICATE
    return NEITHER if text.rstrip(_CUT)[-1] in ".!?" else TRUNCATED


def _result(conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """One row of SCHEMA for a conversation's damaged rows in order."""
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    seen: set[tuple[str, str]] = set()
    faults = [fault_of(role, text, seen) for role, text in rows]
    first = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False))
    cost, audit = repair(list(zip(first, faults, strict=True)))
    digest, between = hashlib.sha256(), b""
    for line in repaired(rows, audit):
        digest.update(between + line.encode("utf-8", "surrogatepass"))
        between = b"\n"
    return conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, digest.hexdigest()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Results of conversations that come one after the other, sorted."""
    now, turns, rows = None, [], []
    for b in batches:
        for conv_id, turn, role, text, present in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    yield _result(now[0], turns, rows)
                now, turns, rows = (conv_id,), [], []
            if present:
                turns.append(turn)
                rows.append((role, text))
    if now is not None:
        yield _result(now[0], turns, rows)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """SCHEMA, one row for each conv_id of conversations(conv_id, turn, role, text), damaged before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for row in _conversations(batches):
            held.append(row)
            if len(held) == 1000:
                yield pack()
                held.clear()
        if held:
            yield pack()

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    small_batches(conversations.sparkSession)
    rows = damaged(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, SCHEMA)
