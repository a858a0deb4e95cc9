"""Conversation repair against brute force: every edit sequence of short conversations, a plain Dijkstra with audits for longer ones."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from lodestack.llm import conversations as cv

SCHEMA = "turn long, audit string, conv_id long, role string, text string, cost long"


def frame(spark, rows):
    return spark.createDataFrame([(t, "x", c, r, x, 1) for c, t, r, x in rows], SCHEMA)


def plain(rows, faults):
    """Least (cost, audit, repaired) by a search over (rows consumed, role initials so far by last one) with whole audits."""
    goal = re.compile(r"(s?(ua)+)?")
    start = (0, "", 0, "", ())  # cost, audit, rows, kind of end, output
    heap, best = [start], {}
    while heap:
        cost, audit, i, end, out = heapq.heappop(heap)
        if (i, end) in best and best[i, end] <= (cost, audit):
            continue
        best[i, end] = (cost, audit)
        if i == len(rows) and goal.fullmatch("".join(r[:1] for r, _ in out)):
            return cost, audit, out
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
        for r in ("user", "assistant"):
            if r[0] in may:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], (*out, (r, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, end, out))
            if faults[i] in (cv.NEITHER, cv.TRUNCATED):
                more = 5 * (faults[i] == cv.TRUNCATED)
                role, text = rows[i]
                if role[:1] and role[:1] in may:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for r in ("user", "assistant"):
                    if r[0] in may:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r[0], (*out, (r, text))))
    raise AssertionError


def brute(table):
    """One result per conv_id, by the rules of the contract in plain Python."""
    said = lambda x: " " if x is None else str(x)
    after, ids = defaultdict(list), {c for c, _, _, _ in table}
    for c, t, r, x in table:
        k = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(r), said(x)
        if k:
            row = (t is not None, t or 0, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            after[c] += [row] * (2 if k == 3 else 1)
    for c in ids:
        rows = sorted(after[c])
        turns = {t for known, t, _, _ in rows if known}
        rows, seen, faults = [(r, x) for _, _, r, x in rows], set(), []
        for r, x in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", x)[-1:]
            faults.append(cv.BLANK if not last else cv.DUPLICATE if (r, x) in seen else cv.NEITHER if last[0] in ".!?" else cv.TRUNCATED)
            seen.add((r, x))
        cost, audit, out = plain(rows, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        yield (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (cv.BLANK, cv.DUPLICATE, cv.TRUNCATED)), illegal, cost, audit, digest)


def cases(seed):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "sys"], ["Yes.", "No!", "what?  ", "cut", "cut off ", "", " \t\n", None, "é日.", "a\x1cb."]
    rows = []
    for c in range(150):
        good = rnd.random() < 0.6
        for t in range(rnd.randint(1, 9)):
            role = ("user", "assistant")[t % 2] if good and rnd.random() < 0.8 else rnd.choice(roles)
            rows.append((c, rnd.choice([t, t, t, t * 3, None]), role, rnd.choice(texts[:4] if good else texts)))
    rows += [(None, 0, "user", "Hello."), (None, None, None, None), (200, None, "user", "x."), (200, None, "user", "x."), (201, -5, "assistant", "word " * 50_000 + "end.")]
    rows += [(300, t, "user" if t % 2 else "assistant", f"Turn {t}{'.' * (t % 3 > 0)}") for t in range(300)]
    return rows + [(400 + i, t, "user", "Gone.") for i in range(40) for t in (0,)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = cases(seed)
        got = cv.repair_conversations(frame(spark, rows))
        assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in got.dtypes) == cv.SCHEMA
        want = sorted(brute(rows), key=str)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert any(w[7] == "" and w[6] == 0 and w[8] == hashlib.sha256(b"").hexdigest() for w in want)
    assert cv.repair_conversations(frame(spark, [])).count() == 0


def test_search_finds_the_least_audit():
    """Against every path of small lattices, with all faults and initials."""
    rnd = random.Random(5)
    names = {"s": "system", "u": "user", "a": "assistant", "": "", "t": "tool"}
    for _ in range(3000):
        rows = [(rnd.choice("suat") if rnd.random() < 0.95 else "", rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 9))]
        cost, audit, out = plain([(names[i], "x") for i, _ in rows], [f for _, f in rows])
        assert cv.repair(rows) == (cost, audit)
        assert list(cv.repaired([(names[i], "x") for i, _ in rows], audit)) == [f"{r}:{x}" for r, x in out]


def test_long_conversations_take_linear_time():
    rows = [("u" if i % 3 else "s", i % 4) for i in range(40_000)]
    cost, audit = cv.repair(rows)
    assert len(audit) >= len(rows) and cost > 0
