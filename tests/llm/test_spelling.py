"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from lodestack.llm import spelling

DOCS = "doc_id long, text string, word string, n long, form string, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOCS)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def cases(seed):
    rnd = random.Random(seed)
    parts = ["an", "ti", "on", "er", "é", "zz", "aa", "st", "Ö", "q", "a"]
    words = ["".join(rnd.choices(parts, k=rnd.randint(3, 6))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaabaa", "ababab", "bababa", "abababa", "×÷×÷×÷", "x" * 300, "x" * 301]
    text = []
    for w in words:
        variants = {w}
        for _ in range(8):
            v = rnd.choice(sorted(variants))
            i = rnd.randrange(len(v) + 1)
            variants.add(rnd.choice([v[:i] + v[i + 1 :], v[:i] + rnd.choice("aeé") + v[i:], v[:i] + rnd.choice("aeé") + v[i + 1 :]]))
        for v in sorted(variants):
            text += [v] * rnd.choice([4, 5, 6, 30, 200])
    rnd.shuffle(text)
    rows = [(i, rnd.choice([" ", ", ", "\n"]).join(text[k : k + 50])) for i, k in enumerate(range(0, len(text), 50))]
    return rows + [(9000, None), (9001, ""), (None, "anan anantion ANANTION"), (5, rows[0][1]), (5, rows[0][1])] + rows[:3]


def test_against_brute_force(spark):
    for seed, kw in ((1, {}), (2, {"longest": 4, "frequent_grams": 60})):
        rows = cases(seed)
        got = spelling.group_variants(frame(spark, rows), **kw)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = brute(rows)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(f and r != f for _, f, r, *_ in want)
    assert spelling.group_variants(frame(spark, [])).count() == 0 and spelling.group_variants(frame(spark, [(1, None), (2, "short words")])).count() == 0


def test_bound_covers_every_edit():
    """No single edit changes more grams of a word than its bound says; the others stay where they are or one place further."""
    rnd = random.Random(7)
    for longest, share in ((2, 1), (3, 20), (4, 60), (5, 100)):
        words = ["".join(rnd.choices("abcde", [8, 4, 2, 1, 1], k=rnd.randint(6, 12))) for _ in range(150)]
        counts = Counter(w[i : i + k] for w in words for k in range(2, longest + 1) for i in range(len(w) - k + 1))
        total = sum(f for g, f in counts.items() if len(g) == 2)
        kept = [(g, f) for g, f in counts.items() if len(g) == 2 or counts[g[:-1]] > total / share]
        kept += [(a + b, 0) for a in "abcde" for b in "abcde" if a + b not in counts]
        grams = spelling.Grams.of(kept, longest)
        for w in words[:60]:
            mine, bound = spelling.decompose(w, grams)
            for i in range(len(w) + 1):
                for t, move in ((w[:i] + w[i + 1 :], -1), *((w[:i] + c + w[i:], 1) for c in "abcde"), *((w[:i] + c + w[i + 1 :], 0) for c in "abcde")):
                    theirs = set(spelling.decompose(t, grams)[0])
                    lost = sum((g, a if a < i else a + move) not in theirs and (g, a) not in theirs for g, a in mine)
                    assert lost <= bound, (w, t, mine, bound)
        if longest == 2:
            assert all(len(spelling.decompose(w, grams)[0]) - spelling.decompose(w, grams)[1] >= 3 for w in words)
