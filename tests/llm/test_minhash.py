"""MinHash near-deduplication against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np

from lodestack.llm import minhash

DOCS = "doc_id long, text string, node long, key long, digest string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], DOCS)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """doc_id, n_shingles, component_id of every row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(known) if known else None))
    return out


def cases(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n * 7 % 1009, text))
        n += 1

    for _ in range(15):
        base = rnd.choices(vocab, k=rnd.choice([3, 8, 40, 120, 300]))
        add(" ".join(base))
        for _ in range(rnd.randint(0, 12)):  # chains of edits, near the threshold
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            add(rnd.choice([" ", "  ", "\n"]).join(copy))
            if rnd.random() < 0.5:
                base = copy
    for _ in range(40):
        add(" ".join(rnd.choices(vocab, k=60)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one"), (2006, "É é"), (2007, "é é"), (2008, "a b c"), (2008, "a b c"), (2009, "A b C")]
    rows += [(2010, "long " * 20_000 + "tail"), (2011, "long " * 30_000 + "tail"), (None, "a b c"), (None, "x y z q"), (None, None), (5, "x y z q r")]
    return rows


def test_against_brute_force(spark):
    for seed, blocks in ((1, {}), (2, {"block_rows": 6, "block_hashes": 400})):  # small blocks
        rows = cases(seed)
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), **blocks).collect()), key=str)
        assert got == sorted(brute(rows), key=str)
    kept = minhash.near_duplicates(frame(spark, rows)).filter("kept").select("doc_id").collect()
    assert {r[0] for r in kept} == {d for d, _, c in brute(rows) if d == c}
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).filter("kept AND component_id = doc_id").count() == 2


def test_blocks_lose_no_link(spark):
    """Groups in which many pairs link only through others, whole and cut in small blocks: the links span the components, and are true."""
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(50)}" for _ in range(60)]
        for _ in range(6):
            copy = list(base)
            copy[rnd.randrange(60)] = "new"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    sets = [minhash.shingles(t) for t in texts]
    table = spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(sets)], "node long, hashes array<bigint>")
    groups = spark.createDataFrame([(10, i, len(s)) for i, s in enumerate(sets)], "key long, node long, n long")
    lanes = [minhash.sketch(s).astype(np.uint8).tobytes() for s in sets]
    members = spark.createDataFrame([(k, i, len(s), bytearray(lanes[i])) for i, s in enumerate(sets) for k in (10, 11)], "key long, node long, n long, lanes binary")

    def roots(links):
        return {r["v"]: r["root"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}

    want = [c for _, _, c in brute(rows)]
    for block in (300, 10**6):
        links = [(r["a"], r["b"]) for r in minhash.links(groups, table, block).collect()]
        assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) for a, b in links)
        found = roots(links)
        assert [found.get(i, i) for i in range(len(texts))] == want
    for block in (8, 10**6):  # no link leaves a group of candidates
        found = roots([(r["a"], r["b"]) for r in minhash.candidates(members, block).collect()])
        assert all(found.get(i, i) == found.get(want[i], want[i]) for i in range(len(texts)))


def test_sketch():
    """Every place fills, for sets of any size; the share of equal places is close to the similarity."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 160, 5000):
        h = np.unique(rng.integers(0, 2**64, n, np.uint64))
        s = minhash.sketch(h)
        assert (s > 0).all() and (s == minhash.sketch(h[::-1].copy())).all()
    for n, shared in ((40, 30), (400, 300), (4000, 3000)):
        got = []
        for _ in range(60):
            h = rng.integers(0, 2**64, 2 * n - shared, np.uint64)
            got.append((minhash.sketch(h[:n]) == minhash.sketch(h[n - shared :])).mean())
        assert abs(np.mean(got) - shared / (2 * n - shared)) < 0.02 and np.std(got) < 0.06
    keys = minhash.band_keys(minhash.sketch(h))
    assert len(set(keys.tolist())) == minhash.BANDS
