"""Exact dedup, mixing and secrets against plain Python, with nulls, empty and very long texts, ties and repeats."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lodestack.llm import lsm_dedup, mixing, outliers, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, norm string, n long"


def frame(spark, rows):
    """doc_id, text, source rows as documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), "x", "y", 1) for i, t, s in rows], DOCS)


def cases():
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "délta", "日本", "x" * 40, "\x1cq", "a b"]
    rows = [(i, rnd.choice(["", "  ", "\n"]).join(rnd.choices(words, k=rnd.randint(0, 4))), rnd.choice(["s1", "s2", None, "é"])) for i in range(200)]
    rows += [(300, None, "s1"), (301, "", "s2"), (302, " \t\n", None), (303, "long " * 60_000, "s1"), (304, "long" * 60_000, "s3"), (305, "dup", "s1"), (305, "dup", "s1"), (306, "d up", "s1")]
    return rows + [(None, "alpha beta", "s1"), (None, "only here", "s1")]


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(spark):
    rows = cases()
    got = lsm_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0, i))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = defaultdict(int)
    for r in got:
        g = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (min(g)[3], len(g))
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_keep_unique(spark):
    rows = cases()
    left = lsm_dedup.keep_unique(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    texts = [strip(r["text"]) for r in left.collect()]
    assert sorted(texts) == sorted({strip(t) for _, t, _ in rows})


def test_keep_unique_of_repeated_rows(spark):
    """Of rows with one doc_id and equal normalised text the one with the most code points stays, and only one."""
    rows = [(1, "ab", "s"), (1, "a   b", "s"), (1, "ab", "s"), (1, "other", "s"), (2, "a b", "s"), (3, "x y", "s"), (3, "x y", "s"), (3, "x\ty", "s"), (None, "n n", "s"), (None, "nn", "s"), (None, "nn", "s")]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in lsm_dedup.keep_unique(frame(spark, rows)).collect())
    assert left[:3] == [(0, "n n"), (1, "a   b"), (1, "other")] and len(left) == 4 and left[3][0] == 3 and left[3][1] in ("x y", "x\ty")
    again = sorted((r["doc_id"] or 0, r["text"]) for r in lsm_dedup.keep_unique(frame(spark, rows[::-1])).collect())
    assert again == left


def test_empty_tables(spark):
    none = frame(spark, [])
    assert lsm_dedup.exact_dedup(none).count() == 0 and lsm_dedup.keep_unique(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.repeat_documents(none).count() == 0
    assert secrets.find_secrets(none).count() == 0


def test_filter_of_hits(spark):
    """All digests of the filter pass, about one in a hundred others does, and entries that no digest marks are pruned."""
    rows = spark.range(40_000).selectExpr("xxhash64(id) AS digest", "id")
    filter_ = lsm_dedup.build_filter(rows.filter("id < 5000").select("digest"), 5000).cache()
    passed = [r["id"] for r in lsm_dedup.through(rows, filter_).collect()]
    assert set(range(5000)) <= set(passed) and len(passed) == len(set(passed)) < 5000 + 0.03 * 35_000
    assert lsm_dedup.through(rows, filter_.limit(0)).count() == 0
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2900) AS text")
    norm = docs.selectExpr("xxhash64(replace(text, ' ', '')) AS digest").groupBy("digest").count().filter("count > 1").select("digest")
    hits = lsm_dedup.probe(docs, lsm_dedup.build_filter(norm, 100))
    assert 200 <= hits.count() < 400


def test_level_is_sorted(spark, tmp_path):
    rows = [(i, f"t{i % 50}", "s") for i in range(200)]
    lsm_dedup.flush(frame(spark, rows).repartition(3), f"{tmp_path}/runs")
    level = lsm_dedup.compact(lsm_dedup.runs(spark, f"{tmp_path}/runs"))
    parts = [[r["digest"] for r in p] for p in level.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 50
    assert all(r["n"] == 4 and r["best"]["doc_id"] < 50 for r in level.collect())


CLASHING = ("gone", "gone_id", "gone_sha", "_gone", "_sha", "_cut", "_text", "row", "cut", "of", "a.b", "size", "hash", "part", "turn", "Gone_")


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"word{i % 40} " + "alpha beta gamma delta " * (1 + i % 5), "s1" if i % 3 else None) for i in range(60)]
    docs = frame(spark, rows)
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, docs["doc_id"] * 100 + k)
    for stage in (lsm_dedup.keep_unique, mixing.repeat_documents, outliers.keep_good, simhash.keep_one):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.collect():
            assert all(r[len(DOCS.split(", ")) + k] == r["doc_id"] * 100 + k for k in range(len(CLASHING)))


def fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, free, total = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        free -= over or free
    return target


def test_mix(spark):
    rows = cases() + [(1000 + i, "w " * (i % 90), "big") for i in range(600)]
    got = mixing.mix(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = fill(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in ("s2", "big", None):
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeat_documents(spark):
    rows = cases() + [(1000 + i, "w x  y\n" * (i % 30), "big") for i in range(300)]
    docs = frame(spark, rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


SPANS = [
    (0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def test_secrets(spark):
    rnd = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(rnd.choices(alphabet, k=44)) for _ in range(120)]
    plain = ["path/to/some/Long/File2/and/more/of/the/same/path/path", "aB1" + "a" * 40, "HelloWorldVersion2HelloWorldVersion2HelloWorld", "internationalizationandmore"]
    rows = [(i, f"é😀 {t} end", "s") for i, t in enumerate(tokens)] + [(500 + i, f"see {t} there", "s") for i, t in enumerate(plain)]
    odd = ["token=token: abcdefghijklmnop", "PassWord: \"abcdefghijkl'", "x AKIA1234567890ABCD AKIA12 deadbeefdeadbeef99 0123", "api_key=a api-key=abcdefghijklmnop APIKEY  =  abcdefghijkl", "", None, "secret=" + "9f" * 40_000]
    rows += [(900 + i, t, None) for i, t in enumerate(odd)] + [(900, odd[0], None)]
    got = secrets.find_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict((i, t or "") for i, t, _ in rows)
    found = 0
    for r in got:
        spans = sorted((m.start(), k, m.end()) for k, rx, ok in SPANS for m in rx.finditer(text[r["doc_id"]]) if ok(m))
        base = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == base
        if r["doc_id"] < 500:
            found += f"random:3:{3 + 44}" in r["spans"].split(",")
        elif r["doc_id"] < 900:
            assert r["n_random"] == 0
    assert found >= 0.9 * len(tokens)


def test_short_secrets_among_ordinary_tokens(spark):
    """What else the corpus holds does not drop random tokens of 20 to 27 characters."""
    rnd = random.Random(10)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    fits = re.compile("(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")
    tokens = [t for t in ("".join(rnd.choices(alphabet, k=rnd.randint(20, 27))) for _ in range(150)) if fits.match(t)]
    words = "get user name list file path config build test main service handler index cache parse query result".split()
    plain = ["".join(w.capitalize() for w in rnd.choices(words, k=8))[: rnd.randint(19, 26)] + "2" for _ in range(9 * len(tokens))]
    rows = [(i, f"see {t} there", "s") for i, t in enumerate(tokens)] + [(1000 + i, " ".join(plain[i::50]), "s") for i in range(50)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame(spark, rows)).collect()}
    kept = sum(got[i] == f"random:4:{4 + len(t)}" for i, t in enumerate(tokens))
    assert kept >= 0.93 * len(tokens)
    false = sum(len([s for s in got[1000 + i].split(",") if s]) for i in range(50))
    assert false <= 0.2 * (kept + false)


def test_many_spans_in_one_text(spark):
    rnd = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = []
    for k in range(3000):
        parts += [f"{rnd.getrandbits(80):020x}", "".join(rnd.choices(alphabet, k=24)), f"token: {'v' * 12}{k}"]
    text = " é".join(parts)
    r = secrets.find_secrets(frame(spark, [(1, text, "s")])).first()
    spans = sorted((m.start(), k, m.end()) for k, rx, ok in SPANS for m in rx.finditer(text) if ok(m))
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    found = [s.split(":") for s in r["spans"].split(",") if s.startswith("random")]
    assert len(found) == r["n_random"] >= 0.9 * 3000
    assert all(text[int(a) - 1] == "é" and text[int(b) : int(b) + 1] in ("", " ") for _, a, b in found)
    assert not any(a < int(z) and int(x) < b for a, _, b in spans[:300] for _, x, z in found)


def test_random_letters_are_tested_too(spark):
    rnd = random.Random(12)
    lower = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(20)]
    plain = ["donaudampfschifffahrtsgesellschaft", "internationalizationandmoreofthesame"]
    got = {r["doc_id"]: r["n_random"] for r in secrets.find_secrets(frame(spark, [(i, t, "s") for i, t in enumerate(lower + plain)])).collect()}
    assert sum(got[i] for i in range(20)) >= 17 and got[21] == 0

def test_secrets_in_paths(spark):
    """A token that fits no encoding is judged by its parts, at their places."""
    secret, url = "aB3dE5fG7hJ9kL1mN3pQ5rS7", "aB3dE-fG7hJ_kL1mN3pQ5rS7xZ0v"
    texts = {
        f"https://h.test/reset-link/{secret}": [secret],
        f"é😀 /a_b/{url}/end-of+path": [url, "kL1mN3pQ5rS7xZ0v/end"],
        "my-file_aB3+dE5fG7/hJ9kL1mN3pQ5rS7xZ0v-copy": ["aB3+dE5fG7/hJ9kL1mN3pQ5rS7xZ0v", "hJ9kL1mN3pQ5rS7xZ0v-copy"],
        f"/x-y/{secret}/z_w/{secret[::-1]} {secret}": [secret, secret[::-1], secret],
        "see /usr-local/share_files/of-2/some_package/with-no/secret_in/it": [],
        f"/a-b/{secret}/deadbeefdeadbeef99": [secret],
    }
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    for i, (t, want) in enumerate(texts.items()):
        spans, at = [], 0
        for w in want:
            at = t.index(w, at)
            spans.append(f"random:{at}:{at + len(w)}")
            at += 1
        assert [s for s in got[i]["spans"].split(",") if s.startswith("random")] == spans and got[i]["n_random"] == len(want)
