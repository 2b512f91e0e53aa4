"""Periodic runs against their definition."""

import hashlib
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from posterra.llm import queries, runs


def brute(w, shortest=6, times=4):
    """(start, length, period) of every run, by looking at every period."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if i > s and length >= max(shortest, times * q) and not any(all(w[x] == w[x + d] for x in range(s, i + q - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, most=40):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randint(1, 4)):
        k, n = rng.randint(1, 4), rng.randint(0, most)
        t = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randint(1, 6)
            t = [t[i] if i < a else t[min(n - 1, a + (i - a) % p)] for i in range(n)] + [rng.randrange(k) for _ in range(rng.randint(0, 5))]
        out.append(t)
    return out


def test_runs_against_brute_force():
    for seed in range(1500):
        own = texts(seed)
        words = np.array([x for t in own for x in t], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in own])))
        of, found = runs.runs_of(words, bounds)
        got = [[tuple(r) for r, o in zip(found.tolist(), of.tolist(), strict=True) if o == k] for k in range(len(own))]
        assert got == [brute(t) for t in own], own


def test_other_limits():
    for seed in range(300):
        own = texts(seed, 24)[0]
        _, found = runs.runs_of(np.array(own, dtype=np.int64), np.array([0, len(own)]), 4, 2)
        assert [tuple(r) for r in found.tolist()] == brute(own, 4, 2), own


def test_next_smaller():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.permutation(n)
        assert runs.next_smaller(v).tolist() == [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]


def planted(doc_id, words):
    """The contract's words of a document, one at a time."""
    from zlib import crc32

    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(words):
    found = brute(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_op13(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(map(str, t)) + rng.choice(["", " ", "\n\t"])) for i in range(200) for t in texts(i, 60)[:1]]
    rows += [(300, None), (301, ""), (302, " \n\t\x0b\x0c\r "), (303, "a b " * 400), (303, "a b " * 400), (304, "é b " * 9), (305, "日 本 " * 50 + "x " + "日 本 " * 50)]
    rows += [(i, " ".join(str(rng.randrange(500)) for _ in range(700))) for i in range(400, 440)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).fillna(-1).collect())
    split = lambda t: [w for w in (t or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    want = sorted((i, *[-1 if x is None else x for x in expected(planted(i, split(t)))]) for i, t in rows)
    assert got == want


def test_long_text_null_key_and_empty_table(spark):
    """A text of a megabyte that is one run, beside one that has none."""
    docs = spark.createDataFrame([(None, "ab cd ef gh " * 90_000), (1, " ".join(map(str, range(200_000)))), (2, "a " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find(docs).collect()}
    assert [tuple(x) for x in got[None].runs] == [(0, 360_000, 4)] and got[None].collapsed == "ab cd ef gh"
    assert got[1].runs == [] and len(got[1].collapsed.split(" ")) == 200_000
    assert [tuple(x) for x in got[2].runs] == [(0, 300_000, 1)] and got[2].collapsed == "a"
    assert runs.find(docs.limit(0)).count() == 0


def test_strongest_is_exact(spark):
    """Fractions that doubles can't tell apart, and ties."""
    rows = [[(9, 4 * 10**8 + 1, 10**8), (0, 4 * 10**8, 10**8)], [(5, 12, 3), (2, 8, 2), (2, 16, 4)], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, runs array<struct<start: long, length: long, period: long>>")
    got = {r.i: r.best and tuple(r.best) for r in df.select("i", runs.strongest(F.col("runs")).alias("best")).collect()}
    assert got == {0: (9, 4 * 10**8 + 1, 10**8), 1: (2, 8, 2), 2: None}
