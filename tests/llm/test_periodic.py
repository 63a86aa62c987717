import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import periodic
from quaystone.llm.queries import QUERIES, table


def plain(w, least):
    """Every run, by looking at every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def got(w, least):
    return [tuple(int(v) for v in x) for x in zip(*periodic.runs_of(np.array(w, np.int64), least))]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randrange(90), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            for i in range(a, n):
                w[i] = w[a + (i - a) % p]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = rng.randrange(k)
        least = rng.choice([2, 12])
        assert got(w, least) == plain(w, least), (w, least)


def test_words_full_of_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a  # Fibonacci words
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for w in (b[:400], thue, [0] * 300, [0, 1] * 150, ([0] * 7 + [1]) * 40, [0, 0, 1] * 50 + [0] * 50):
        assert got(w, 2) == plain(w, 2)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    w = (text or "").split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain(w, 12)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, n, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect() if len(r.text or "") < 12_000]
    out = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(docs) > 150 and all(out[d] == expected(d, t) for d, t in docs)
    assert sum(out[d][2] > 0 for d, _ in docs) > 10


@pytest.mark.parametrize("slice_", [16, 1 << 20])
def test_texts_side_by_side_and_edges(spark, monkeypatch, slice_):
    monkeypatch.setattr(periodic, "SLICE", slice_)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a " * 40), (5, "a " * 40), (6, "a b c " * 5 + "x"), (7, "A a " * 12), (8, "ä b c " * 6), (None, "x y " * 8), (9, "a " * 11), (10, "x " * 100_000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("mine")).withColumn("n_words", F.lit(1)).coalesce(1)
    found = periodic.find_runs(df, ["doc_id", "runs"])
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert by[1] == by[2] == by[3] == ([], "")
    assert by[4] == by[5] == ([(0, 40, 1)], "a")
    assert by[6] == ([(0, 15, 3)], "a b c x")
    assert by[7] == ([(0, 24, 2)], "A a") and by[None] == ([(0, 16, 2)], "x y")
    assert by[8] == ([(0, 12, 2)], "ä b c")
    assert by[9] == ([], ("a " * 11).strip())
    assert by[10] == ([(0, 100_000, 1)], "x y")
    assert periodic.digests(periodic.find_runs(df.limit(0), ["doc_id"]), ["doc_id"]).count() == 0
