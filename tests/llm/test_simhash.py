import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import simhash
from quaystone.llm.queries import QUERIES, table

LOW = {i: i + 32 for i in range(65, 91)}


def plain(spark, docs):
    """(doc_id, fingerprint, component_id) by Spark's own XXH64, a bit at a time, and all pairs."""
    parts = []
    for at, (_, t) in enumerate(docs):
        w = (t or "").translate(LOW).split()
        parts += [(at, s) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else [])]
    bits = [F.sum(F.expr(f"shiftrightunsigned(h, {b}) & 1")).alias(f"b{b}") for b in range(64)]
    counts = spark.createDataFrame(parts, "k long, s string").select("k", F.xxhash64("s").alias("h")).groupBy("k").agg(F.count("*").alias("n"), *bits).collect()
    codes = [0] * len(docs)
    for r in counts:
        codes[r.k] = sum(1 << b for b in range(64) if 2 * r[f"b{b}"] > r.n)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and ((codes[i] ^ codes[j]).bit_count() <= 3 or docs[i][0] == docs[j][0]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{c:016x}", None if d is None else least[find(i)]) for i, ((d, _), c) in enumerate(zip(docs, codes))), key=str)


def test_query_equals_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_simhash_neardup"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == plain(spark, docs)


@pytest.mark.parametrize("task", [64, 1 << 18])
def test_index_finds_all_links(spark, monkeypatch, task):
    """Clusters of random codes, one dense: in many ranges and in few."""
    monkeypatch.setattr(simhash, "TASK_CODES", task)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
    codes = [base, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]
    for _ in range(20):
        b = np.concatenate((rng.choice(base, 60), base[:1].repeat(40)))
        for _ in range(int(rng.integers(1, 5))):
            b = b ^ (np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64))
        codes.append(b)
    codes = np.unique(np.concatenate(codes))
    want = simhash._Groups(len(codes))
    for i in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3)
        want.merge(np.full(len(near), i), near)
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    found = simhash.links(spark.createDataFrame([(c,) for c in at], "code long")).collect()
    got = simhash._Groups(len(codes))
    got.merge(np.array([at[r.x] for r in found]), np.array([at[r.y] for r in found]))
    assert (got.labels == want.labels).all()
    assert len(set(want.labels.tolist())) < len(codes) - 300


def test_gray_order():
    codes = np.arange(1 << 12, dtype=np.uint64)
    rank = simhash.gray_rank(codes)
    assert (simhash.gray_code(rank) == codes).all()
    walk = codes[np.argsort(rank)]
    assert (np.bitwise_count(walk[1:] ^ walk[:-1]) == 1).all()


def test_edges(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(70_000)]
    rows = [(9, None), (4, ""), (7, " \t\n"), (1, "One"), (3, "one"), (8, "a B"), (2, "A b"), (None, "a b"), (None, None), (5, "Ä b c d"), (6, "ä b c d")]
    rows += [(20, " ".join(long)), (21, " ".join(long[:-1])), (30, " ".join(long[:50])), (31, " ".join(long[:50])), (32, " ".join(long[50:90])), (30, " ".join(long[50:90]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("code", F.lit("x")).withColumn("component_id", F.lit(7)).withColumn("rows", F.lit(1))
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == plain(spark, rows)
    assert {r[0]: r[2] for r in got if r[0] in (4, 7, 9, 30, 31, 32)} == {4: 4, 7: 4, 9: 4, 30: 30, 31: 30, 32: 30}
    assert [r[1:] for r in got if r[0] in (4, 7, 9)] == [("0" * 16, 4)] * 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_classes_are_whole(spark):
    rows = [(i, "the same words for all of these") for i in range(3000)] + [(3000 + i, f"w{i} x{i * 7} y{i * 3} z{i} u{i}") for i in range(100)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 3100 and out.filter("component_id = 0").count() == 3000


def test_text_ids(spark):
    rows = [("b", "x y z w"), ("a", "x y z w"), ("c", "other words here now")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
