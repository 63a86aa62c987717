import math
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quaystone.llm import lm
from quaystone.llm.queries import QUERIES, table

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(t):
    return [*(t or "").translate(LOW).encode().split(), b"<end>"]


def brute(docs):
    """n_tokens, n_known, N and the base score by the plain formula."""
    is_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in docs if d is not None and not is_out(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, is_out(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in docs]


def same(got, want):
    key = lambda r: (str(r[0]), r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9), (g, w)


def test_base_scores_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_lm_scores"](spark, sf).collect()
    same([tuple(r) for r in got], brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.02 * sum(r.n_tokens for r in held)


def test_rare_words_through_the_join(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % (7 + i)}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 64)
    same([tuple(r) for r in lm.score_texts(df, held).collect()], brute(docs))


def test_class_probabilities_sum_to_one():
    model = lm.Bilinear(seed=5)
    k = lm.TOP + lm.SHAPES
    ctx = np.repeat(np.array([[1, 2, 3], [9, 9, 200]]), k, axis=0)
    p = np.exp(model.logs(ctx, np.tile(np.arange(k), 2)).astype(np.float64)).reshape(2, k)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "a zz"), (4, "x" * 3000 + " " + "y z " * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("c", F.lit(1))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = [tuple(r) for r in lm.score_texts(df, held, ~held & F.col("doc_id").isNotNull()).collect()]
    same(got, brute(docs))
    assert all(math.isfinite(r[6]) for r in got)
    assert lm.score_texts(df.limit(0), held).count() == 0
    nothing = lm.score_texts(df, F.lit(True)).collect()
    assert len(nothing) == len(docs) and all(r.n_known == 0 and math.isfinite(r.score) for r in nothing)
