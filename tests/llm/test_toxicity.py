import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaystone.llm import toxicity as tox
from quaystone.llm.queries import QUERIES, table
from quaystone.llm.text import Words, slices


def rows_of(texts):
    for _, data, offsets in slices(pa.array(texts)):
        own, doc, word = tox.distinct(Words(data, offsets, tox.LETTERS))
        return [own[word[doc == d]].ravel() for d in range(len(offsets) - 1)]


def fitted(rows, label, **how):
    """A machine that uses all columns of the rows."""
    used = np.unique(np.concatenate(rows))
    return tox.fit([np.searchsorted(used, r) for r in rows], label, np.ones(len(rows)), used, np.ones(len(used), bool), **how)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.9
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.01


def test_pairs_are_learned():
    """Toxic only when an insult and a group stand together: no sum of single weights can tell."""
    rng = random.Random(1)
    texts, label = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"filler{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(12)]
        w += ["vermin" if a else "flower", "northerners" if b else "cupboards"]
        rng.shuffle(w)
        texts.append(" ".join(w))
        label.append(float(a == b))
    y = np.array(label)
    m = fitted(rows_of(texts[:1000]), y[:1000], epochs=40, pair_rate=0.1)
    right = lambda m: np.mean([(p >= 0.5) == (t == 1) for _, data, offsets in slices(pa.array(texts[1000:])) for p, t in zip(m.scores(data, offsets), y[1000:])])
    assert right(m) > 0.95
    m.factors[:] = 0
    assert right(m) < 0.65


def brute(machine, text):
    """The score of one text by the plain formula over pairs of terms."""
    cols = rows_of([text])[0] if text else []
    at = {int(c): i for i, c in enumerate(machine.columns)}
    on = [at[c] for c in cols if c in at]
    z = machine.bias + sum(machine.weights[i] for i in on)
    z += sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(on) for j in on[:k])
    return 1 / (1 + np.exp(-z))


def test_scores_equal_pair_formula_and_edges(spark):
    texts = ["bad awful thing", "Nice kind words", None, "", "bad BAD awful", "12 34 !!", "é ünï bad", "nice " * 30000 + "awful"]
    m = fitted(rows_of(["bad awful thing", "nice kind words", "awful bad", "nice words"] * 20), np.array([1.0, 0, 1, 0] * 20), pair_rate=0.1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "bad"), (0, texts[0])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.score) for r in tox.score(df.drop("score"), m, ["doc_id"]).collect()]
    want = [(i, brute(m, t)) for i, t in enumerate(texts)] + [(None, brute(m, "bad")), (0, brute(m, texts[0]))]
    assert sorted(map(str, [(d, round(s, 9)) for d, s in got])) == sorted(map(str, [(d, round(float(s), 9)) for d, s in want]))


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = tox.learn(df, labels)
    assert {round(r.score, 4) for r in tox.score(df, m, ["doc_id"]).collect()} == {tox.DEFAULT_RATE}
    assert tox.score(df.limit(0), m, ["doc_id"]).count() == 0


def test_few_unseen_words_share_a_used_column():
    def columns(prefix):
        data = " ".join(prefix + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(10000)).encode()
        return tox.distinct(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), tox.LETTERS))[0][:, 0]

    used, other = (np.unique(columns(p)) for p in ("seenqq", "freshzz"))
    assert np.isin(other, used).mean() < 0.005
