import random
import string

from pyspark.sql import functions as F

from quaystone.llm import neardup
from quaystone.llm.components import components
from quaystone.llm.neardup import near_duplicates
from quaystone.llm.queries import QUERIES, table

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, k, percent=80):
    sets = []
    for d, t in docs:
        w = (t or "").translate(LOW).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (both := len(a & b)) * 100 >= percent * (len(a) + len(b) - both):
                x, y = find(docs[i][0]), find(docs[j][0])
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), d == find(d)) for (d, _), s in zip(docs, sets))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_minhash_neardup"](spark, sf).collect())
    assert got == brute(docs, 2)


def test_chains_copies_and_edges(spark):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(200)]
    rows = [(100, None), (101, ""), (102, "One"), (103, "one"), (104, "a B"), (105, "A b"), (106, "Ä b")]
    for i in range(40):  # a chain: neighbours are near, the ends are not
        rows.append((i, " ".join(base)))
        base = list(base)
        for _ in range(6):
            base[rng.randrange(len(base))] = rng.choice(vocab)
    rows += [(200 + i, " ".join(rng.choice(vocab) for _ in range(50))) for i in range(30)]
    rows.append((300, " ".join(rng.choice(vocab) for _ in range(40000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(None).cast("string")).withColumn("component_id", F.lit(7))
    for k in (2, 5):
        assert sorted(tuple(r) for r in near_duplicates(df, shingle=k, side=14).collect()) == brute(rows, k)


def test_null_ids_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(near_duplicates(df).collect(), key=lambda r: str(r))
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id] == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_repeated_id_links_all_its_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    a, c, e = ([word() for _ in range(60)] for _ in range(3))
    near = c[:30] + ["other"] + c[31:]
    rows = [(5, a), (4, a), (5, c), (2, near), (7, e), (7, e), (7, near), (9, e), (30, a + c)]
    rows = [(d, " ".join(t)) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "HUB", 1)  # every pivot's text is dealt
    for k in (2, 5):
        assert sorted(tuple(r) for r in near_duplicates(df, shingle=k).collect()) == brute(rows, k)
    assert sorted({(r.doc_id, r.component_id) for r in near_duplicates(df, shingle=2).collect()}) == [(2, 2), (4, 2), (5, 2), (7, 2), (9, 2), (30, 30)]
    text_ids = df.select(F.concat(F.lit("0"), "doc_id").alias("doc_id"), "text").unionByName(spark.createDataFrame([("x", rows[0][1])], df.columns))
    assert {(r.doc_id, r.component_id) for r in near_duplicates(text_ids, shingle=2).collect()} == {(2, 2), (4, 2), (5, 2), (7, 2), (9, 2), (30, 30), (None, None)}


def test_recall_at_production_parameters(spark):
    """Thousands of pairs between 0.80 and 0.85, each alone: nothing but the tables can find them."""
    rng = random.Random(8)
    rows, pairs = [], 0
    while pairs < 3000:
        n = rng.randrange(40, 120)
        own = [f"w{rng.randrange(10**7)}" for _ in range(n + 1)]
        other = list(own)
        for at in rng.sample(range(1, n), max(1, round(n * 0.048))):
            other[at] = f"w{rng.randrange(10**7)}"
        x, y = set(zip(own, own[1:])), set(zip(other, other[1:]))
        if 0.80 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(2 * pairs, " ".join(own)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).filter("not kept").collect()
    assert all(r.component_id == r.doc_id - 1 for r in got)
    assert len(got) / pairs > 0.98


def test_components(spark):
    rows = [(i, i + 1) for i in range(10, 30)] + [(5, 40), (40, 5), (41, 40), (7, 7), (None, 3)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(rows, "x long, y long")).collect()}
    assert got == {(i, 10) for i in range(10, 31)} | {(5, 5), (40, 5), (41, 5)}
