import hashlib
import re
import string

from pyspark.sql import functions as F

from quaystone.llm.decontaminate import decontaminate
from quaystone.llm.queries import QUERIES, table

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    got |= wins[x]
        got = sorted(got)
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return tuple(str(x) for x in r)


def test_query_equals_brute_force(spark, sf):
    got = [tuple(r) for r in QUERIES["op1_decontamination"](spark, sf).collect()]
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
    assert any(r[5] for r in got)


def edge_tables(spark):
    long = " ".join(f"w{i % 997}" for i in range(60000))
    item = "Alpha beta, gamma delta! one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, "short ITEM here"), (5, long + " " + item), (None, item.upper()), (6, "ünï Çödé x"), (7, "!!! ...")]
    items = [(1, item), (10, item), (2, "short item"), (3, None), (4, ""), (5, "çödé"), (6, "Çödé"), (None, "short")]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))


def test_edges_and_blocks(spark):
    docs, items = edge_tables(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    for block in (1 << 20, 60):
        got = [tuple(r) for r in decontaminate(docs, items, block_bytes=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs, items = edge_tables(spark)
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
