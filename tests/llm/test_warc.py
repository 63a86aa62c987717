import gzip
import hashlib

from pyspark.sql import functions as F

from quaystone.llm import warc
from quaystone.llm.queries import QUERIES, table
from quaystone.llm.shared import fresh


def brute(pages):
    pay = [(p, (h or "").encode()) for p, h in pages]
    head = {}
    for p, b in pay:
        if p is not None and len(b) >= 100:
            head[b] = min(p, head.get(b, p))
    out = []
    for p, b in pay:
        first = head.get(b) if len(b) >= 100 else None
        again = first is not None and p != first
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    got = sorted((tuple(r) for r in QUERIES["op2_warc_index"](spark, sf).collect()), key=str)
    assert got == brute([(r.page_id, r.html) for r in table(spark, sf, "pages").collect()])


def edges(spark):
    same = "<p>é" + "x" * 200
    rows = [(i, f"http://www.example{i % 7}.com/{i}?q=1", same if i % 3 == 0 else f"page {i}" * (i % 40)) for i in range(400)]
    rows += [(5000, None, None), (5001, "", ""), (None, "https://null.example.org:8080/a b\tc#f", same), (3, "http://www.example3.com/3", same), (3, "http://www.example3.com/3", same), (6000, "http://big.example/", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("kind", F.lit(1)), rows


def test_edges_lookup_and_files(spark):
    df, rows = edges(spark)
    folder = fresh(spark, "warc-test")
    captures = warc.write(df, folder)
    index = f"{folder}-index"
    directory = warc.build_index(captures, index, lines=16)
    assert directory.count() >= len(rows) // 16
    got = sorted((tuple(r) for r in warc.read_back(directory, index, folder).collect()), key=str)
    assert got == brute([(p, h) for p, _, h in rows])
    asked = spark.createDataFrame([("https://WWW.example3.com/3#x",), ("http://www.example2.com/2?q=1",), ("http://nowhere.example/",), (None,)], "url string")
    for most in (1 << 20, 400):  # the directory whole, and in pieces
        found = warc.lookup(asked, directory, index, folder, most_bytes=most).collect()
        want = sorted((u, p) for u, in asked.collect() if u for p, v, _ in rows if warc.url_key(v) == warc.url_key(u))
        assert sorted((r.url, r.page_id) for r in found) == want and len(want) == 3
        by = {p: (h or "").encode() for p, _, h in rows}
        assert all(bytes(r.payload) == by[r.page_id] for r in found if r.record_type == "response")
    # the archives are ordinary gzip files of WARC records
    path = folder.removeprefix("file://")
    name = captures.first().file
    with gzip.open(f"{path}/{name}") as f:
        assert f.read(10) == b"WARC/1.1\r\n"


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.url_key("http://user@m.x.org:8080") == "org,x,m:8080)/"
    assert warc.url_key(None) == ""


def test_empty(spark):
    df, _ = edges(spark)
    d, index, folder = warc.archive(spark, df.limit(0))
    assert warc.read_back(d, index, folder).count() == 0
