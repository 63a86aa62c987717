import hashlib

from pyspark.sql import functions as F

from quaystone.llm import fingerprint as fp
from quaystone.llm.queries import QUERIES, table

MASK = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def slow(raw):
    byte = [mix((b + 1) * 0x2545F4914F6CDD1D & MASK) for b in range(256)]
    poly = lambda part: sum(byte[b] * pow(fp._BASE, i, 1 << 64) for i, b in enumerate(part)) & MASK
    rolled = {i + 7: mix(poly(raw[i : i + 7])) for i in range(len(raw) - 6)}
    depth = lambda h: 40 if h == 0 else min(40, (h & -h).bit_length() - 1)
    size = 2
    while sum(depth(h) >= size for h in rolled.values()) >= 64:
        size += 1
    sigs = []
    for level in (size, size + 1):
        ends = sorted({e for e, h in rolled.items() if depth(h) >= level} | ({len(raw)} if raw else set()))
        out, start = "", 0
        for e in ends:
            code = mix(poly(raw[start:e]) + (e - start) & MASK) >> 52
            out += chr(fp._LETTERS[code >> 6]) + chr(fp._LETTERS[code & 63])
            start = e
        sigs.append(out)
    return f"{1 << size}:{sigs[0]}:{sigs[1]}"


def lcs(a, b):
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(x) + len(y)) if x and y else float(a == b)


def test_fingerprints_equal_slow_version():
    texts = ["", "a", "abcdef", "abcdefg", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 50, "Größe ó 日本 " * 40, "".join(chr(32 + i * i % 90) for i in range(3000))]
    raws = [t.encode() for t in texts]
    assert fp.fingerprints(raws) == [slow(r) for r in raws]
    assert all(fp.likeness(a, a) == 1 for a in fp.fingerprints(raws))


def test_likeness_is_edit_distance():
    words = [hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 5] for i in range(400)]
    edit = words[:50] + ["changed"] * 9 + words[70:]
    a, b = fp.fingerprints([" ".join(words).encode(), " ".join(edit).encode()])
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    one, two = {int(p): a1, 2 * int(p): a2}, {int(q): b1, 2 * int(q): b2}
    assert fp.likeness(a, b) == max(lcs(one[s], two[s]) for s in one.keys() & two.keys()) > 0.5
    assert fp.likeness("64:AAAA:BBBB", "256:AAAA:BBBB") == 0
    assert fp.likeness("64:AAAA:BBCC", "128:BBCC:DDDD") == 1


def brute(docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, (d[1] or "").encode()))
    out = []
    marks = fp.fingerprints([(t or "").encode() for _, t in docs])
    for i, (d, t) in enumerate(docs):
        t, j = t or "", (i + 1) % len(docs)
        k = len(t) // 4
        e = t[: len(t) - k] + (docs[j][1] or "")[:k]
        (m,) = fp.fingerprints([e.encode()])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), marks[i], m, fp.likeness(marks[i], m), fp.likeness(marks[i], marks[j])))
    return out


def test_query_equals_brute_force(spark, sf):
    got = [tuple(r) for r in QUERIES["op4_piecewise_fingerprint"](spark, sf).collect()]
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert sorted(got) == sorted(want)
    assert sum(r[5] for r in got) / len(got) > 0.6 > 0.2 > sum(r[6] for r in got) / len(got)


def test_edges(spark):
    rows = [(3, "abc"), (1, None), (2, ""), (5, "x" * 9000), (5, "same id, other text"), (5, "x" * 9000), (None, "no id"), (None, "none either"), (4, "Ünïcode " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", F.lit("clash")).withColumn("k", F.lit(1))
    key = lambda r: str(r)
    assert sorted(map(tuple, fp.fingerprint_edits(df).collect()), key=key) == sorted(brute(rows), key=key)
    assert fp.fingerprint_edits(df.limit(0)).count() == 0
    assert fp.fingerprint_edits(df.filter("doc_id = 4")).count() == 1
