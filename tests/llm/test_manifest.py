import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quaystone.llm.manifest import manifest, proof_digest
from quaystone.llm.queries import QUERIES, table


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        i //= 2
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    digest = lambda r: H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    trees = {g: levels([digest(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(top, k)
            n = None if r[3] is None else r[3] + (zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 0)
            held = digest((*r[:3], n, r[4]))
            for before, after in path:
                held = H(before, held, after)
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], H(*[b + a for b, a in path]), held, held == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    altered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(docs, altered={"n_chars": altered})
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified").collect()), key=str)


def test_query_equals_plain_trees(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf).collect()), key=str)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) // 3


def test_shapes_nulls_and_repeats(spark):
    """Groups of 1 to 300 rows (several bands), null and odd names, repeated and null ids."""
    rng = random.Random(6)
    rows = []
    for lang, n in ((None, 3), ("", 1), ("=", 2), ("a", 64), ("b", 65), ("ä", 300), ("B", 1), ("z", 5)):
        rows += [(rng.randrange(400), rng.choice(["s", None, "ü"]), lang, rng.choice([None, rng.randrange(9)]), rng.choice([None, "", "text €", "x" * rng.randrange(20)])) for _ in range(n)]
    rows += [rows[10], rows[10], (None, None, "a", None, None), (None, None, "a", 4, "t"), (None, None, None, None, None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumns({"tree": F.lit("mine"), "rank": F.lit(5), "digest": F.lit("x"), "own": F.lit(1)})
    assert found(df) == plain(rows)


def test_one_row_one_group_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    for rows in ([(4, "s", "en", 2, "hi")], [(i, "s", "en", i, "hi") for i in range(130)]):
        assert found(spark.createDataFrame(rows, schema)) == plain(rows)
    assert found(spark.createDataFrame([], schema)) == []


def test_a_proof_fails_for_any_changed_field(spark):
    schema = "id long, who string, what string"
    rows = [(i, "ab"[i % 2], f"value {i}") for i in range(20)]
    df = spark.createDataFrame(rows, schema)
    good = manifest(df, key="id", group="who", fields=("id", "who", "what"))
    assert good.filter("not verified").count() == 0 and good.select("root").distinct().count() == 1
    bad = manifest(df, key="id", group="who", fields=("id", "who", "what"), altered={"what": F.when(F.col("id") == 7, "other").otherwise(F.col("what"))})
    assert [r.id for r in bad.filter("not verified").collect()] == [7]
