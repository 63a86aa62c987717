"""MinHash near-duplicates with tensored banding and exact verification.

A document is the set of its distinct word shingles.  Two collections A and B
of ``m`` partial keys, each made of ``t`` minhashes, are computed: 2*m*t
minhashes.  Every pair (A_i, B_j) is the key of one of m*m tables with 2*t
minhashes a key, which would otherwise need m*m*2*t of them.  Documents of
similarity s share a table with probability (1 - (1 - s**t)**m)**2, 0.998 at
0.8 for m = 10, t = 3.

Equal sets are one class (compared by 128 bits and size) that its smallest
doc_id stands for, so copies are never expanded.  Candidates are compared in
rounds: first each class with one pivot of its tables, then, only in tables
that still hold several components, with other pivots.  What is still open
after these rounds is finished by an exact prefix filter: of each class's
shingles, rarest first, only as many are joined as one of them must be shared,
with bounds from sizes and positions, and only across components; so families
that share a passage, or copies that differ too much, need no all-pairs step.
A pair is a link only if the full shingle sets of both texts have
100 * intersection >= 100 * threshold * union.

Hot keys: a table's members meet its pivot in a join of two longs and a pivot
with very many candidates has its text dealt to several tasks (``HUB``);
counts are summed before they are shuffled.

Edge cases: texts of fewer words than a shingle are their whole word sequence;
null or empty texts have no shingles and link with nothing; a null doc_id gets
a null component and is kept; a doc_id that can't be read as a number counts
as null; rows that repeat a doc_id are one document of several texts: it links
all that any of them links; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import applied, partitions, released, written
from .text import NONSPACE, Words, grams, mix, slices

TABLES_SIDE = 10
PER_KEY = 3
PIVOT_ROUNDS = 2
#: Bits of the filter that keeps texts without candidates out of the shuffle; beyond its use, only speed suffers.
FILTER_BITS = 1 << 26
#: Classes whose table keys one task makes.
TASK_CLASSES = 8000
#: Candidates of one class that one task compares.
HUB = 2000
#: Bytes of text signed at once.
SLICE = 1 << 20


def doc_shingles(words: Words, h: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice and the first of each document (one more at the end)."""
    counts = np.diff(words.bounds)
    per = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    firsts = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(int(firsts[-1]), np.uint64)
    full = counts >= shingle
    g = grams(h, shingle)
    at = np.arange(len(out)) + np.repeat(words.bounds[:-1] - firsts[:-1], per)
    long = np.repeat(full, per)
    out[long] = g[at[long]]
    for d in np.flatnonzero(~full & (counts > 0)):
        out[firsts[d]] = grams(h[words.bounds[d] : words.bounds[d + 1]], int(counts[d]))[0]
    return out, firsts


def _sets(column, shingle: int):
    """Each text's sorted distinct shingle hashes, in order."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, NONSPACE)
        g, firsts = doc_shingles(words, words.hashes(), shingle)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            yield np.unique(g[a:b])


def signatures(docs: DataFrame, shingle: int, side: int = TABLES_SIDE, per_key: int = PER_KEY) -> DataFrame:
    """(doc_id, t, n, s1, s2, a, b): hash of the text, set size, 128-bit set signature, and both collections of partial keys."""
    rng = np.random.default_rng(20240607)
    mult = rng.integers(1, 2**63, 2 * side * per_key, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, 2 * side * per_key, dtype=np.uint64)

    def sign(texts):
        for column in texts:
            n, s1, s2, keys = [], [], [], []
            for _, data, offsets in slices(column, SLICE):
                words = Words(data, offsets, NONSPACE)
                g, firsts = doc_shingles(words, words.hashes(), shingle)
                sets = [np.unique(g[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                n.append(size)
                sums = np.zeros((2, len(size)), np.uint64)
                part = np.zeros((len(size), 2 * side), np.uint64)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    sums[0, some] = np.add.reduceat(mix(flat), at)
                    sums[1, some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    with np.errstate(over="ignore"):
                        for k in range(2 * side):
                            key = np.full(len(some), k + 1, np.uint64)
                            for j in range(k * per_key, (k + 1) * per_key):
                                key = mix(key * np.uint64(31) + np.minimum.reduceat(flat * mult[j] ^ ((flat >> np.uint64(29)) * add[j]), at))
                            part[some, k] = key
                s1.append(sums[0])
                s2.append(sums[1])
                keys.append(part)
            flat = lambda x, kind: np.concatenate([*x, np.zeros((0, *kind), np.uint64)]).view(np.int64)
            keys = flat(keys, (2 * side,))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * side, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
            yield [pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(flat(s1, ())), pa.array(flat(s2, ())), lists(keys[:, :side]), lists(keys[:, side:])]
        released()

    own = docs.select(F.expr("try_cast(doc_id as bigint)").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return applied(own, ["doc_id", "t"], sign, "n long, s1 long, s2 long, a array<long>, b array<long>")


def _touched(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, t, text) of the documents in ``rows`` (doc_id, t) and a few more, without a shuffle of all texts."""
    bit = F.pmod(F.xxhash64("doc_id", "t"), F.lit(FILTER_BITS))
    bits = rows.select(bit.alias("k")).groupBy(F.shiftright("k", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(k & 63 as int)))").alias("v")).toArrow()
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[bits.column("w").to_numpy()] = bits.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def wanted(k: pa.Array) -> pa.Array:
        k = k.to_numpy(zero_copy_only=False)
        return pa.array(((shared.value[k >> 6] >> (k & 63)) & 1).astype(bool))

    own = docs.select(F.expr("try_cast(doc_id as bigint)").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return own.filter("doc_id is not null").filter(wanted(bit))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the candidate pairs of classes (x, y), those whose full sets are similar enough; x and y are then their documents.

    A class x with over ``HUB`` candidates has its text dealt to as many tasks
    as it takes, each with its own share of the candidates.
    """
    left, right = (texts.select(F.col("cid").alias(c), F.col("rep").alias(f"d{c}"), F.col("text").alias(f"t{c}")) for c in "xy")

    def check(batches):
        last, own = None, None
        for batch in batches:
            tx = batch.column(2)
            ok = np.zeros(len(batch), bool)
            for i, other in enumerate(_sets(batch.column(3), shingle)):
                text = tx[i].as_py()
                if own is None or text != last:
                    last, own = text, next(_sets(pa.array([text], pa.string()), shingle))
                both = len(np.intersect1d(own, other, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(ok))
        released()

    hubs = pairs.groupBy("x").agg(F.count("*").alias("c")).filter(F.col("c") > HUB)
    if hubs.isEmpty():
        both = pairs.join(right, "y").join(left, "x")
    else:
        share = F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("y"), F.floor(F.col("c") / HUB) + 1))
        dealt = written(pairs.join(hubs, "x", "left").select("x", "y", share.cast("long").alias("share")), "dealt")
        both = dealt.join(right, "y").join(dealt.select("x", "share").distinct().join(left, "x"), ["x", "share"])
    return both.select("dx", "dy", "tx", "ty").mapInArrow(check, "x long, y long")


def _prefix_pairs(open_rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (x, y) of open classes of different components that may be similar enough: none that is can be missing."""
    nodes = open_rows.select("cid", "n", "comp").distinct()

    def explode(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column(3), shingle))
                row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column(i).take(row) for i in range(3)] + [pa.array(np.concatenate(sets).view(np.int64))], ["cid", "n", "comp", "h"])
        released()

    own = nodes.join(texts, "cid").select("cid", "n", "comp", "text")
    tokens = written(own.mapInArrow(explode, "cid long, n long, comp long, h long"), "tokens")
    # A shingle of one class only can't make a pair, but it takes a place in the prefix.
    shared = tokens.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    rarest = Window.partitionBy("cid").orderBy("c", "h")
    ranked = tokens.join(shared, "h").withColumn("rank", F.row_number().over(rarest) + F.col("n") - F.count("*").over(Window.partitionBy("cid")))
    prefix = written(ranked.filter(F.col("rank") * 100 <= F.col("n") * (100 - percent) + 100).select("h", "cid", "n", "comp", "rank"), "prefix")
    other = prefix.select("h", F.col("cid").alias("y"), F.col("n").alias("m"), F.col("comp").alias("to"), F.col("rank").alias("at"))
    left = F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("at")) + 1
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent) & (left * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    pairs = prefix.alias("p").join(other.alias("o"), (prefix["h"] == other["h"]) & (F.col("comp") < F.col("to")) & fits)
    return pairs.select(F.least("cid", "y").alias("x"), F.greatest("cid", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, side: int = TABLES_SIDE, per_key: int = PER_KEY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document row."""
    spark = docs.sparkSession
    percent = round(100 * threshold)
    signed = written(signatures(docs, shingle, side, per_key), "signatures")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "t", "a", "b")).alias("r")).select("s1", "s2", "n", F.col("r.doc_id").alias("rep"), "r.t", "r.a", "r.b")
    often = some.groupBy("doc_id").agg(F.count("*").alias("rows"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("s1", "s2", "n") for f in (F.min, F.max)]).filter("rows > 1")
    repeated = not often.isEmpty()
    # A class's number is in the order of its document, so that all choose the same pivots; writing fixes it.
    classes = classes.orderBy("rep", "t").withColumn("cid", F.monotonically_increasing_id()) if repeated else classes.withColumn("cid", F.col("rep"))
    classes = written(classes, "classes")

    # What a repeated doc_id links: its classes' documents.
    links, tried, labels = None, None, None
    if repeated:
        several = often.filter("s1_min < s1_max or s2_min < s2_max or n_min < n_max").select("doc_id")
        links = written(some.select("doc_id", "s1", "s2", "n").distinct().join(several, "doc_id").join(classes, ["s1", "s2", "n"]).select(F.col("doc_id").alias("x"), F.col("rep").alias("y")).distinct(), "own")
        labels = components(links)

    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * side + j))))
    tasks = max(partitions(spark) // 8, classes.count() // TASK_CLASSES + 1)  # a class becomes side * side rows
    rows = classes.select("cid", "rep", "n", "a", "b").repartition(tasks, "cid").select("cid", "rep", "n", F.explode(keys).alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = written(rows.join(full, "key").select("key", "cid", "rep", "n"), "tables")

    met = members.select("cid").distinct().join(classes.select("cid", "rep", "t"), "cid")
    texts = _touched(docs, met.select(F.col("rep").alias("doc_id"), "t")).join(met.withColumnRenamed("rep", "doc_id"), ["doc_id", "t"]).select("cid", F.col("doc_id").alias("rep"), "text")
    if repeated:  # equal rows are one
        texts = texts.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("rep"))).filter("k = 1").drop("k")
    texts = written(texts, "texts")
    for step in range(PIVOT_ROUNDS + 1):
        open_rows = members.withColumn("comp", F.col("rep"))
        if labels is not None:
            open_rows = members.join(labels, members["rep"] == labels["node"], "left").select("key", "cid", "rep", "n", F.coalesce("component", "rep").alias("comp"))
            mixed = open_rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
            open_rows = written(open_rows.join(mixed, "key"), "open")
            if open_rows.isEmpty():
                break
        near = (F.col("n") * 100 >= F.col("pn") * percent) & (F.col("pn") * 100 >= F.col("n") * percent)
        if step < PIVOT_ROUNDS:
            order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
            pivots = open_rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("cid").alias("pivot"), F.col("n").alias("pn"), F.col("comp").alias("pc"))).alias("p")).select("key", "p.pivot", "p.pn", "p.pc")
            pairs = open_rows.join(pivots, "key").filter((F.col("comp") != F.col("pc")) & near)
            pairs = pairs.groupBy("cid").agg(F.min("pivot").alias("pivot")).select(F.col("pivot").alias("x"), F.col("cid").alias("y"))
        else:
            pairs = _prefix_pairs(open_rows, texts, shingle, percent)
        if tried is not None:
            pairs = pairs.join(tried, (F.least("x", "y") == F.col("lo")) & (F.greatest("x", "y") == F.col("hi")), "left_anti")
        pairs = written(pairs, "pairs")
        found = written(_verified(pairs, texts, shingle, percent), "links")
        links = found if links is None else links.unionByName(found)
        pairs = pairs.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(links)
    comp = classes.join(labels, classes["rep"] == labels["node"], "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(comp, ["s1", "s2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
