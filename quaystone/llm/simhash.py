"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint bit is 1 if set in over half the XXH64 hashes of a text's word
shingles, repeats included.  Two fingerprints link at ``bits`` or fewer
differing bits.  Equal fingerprints are one class, so copies are never
expanded; classes are found, linked and labelled as Spark tables.

The index.  Fingerprints are sorted by Gray rank, in which neighbours differ
in few bits and equal leading bits stay together.  Eight neighbours make a node
that holds the bits all of them share (a mask and a pattern), eight nodes
an upper one, and so on; a node keeps only the bits that its parent hasn't
already.  A search goes down from the root and adds up the differences between
the query and the bits of each node on its way; a node whose sum is too high is
dropped with all below it.  Of two fingerprints that differ in ``bits``, one
half of the 64 differs in at most ``bits // 2``.  So the index is kept in two
orders, each half leading once, and a node is also dropped where over
``bits // 2`` of the leading half's bits differ.  That is exact, and leaves
some 1 + k of 2**k equally filled nodes a level (for 3 bits) rather than the
k**3 / 6 of one order.

On a cluster each order is cut into ranges of Gray rank, one a task.  A range is
itself a node: its mask and pattern go to the driver (three numbers a range of
``TASK_CODES`` fingerprints), where the upper levels are built and sent to all
tasks.  A search through them finds the ranges a fingerprint must visit; of two
ranges that could hold partners only one, chosen by a hash, visits the other.
A task builds the index of its range, searches it for its own fingerprints and
streams the visitors through it, so memory holds one range.  Fingerprints that
are already in one component are not compared again, and a task returns no more
links than it read fingerprints.

Edge cases: a text of fewer words than a shingle is its whole word sequence; a
null, empty or blank text has fingerprint zero and links like any other; a null
doc_id links with nothing and has a null component; rows that repeat a doc_id
are one document that links all that any of them links; doc_id may be of any
type with an order; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .shared import applied, partitions, released, written
from .text import mix, slices

SEED = 42
#: Fingerprints of one range, at most (but for the sampling of bounds).
TASK_CODES = 1 << 18
#: Children of a node.
FAN = 8
#: Pairs of query and node looked at together.
PAIRS = 1 << 17
#: A class with over so many parts of all rows is joined by broadcast (there are at most as many such classes).
HOT = 1000

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGN = np.uint64(1 << 63)
_LEAD = np.uint64(0xFFFFFFFF00000000)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(raw: bytes, shingle: int, block: int = 1 << 16) -> int:
    """The fingerprint of one text (UTF-8)."""
    words = raw.translate(_LOW).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        if len(words) < shingle:
            parts = [b" ".join(words)]
        else:
            part = words[at : at + block + shingle - 1]
            parts = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        h = np.array([xxh64_intdigest(p, SEED) for p in parts], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """The ``keep`` columns and ``code``: each text's fingerprint as a signed long."""

    def run(texts):
        for column in texts:
            out = [np.zeros(0, np.uint64)]
            for _, data, offsets in slices(column):
                raw = data.tobytes()
                out.append(np.array([simhash(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64))
            yield [pa.array(np.concatenate(out).view(np.int64))]
        released()

    return applied(docs, keep, run, "code long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(k))
    return code


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def turned(code: np.ndarray) -> np.ndarray:
    """The halves of each code, exchanged."""
    return (code << np.uint64(32)) | (code >> np.uint64(32))


class Index:
    """A tree over nodes in Gray order, given by pattern and mask; a fingerprint is a node whose mask has all bits."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray, bits: int):
        self.bits, self.n = bits, len(pattern)
        levels = [(pattern & mask, mask)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            first = np.arange(0, len(pattern), FAN)
            shared = np.bitwise_and.reduceat(mask, first)
            differ = np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first)
            shared &= ~differ
            levels.append((pattern[first] & shared, shared))
        self.levels = []  # (pattern, bits the parent hasn't), leaves first
        for k, (pattern, mask) in enumerate(levels):
            known = np.repeat(levels[k + 1][1], FAN)[: len(mask)] if k + 1 < len(levels) else np.zeros(len(mask), np.uint64)
            self.levels.append((pattern, mask & ~known))
        self.low = self.high = None

    def label(self, labels: np.ndarray) -> None:
        """Each node's smallest and largest component: a search leaves out nodes that are the query's own."""
        self.low, self.high = [labels], [labels]
        for _ in self.levels[1:]:
            first = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.minimum.reduceat(self.low[-1], first))
            self.high.append(np.maximum.reduceat(self.high[-1], first))

    def search(self, codes: np.ndarray, own: np.ndarray | None = None, place: np.ndarray | None = None):
        """Yield (query, leaf) arrays of what is near enough, some at a time.

        ``own`` has the component of each query (-1: none), and may change
        between yields, as labels may; with ``place``, only leaves after it count.
        """
        top = len(self.levels) - 1
        roots = len(self.levels[top][0])
        pending = []
        for at in range(0, len(codes), PAIRS // FAN):
            q = np.arange(at, min(len(codes), at + PAIRS // FAN))
            pending.append((top, np.repeat(q, roots), np.tile(np.arange(roots), len(q)), None))
        pending.reverse()
        while pending:
            level, q, node, sums = pending.pop()
            pattern, bits = self.levels[level]
            keep = np.ones(len(q), bool)
            if own is not None and self.low is not None:
                keep = ~((self.low[level][node] == own[q]) & (self.high[level][node] == own[q]))
            if place is not None:
                keep &= (node + 1) * FAN**level - 1 > place[q]
            q, node = q[keep], node[keep]
            x = (codes[q] ^ pattern[node]) & bits[node]
            lead, total = np.bitwise_count(x & _LEAD), np.bitwise_count(x)
            if sums is not None:
                lead, total = lead + sums[0][keep], total + sums[1][keep]
            near = (lead <= self.bits // 2) & (total <= self.bits)
            q, node, lead, total = q[near], node[near], lead[near], total[near]
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(q), PAIRS // FAN):
                part = slice(at, at + PAIRS // FAN)
                child = (node[part, None] * FAN + np.arange(FAN)).ravel()
                there = child < below
                each = lambda a: np.repeat(a[part], FAN)[there]  # noqa: B023, E731
                pending.append((level - 1, each(q), child[there], (each(lead), each(total))))


class _Groups:
    """Labels of numbers 0 .. n-1 that merge: the smallest number of each component."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def merge(self, x: np.ndarray, y: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.labels[x], self.labels[y]
            apart = a != b
            if not apart.any():
                return changed
            changed = True
            up = np.arange(len(self.labels))
            np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(further := up[up], up):
                up = further
            self.labels = up[self.labels]


class _Range:
    """The index of one range of Gray ranks, and what its searches link."""

    def __init__(self, ranks: list[np.ndarray], bits: int):
        self.codes = gray_code(np.concatenate(ranks))
        self.index = Index(self.codes, np.full(len(self.codes), _ALL), bits)
        self.groups = _Groups(len(self.codes))
        self.own = self.groups.labels.copy()
        self._relabel()
        for q, leaf in self.index.search(self.codes, self.own, np.arange(len(self.codes))):
            if self.groups.merge(q, leaf):
                self._relabel()

    def _relabel(self) -> None:
        self.own[:] = self.groups.labels
        self.index.label(self.groups.labels)

    def visit(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of visitors that link, each with one it links; others they link become one component here."""
        codes = gray_code(ranks)
        met = np.full(len(codes), -1)
        own = np.full(len(codes), -1)
        for q, leaf in self.index.search(codes, own):
            order = np.argsort(q, kind="stable")
            q, leaf = q[order], leaf[order]
            again = q[1:] == q[:-1]
            fresh = met[q] < 0
            changed = self.groups.merge(leaf[1:][again], leaf[:-1][again])
            changed |= self.groups.merge(leaf[~fresh], met[q[~fresh]])
            met[q[fresh]] = leaf[fresh]
            if changed:
                self._relabel()
            own[met >= 0] = self.groups.labels[met[met >= 0]]
        some = met >= 0
        return codes[some], self.codes[met[some]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        labels = self.groups.labels
        some = labels != np.arange(len(labels))
        return self.codes[some], self.codes[labels[some]]


def _signed(rank: np.ndarray) -> np.ndarray:
    """Unsigned numbers as longs of the same order."""
    return (rank ^ _SIGN).view(np.int64)


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN


def _ordered(codes: DataFrame, ranges: int) -> DataFrame:
    """(turn, part, rank): every code in both orders, cut into ranges of Gray rank, sorted."""

    @F.arrow_udf("array<struct<turn int, rank long>>")
    def both(c: pa.Array) -> pa.Array:
        code = c.to_numpy(zero_copy_only=False).view(np.uint64)
        rank = np.stack((gray_rank(code), gray_rank(turned(code))), axis=1).ravel()
        fields = pa.StructArray.from_arrays([pa.array(np.tile(np.array([0, 1], np.int32), len(code))), pa.array(_signed(rank))], names=["turn", "rank"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * 2), fields)

    rows = codes.select(F.explode(both("code")).alias("r")).select("r.turn", "r.rank")
    dealt = rows.repartitionByRange(ranges, "turn", "rank").sortWithinPartitions("turn", "rank")
    return written(dealt.select("turn", F.spark_partition_id().alias("part"), "rank"), "gray")


def _tops(ordered: DataFrame) -> DataFrame:
    """(turn, part, every, any_): the bits that all and that any of a range's codes have."""

    def run(batches):
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            turn, part = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            code = gray_code(_unsigned(batch.column(2)))
            place = part * 2 + turn
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
            for i, every, some in zip(first.tolist(), np.bitwise_and.reduceat(code, first).tolist() if len(place) else [], np.bitwise_or.reduceat(code, first).tolist() if len(place) else []):
                own = held.setdefault((int(turn[i]), int(part[i])), [every, some])
                own[0] &= every
                own[1] |= some
        keys = sorted(held)
        numbers = lambda i: pa.array(np.array([held[k][i] for k in keys], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), numbers(0), numbers(1)], ["turn", "part", "every", "any_"])

    own = ordered.mapInArrow(run, "turn int, part int, every long, any_ long")
    return own.groupBy("turn", "part").agg(F.bit_and("every").alias("every"), F.bit_or("any_").alias("any_"))


def links(codes: DataFrame, bits: int = 3) -> DataFrame:
    """(x, y): links between the distinct ``codes`` (``code`` long) that join all of ``bits`` or fewer differing bits, directly or by others."""
    spark = codes.sparkSession
    ranges = max(partitions(spark), codes.count() * 2 // TASK_CODES + 1)
    ordered = _ordered(codes, ranges)
    tops = _tops(ordered).orderBy("turn", "part").toArrow()
    turn, part, every, some = (tops.column(i).to_numpy() for i in range(4))
    every, some = every.view(np.uint64), some.view(np.uint64)
    parts = [part[turn == t] for t in (0, 1)]
    upper = [Index(every[turn == t], ~(every ^ some)[turn == t], bits) if (turn == t).any() else None for t in (0, 1)]
    sent = spark.sparkContext.broadcast((parts, upper))

    def route(batches):
        parts, upper = sent.value
        for batch in batches:
            turns, own, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(own), np.int32)), rank], ["turn", "part", "visits", "rank"])
            for t in (0, 1):
                at = np.flatnonzero(turns == t)
                codes = gray_code(_unsigned(rank.take(pa.array(at))))
                for q, leaf in upper[t].search(codes) if len(at) else ():
                    here, there = own[at[q]], parts[t][leaf].astype(np.int64)
                    low, high = np.minimum(here, there).astype(np.uint64), np.maximum(here, there).astype(np.uint64)
                    up = (mix(low * np.uint64(0x100000001) + (high << np.uint64(20))) & np.uint64(1)) == 0
                    go = (here != there) & ((here < there) == up)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(go.sum()), t, np.int32)), pa.array(there[go].astype(np.int32)), pa.array(np.ones(int(go.sum()), np.int32)), rank.take(pa.array(at[q[go]]))], ["turn", "part", "visits", "rank"]
                    )

    def link(batches):
        place, ranks, held = None, [], None
        pairs = lambda x, y, t: pa.RecordBatch.from_arrays([pa.array((turned(c) if t else c).view(np.int64)) for c in (x, y)], ["x", "y"])
        for batch in batches:
            turn, part, visits = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            rank = _unsigned(batch.column(3))
            key = (part * 2 + turn) * 2 + visits
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if place != (now := (int(part[a]), int(turn[a]))):
                    if ranks and held is None:
                        held = _Range(ranks, bits)
                    if held is not None:
                        yield pairs(*held.links(), place[1])
                    place, ranks, held = now, [], None
                if not visits[a]:
                    ranks.append(rank[a:b])
                    continue
                if held is None:
                    held = _Range(ranks, bits)
                yield pairs(*held.visit(rank[a:b]), now[1])
        if ranks and held is None:
            held = _Range(ranks, bits)
        if held is not None:
            yield pairs(*held.links(), place[1])
        released()

    routed = ordered.mapInArrow(route, "turn int, part int, visits int, rank long")
    dealt = routed.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "turn", "visits", "rank")
    return written(dealt.mapInArrow(link, "x long, y long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document row; component_id is the smallest doc_id reachable."""
    signed = written(fingerprints(docs, ["doc_id"], shingle), "codes")
    some = signed.filter("doc_id is not null")
    classes = written(some.groupBy("code").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    found = links(classes.select("code"), bits)
    often = some.groupBy("doc_id").agg(F.min("code").alias("x"), F.max("code").alias("most")).filter("x < most").select("doc_id", "x")
    if not often.isEmpty():
        found = found.unionByName(some.join(often, "doc_id").select("x", F.col("code").alias("y")).distinct())
    labels = written(components(found), "labels")
    reps = labels.join(classes, F.col("node") == F.col("code")).groupBy("component").agg(F.min("rep").alias("least"))
    linked = labels.join(reps, "component").select(F.col("node").alias("code"), "least")
    named = written(classes.join(linked, "code", "left").select("code", F.coalesce("least", "rep").alias("component_id"), "rows"), "named")
    # A class of very many rows is joined by broadcast, so that no task holds all its copies.
    total = named.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(named.filter(F.col("rows") * HOT > total).drop("rows"))
    rest = some.join(hot, "code", "left_anti").join(named.drop("rows"), "code")
    out = some.join(hot, "code").unionByName(rest, allowMissingColumns=True).unionByName(signed.filter("doc_id is null").withColumn("component_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
