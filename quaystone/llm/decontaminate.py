"""Benchmark decontamination: a prefix-filtered set join with exact checks.

An item's windows are runs of ``window`` consecutive words (an item of fewer
words is one window).  A document contains a window only if it contains all of
the window's shingles, so containment has threshold 1 and the necessary prefix
is a single shingle; taking the rarest one (by its count over all documents)
makes few documents candidates.  A match of the prefix shingle fixes where the
window would start; the length and positional bounds then discard windows that
would begin before or end after the document, and what is left is compared
word by word.

The benchmark is indexed in blocks of bounded size (``block_bytes`` of text),
so what is broadcast has a proven bound: an index takes some twelve times its
block's text.  Blocks are indexed, scanned and written one after another, so
one index exists at a time; documents are scanned once per block for the
rarity counts and once for the hits, and never shuffled while one block
suffices.

Edge cases: a null or empty text has no words, is hit nowhere and is not
contaminated; null or empty items have no windows; equal items all count; one
item beyond ``block_bytes`` is a block of its own; repeated document rows each
give a row; other columns pass through, but a kept column named like a result
gives way to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import applied, fresh, quoted, released, written
from .text import ALNUM, Words, grams, slices, word_list

SHINGLE = 5
WINDOW = 13
BLOCK_BYTES = 8 << 20

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks of bounded text size, by a hash of their content; one block is held at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("i is not null and t is not null").distinct()
    size, count = items.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    if (size or 0) <= block_bytes:
        yield [(r.i, r.t) for r in items.collect()]
        return
    n = int(size // block_bytes) + 1
    while True:
        n *= 2
        block = F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")
        over = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("t")).alias("s"), F.count("*").alias("n")).filter((F.col("s") > block_bytes) & (F.col("n") > 1))
        if n > 16 * count or over.isEmpty():
            break
    path = fresh(spark, "items")
    items.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(path)
    dealt = spark.read.parquet(path)
    for k in sorted(r.block for r in dealt.select("block").distinct().collect()):
        yield [(r.i, r.t) for r in dealt.filter(F.col("block") == k).collect()]


class _Index:
    """A block's distinct windows under their rarest shingle, in arrays.

    ``raw`` holds the words of all items, one space after each; word w of it
    starts at ``at[w]`` and has the hash ``h[w]``.  Window k is the ``lengths[k]``
    words from ``first[k]``; its items are ``owner[owns[k]:owns[k + 1]]``.
    """

    def __init__(self, items: list[tuple[str, str]], shingle: int, window: int):
        words = [word_list(t, ALNUM) for _, t in items]
        sizes = np.array([len(w) for w in words], np.int64)
        self.names = [i for i, _ in items]
        self.raw = b"".join(x + b" " for w in words for x in w)
        self.at = np.concatenate(([0], np.cumsum(np.fromiter((len(x) + 1 for w in words for x in w), np.int64, int(sizes.sum()))))).astype(np.int64)
        del words
        data = np.frombuffer(self.raw, np.uint8)
        self.h = Words(data, np.array([0, len(data)]), ALNUM).hashes()
        per = np.where(sizes > window, sizes - window + 1, np.minimum(sizes, 1))
        item = np.repeat(np.arange(len(items)), per)
        begin = np.cumsum(sizes) - sizes
        first = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        lengths = np.minimum(window, sizes)[item]
        one, two = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
        for n in np.unique(lengths).tolist():
            own = lengths == n
            one[own] = grams(self.h, n)[first[own]] + np.uint64(n)
            two[own] = grams(self.h ^ np.uint64(0x5BD1E9955BD1E995), n)[first[own]]
        order = np.lexsort((item, two, one))  # equal windows are one, by 128 bits
        new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))[: len(order)]
        heads = np.flatnonzero(new)
        self.first, self.lengths = first[order][heads], lengths[order][heads]
        self.owner, self.owns = item[order].astype(np.int32), np.concatenate((heads, [len(order)]))
        self.shingle = shingle
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.first)

    def wanted(self) -> dict[int, np.ndarray]:
        """The shingles of all windows, sorted, by their length."""
        out = {}
        for n in np.unique(np.minimum(self.shingle, self.lengths)).tolist():
            g = grams(self.h, n)
            own = np.minimum(self.shingle, self.lengths) == n
            inside = np.zeros(len(self.h) + 1, np.int64)  # where a shingle of such a window begins
            np.add.at(inside, self.first[own], 1)
            np.add.at(inside, self.first[own] + self.lengths[own] - n + 1, -1)
            out[n] = np.unique(g[np.flatnonzero(np.cumsum(inside)[: len(g)] > 0)])
        return out

    def choose(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Put every window under its rarest shingle; ``counts``: (shingles, sorted, and how often each occurs), by length."""
        for n, (keys, often) in counts.items():
            g = grams(self.h, n)
            where = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
            c = np.where(keys[where] == g, often[where], np.iinfo(np.int64).max) if len(keys) else np.zeros(len(g), np.int64)
            own = np.flatnonzero(np.minimum(self.shingle, self.lengths) == n)
            best, offset = self.first[own].copy(), np.zeros(len(own), np.int16)
            for j in range(1, int((self.lengths[own] - n).max(initial=0)) + 1):
                here = np.minimum(self.first[own] + j, len(g) - 1)
                less = (j <= self.lengths[own] - n) & ((c[here] < c[best]) | ((c[here] == c[best]) & (g[here] < g[best])))
                best[less], offset[less] = here[less], j
            order = np.argsort(g[best], kind="stable")
            self.tables[n] = (g[best][order], offset[order], own[order].astype(np.int32))

    def occurrences(self, data: np.ndarray, words: Words, h: np.ndarray, seen: dict) -> tuple[np.ndarray, np.ndarray]:
        """First words and window numbers of all exact occurrences in a slice."""
        doc = words.docs()
        found_at, found_w = [], []
        low = None
        for n, (keys, offs, wins) in self.tables.items():
            g = grams(h, n)
            lo = np.searchsorted(keys, g, "left")
            at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == g)
            if not len(at):
                continue
            lo = lo[at]
            many = np.searchsorted(keys, g[at], "right") - lo
            row = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pos, w = np.repeat(at, many), wins[row]
            start, doc_of = pos - offs[row], doc[pos]
            fits = (start >= words.bounds[doc_of]) & (start + self.lengths[w] <= words.bounds[doc_of + 1])
            start, w = start[fits], w[fits]
            for j in range(int(self.lengths[w].max(initial=0))):  # first by the words' hashes, for all at once
                same = (j >= self.lengths[w]) | (h[np.minimum(start + j, len(h) - 1)] == self.h[np.minimum(self.first[w] + j, len(self.h) - 1)])
                start, w = start[same], w[same]
            if not len(w):
                continue
            if low is None:
                low = data.tobytes().lower()
            starts, ends = words.starts, words.ends
            for s, k in zip(start.tolist(), w.tolist()):
                last = s + int(self.lengths[k]) - 1
                raw = low[starts[s] : ends[last]]
                same = seen.get((k, raw))
                if same is None:
                    own = b"".join(low[a:b] + b" " for a, b in zip(starts[s : last + 1].tolist(), ends[s : last + 1].tolist()))
                    same = own == self.raw[self.at[self.first[k]] : self.at[self.first[k] + self.lengths[k]]]
                    if len(seen) < 50_000:
                        seen[k, raw] = same
                if same:
                    found_at.append(s)
                    found_w.append(k)
        return np.array(found_at, np.int64), np.array(found_w, np.int64)

    def items(self, wins: list[int]) -> list[str]:
        """The ids of the items that have any of these windows, sorted."""
        return sorted({self.names[i] for k in wins for i in self.owner[self.owns[k] : self.owns[k + 1]].tolist()})


def _counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each of a block's shingles occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        total = {n: np.zeros(len(h), np.int64) for n, h in shared.value.items()}
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                h = Words(data, offsets, ALNUM).hashes()
                for n, keys in shared.value.items():
                    g = grams(h, n)
                    at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    total[n] += np.bincount(at[keys[at] == g], minlength=len(keys))
        for n, c in total.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n)), pa.array(k), pa.array(c[k])], ["n", "k", "c"])
        released()

    got = docs.select("text").mapInArrow(count, "n long, k long, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).toArrow()  # at most a block's shingles
    kind, place, c = (got.column(x).to_numpy() for x in ("n", "k", "c"))
    out = {}
    for n, keys in wanted.items():
        often = np.zeros(len(keys), np.int64)
        often[place[kind == n]] = c[kind == n]
        out[n] = (keys, often)
    return out


def _scan(docs: DataFrame, index: _Index, keep: list[str], spans: bool) -> DataFrame:
    """Per document: its words, and hit words and items of this block (as lists if ``spans``)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        index, seen = shared.value, {}
        for texts in batches:
            rows = len(texts)
            n_words, n_hit = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            hits, items = [[] for _ in range(rows)], [[] for _ in range(rows)]
            for first, data, offsets in slices(texts):
                words = Words(data, offsets, ALNUM)
                n = len(offsets) - 1
                n_words[first : first + n] = np.diff(words.bounds)
                at, w = index.occurrences(data, words, words.hashes(), seen)
                if not len(at):
                    continue
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + index.lengths[w], -1)
                hit = np.cumsum(mark[:-1]) > 0
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                n_hit[first : first + n] = np.diff(np.concatenate(([0], np.cumsum(hit)))[words.bounds])
                for d in np.unique(doc).tolist():
                    items[first + d] = index.items(np.unique(w[doc == d]).tolist())
                    if spans:
                        lo, hi = words.bounds[d], words.bounds[d + 1]
                        hits[first + d] = np.flatnonzero(hit[lo:hi]).tolist()
            if spans:
                yield [pa.array(n_words), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            else:
                yield [
                    pa.array(n_words), pa.array(n_hit), pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                    pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                ]
        released()

    return applied(docs, keep, scan, "n_words long, hits array<long>, items array<string>" if spans else RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: the ``keep`` columns, its words, hit words, items and verdict.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id`` and ``text``.
    """
    keep = keep if keep is not None else ["doc_id"]
    key = max(docs.columns, key=len, default="") + "_key"
    hit = keyed = None
    blocks = _blocks(benchmark, block_bytes)
    items, after = next(blocks), next(blocks, None)
    while items is not None:
        index = _Index(items, shingle, window)
        index.choose(_counts(docs, index.wanted()) if len(index) else {})
        if hit is None and after is None:
            return _scan(docs, index, keep, spans=False)
        if keyed is None:
            # Equal rows give equal positions, so grouping by content is safe.
            keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("t")), {"ignoreNullFields": "false"}), 256))
        found = written(_scan(keyed, index, [key], spans=True).filter("size(items) > 0").select(F.col(key).alias("key"), "hits", "items"), "hits")
        hit = found if hit is None else hit.unionByName(found)
        items, after = after, next(blocks, None)
    # A key's rows are one per block and copy, so a group is pre-aggregated by distinct rows first.
    hit = hit.distinct().groupBy("key").agg(
        F.array_size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    kept = [c for c in keep if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    base = _scan(keyed, _Index([], shingle, window), [*kept, key], spans=False).select(*[F.col(quoted(c)) for c in [*kept, key]], F.col("n_words"))
    got = base.join(hit, base[key] == hit["key"], "left")
    n_hit, items = F.coalesce(hit["n_hit"], F.lit(0).cast("long")), F.coalesce(hit["items"], F.array().cast("array<string>"))
    return got.select(
        *[base[quoted(c)] for c in kept], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
