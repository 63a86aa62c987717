"""Toxicity scores from a factorization machine over hashed terms.

Terms are words (runs of letters, A-Z lower-cased) and their beginnings of four
and six bytes, hashed to a fixed number of columns.  A text is the set of its
distinct words; each word adds its terms' linear weights and factor vectors, so
pairs of terms interact through their factors.  The model is fitted in numpy on
at most ``max_toxic`` and ``max_clean`` labelled rows (the ones with the least
hash of doc_id), weighted back to the base rate; scoring covers every whole text.

Edge cases: a null text is empty and gets the score of no terms at all; rows
without a label, or whose label is null, teach nothing; a doc_id labelled more
than once counts as toxic if any label says so; with no labels at all, every
score is the default rate.  Only ``text`` is ever an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import applied, released, written
from .text import _BYTE, Words, byte_class, mix, powers, slices

LETTERS = byte_class(lambda b: b >= 128 or 97 <= b <= 122 or 65 <= b <= 90)
COLUMNS = 1 << 22
BEGINNINGS = (4, 5, 6)
FACTORS = 6
MAX_TOXIC = 8000
MAX_CLEAN = 12000
#: A column is used if it is in this many sampled texts, and in this share of them or with this chi-square.
LEAST_TEXTS = 4
COMMON = 0.005
CHI_SQUARE = 6.6
DEFAULT_RATE = 0.05
#: Bytes of text scored at once.
SLICE = 1 << 20


def terms(words: Words, hashes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Hashed columns of the picked words: the word itself and its beginnings."""
    starts, lengths = words.starts[pick], words.ends[pick] - words.starts[pick]
    out = np.empty((len(pick), 1 + len(BEGINNINGS)), np.int64)
    out[:, 0] = (hashes & np.uint64(COLUMNS - 1)).astype(np.int64)
    for j, k in enumerate(BEGINNINGS, 1):
        h = np.full(len(pick), k << 40, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                at = np.minimum(starts + i, max(0, len(words.data) - 1))
                h += np.where(lengths > i, _BYTE[words.data[at]] * powers(k)[i], np.uint64(0))
        out[:, j] = (mix(h) & np.uint64(COLUMNS - 1)).astype(np.int64)
    return out


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's distinct words' terms, and (document, word number) of each distinct word of each document."""
    h = words.hashes()
    found, first, number = np.unique(h, return_index=True, return_inverse=True)
    pair = np.unique(words.docs() * len(first) + number) if len(h) else np.zeros(0, np.int64)
    return terms(words, found, first), pair // max(1, len(first)), pair % max(1, len(first))


@dataclass
class Machine:
    """``columns``: the sorted hashed columns in use; the others weigh nothing."""

    bias: float
    columns: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, data, offsets) -> np.ndarray:
        """Probability of toxicity for each text of a slice."""
        words = Words(data, offsets, LETTERS)
        n = len(offsets) - 1
        cols, doc, word = distinct(words)
        z = np.full(n, self.bias)
        if len(doc) and len(self.columns):
            at = np.minimum(np.searchsorted(self.columns, cols), len(self.columns) - 1)
            used = self.columns[at] == cols
            some = np.flatnonzero(used.any(axis=1))  # few words have a column in use
            number = np.full(len(cols), -1, np.int64)
            number[some] = np.arange(len(some))
            at, used = at[some], used[some]
            lin = (self.weights[at] * used).sum(axis=1)
            vec = self.factors[at] * used[:, :, None]
            own = (vec**2).sum(axis=(1, 2))
            vec = vec.sum(axis=1)
            word = number[word]
            live = word >= 0
            doc, word = doc[live], word[live]
            first = np.searchsorted(doc, np.arange(n))
            some = np.flatnonzero(np.diff(np.concatenate((first, [len(doc)]))))
            if len(some):
                add = lambda x: np.add.reduceat(x, first[some], axis=0)
                z[some] += add(lin[word]) + 0.5 * ((add(vec[word]) ** 2).sum(axis=1) - add(own[word]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, used: np.ndarray, alone: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, pair_rate: float = 0.002, l2: float = 1.0, seed: int = 3) -> Machine:
    """Fit by AdaGrad on the logistic loss.

    ``rows``: each text's columns as places in ``used``, with repeats;
    ``alone``: which of those have a weight of their own.
    """
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    gw, gv = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2)
    mean = np.clip(float((label * weight).sum() / weight.sum()), 1e-3, 0.999) if len(label) else DEFAULT_RATE
    bias = np.log(mean / (1 - mean))
    for _ in range(epochs if len(used) else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            col = np.concatenate([rows[p] for p in pick])
            doc = np.repeat(np.arange(len(pick)), [len(rows[p]) for p in pick])
            uses, local = np.unique(col, return_inverse=True)
            wu, vu = w[uses], v[uses]
            vc = vu[local]
            total = np.stack([np.bincount(doc, vc[:, f], len(pick)) for f in range(FACTORS)], axis=1)
            z = bias + np.bincount(doc, wu[local], len(pick)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(doc, (vc**2).sum(axis=1), len(pick)))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            gd = g[doc]
            decay = l2 / len(rows)
            grad = np.bincount(local, gd) + decay * wu
            gw[uses] += grad**2
            w[uses] = wu - rate * grad / np.sqrt(gw[uses]) * alone[uses]
            part = gd[:, None] * (total[doc] - vc)
            grad = np.stack([np.bincount(local, part[:, f]) for f in range(FACTORS)], axis=1) + decay * vu
            gv[uses] += grad**2
            v[uses] = vu - pair_rate * grad / np.sqrt(gv[uses])
            bias -= 0.1 * rate * float(g.sum())
    return Machine(float(bias), used, w, v)


def _featurized(texts):
    """(columns of all texts of a slice, how many each text has), slice by slice."""
    for _, data, offsets in slices(texts, SLICE):
        own, doc, word = distinct(Words(data, offsets, LETTERS))
        yield own[word].ravel(), own.shape[1] * np.bincount(doc, minlength=len(offsets) - 1)


def _columns(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns to use for the sampled ``texts`` (y, text), sorted, and which of them speak for the label by themselves.

    How many texts of each label have a column is counted by the tasks and
    summed by Spark.  Common columns take part in pairs only: their small
    weights would add up over a long text and outweigh a single insult.
    """

    def count(batches):
        seen = np.zeros((2, COLUMNS), np.int32)
        for batch in batches:
            y, at = batch.column(0).to_numpy(), 0
            for column, lengths in _featurized(batch.column(1)):
                doc = np.repeat(np.arange(len(lengths)), lengths)
                pair = np.unique(doc * COLUMNS + column)
                toxic = y[at + pair // COLUMNS] == 1
                at += len(lengths)
                for k, own in ((1, pair[toxic]), (0, pair[~toxic])):
                    np.add.at(seen[k], own % COLUMNS, 1)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["col", "clean", "toxic"])
        del seen
        released()

    size = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(size.values()), size.get(1, 0)
    found = texts.mapInArrow(count, "col long, clean int, toxic int").groupBy("col").agg(F.sum("toxic").alias("hits"), F.sum(F.col("clean") + F.col("toxic")).alias("texts"))
    got = found.filter(F.col("texts") >= LEAST_TEXTS).toArrow().sort_by("col")  # at most COLUMNS, and the sample's words / LEAST_TEXTS
    some, hits, has = (got.column(k).to_numpy() for k in ("col", "hits", "texts"))
    due = has * (toxic / max(n, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hits - due) ** 2 / due * n / max(n - toxic, 1) * n / np.maximum(n - has, 1)
    alone = (chi >= CHI_SQUARE) & (hits > due)
    kept = alone | (has >= COMMON * n)
    return some[kept], alone[kept]


def learn(docs: DataFrame, labels: DataFrame, may_learn=None, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that ``may_learn`` (a condition on doc_id) admits."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    most = {1: max_toxic, 0: max_clean}
    sample = known.filter("y = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(max_clean))
    # The sample is at most max_toxic + max_clean pairs of numbers, so it is broadcast; of rows that repeat a doc_id one teaches.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    texts = written(texts.select("y", F.coalesce("text", F.lit("")).alias("text")), "sample")
    used, alone = _columns(texts)
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def places(batches):
        for batch in batches:
            out = []
            for column, lengths in _featurized(batch.column(1)):
                at = np.minimum(np.searchsorted(shared.value, column), max(0, len(shared.value) - 1))
                hit = shared.value[at] == column if len(shared.value) else np.zeros(len(column), bool)
                ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
                raw = at[hit].astype(np.int32).tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "cols"])

    got = texts.mapInArrow(places, "y int, cols binary").toArrow()
    y = got.column("y").to_numpy().astype(float)
    rows = [np.frombuffer(b.as_py(), np.int32) for b in got.column("cols")]
    del got
    weight = np.array([n.get(int(c), 0) / max(1, min(n.get(int(c), 0), most[int(c)])) for c in y])
    if len(weight):
        weight *= len(weight) / weight.sum()
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i]), rows[i][:8].tolist()))  # whatever order they came in
    return fit([rows[i] for i in order], y[order], weight[order], used, alone)


def score(docs: DataFrame, machine: Machine, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """The ``keep`` columns, ``score`` and ``predicted`` for every row of ``docs``; a kept column of these names gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for texts in batches:
            out = np.zeros(len(texts))
            for first, data, offsets in slices(texts, SLICE):
                out[first : first + len(offsets) - 1] = shared.value.scores(data, offsets)
            yield [pa.array(out), pa.array((out >= threshold).astype(np.int32))]
        released()

    return applied(docs, keep, run, "score double, predicted int")
