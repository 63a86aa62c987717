"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words split at white space, A-Z lower-cased, then one end a text.
Words are counted over all training texts.  The model predicts a class: one of
the most frequent words, or what a rarer word ends with (its last two bytes,
hashed to a fixed number of shapes); within a shape, words share its
probability by their counts, an unseen word having one.  Class probabilities
are normalised: a context's prediction is the sum of its words' context
vectors, each scaled by the weights of its place, and batched matrix products
with all target vectors give the scores that a softmax turns into logs.

Training: a start on a bounded sample of texts, then one pass over every
training text, each partition from the same start, and the mean of their
parameters weighted by tokens.  Counts: words are identified by 64-bit hashes.
Words with a count over N / 2**20 are at most 2**20 and are broadcast; the
tokens of all others look up their counts through a join.

Edge cases: a null text is the empty text, which is one end; a null doc_id is
neither held out nor learned from; repeated rows each count and each get a
row; with nothing to learn from, all tokens are unknown; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc, written
from .text import NONSPACE, Words, slices

END = 1
TOP = 192
SHAPES = 64
CONTEXT = 3
WIDTH = 24
NOISE = 32
BROADCAST_WORDS = 1 << 20
SAMPLE_TEXTS = 2000
BATCH = 4096
#: Contexts predicted at once; their scores stay in a core's cache.
CONTEXTS = 512


def tokens(data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of a slice's tokens with ends, and the first token of each text (one more at the end)."""
    words = Words(data, offsets, NONSPACE)
    h, n = words.hashes(), len(offsets) - 1
    h[h == END] = END + 1
    last = data[words.ends - 1] if len(h) else np.zeros(0, np.uint8)
    prior = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0) if len(h) else last
    low = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.int64)
    shape = (low(last) * 31 + low(prior) * 17 + (low(last) * low(prior) >> 5)) % SHAPES
    ends = words.bounds[1:]
    first = words.bounds + np.arange(n + 1)
    return np.insert(h, ends, np.uint64(END)), np.insert(shape, ends, 0), first


@dataclass
class Statistics:
    """What is counted over all training texts; the tables are sorted by hash."""

    n: int
    distinct: int
    top: np.ndarray  # hashes of the words that are classes of their own
    hashes: np.ndarray  # of the frequent words
    counts: np.ndarray
    mass: np.ndarray  # by class: what its words' counts + 1 sum to (shapes: one more, for what is unseen)

    def classes(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.top, h), max(0, len(self.top) - 1))
        return np.where(self.top[at] == h, at, TOP + shape) if len(self.top) else TOP + shape


def count_words(docs: DataFrame) -> DataFrame:
    """(h, shape, c): each distinct token of ``text`` and its count."""

    def count(batches):
        for batch in batches:
            parts = [tokens(d, o)[:2] for _, d, o in slices(batch.column(0))]
            if not parts:
                continue
            h, first, c = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
            shape = np.concatenate([p[1] for p in parts])[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(shape), pa.array(c)], ["h", "shape", "c"])

    return docs.select("text").mapInArrow(count, "h long, shape int, c long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


def statistics(counts: DataFrame) -> Statistics:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    often = counts.filter(F.col("c") * BROADCAST_WORDS > n).toArrow()
    h, c, shape = (often.column(k).to_numpy() for k in ("h", "c", "shape"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, c, shape = h[order], c[order], shape[order]
    lead = np.lexsort((h, -c))[:TOP]
    if (h == END).any() and not (h[lead] == END).any():
        lead = np.concatenate((lead[:-1], np.flatnonzero(h == END)))
    lead = np.sort(lead)
    mass = np.ones(TOP + SHAPES)
    mass[: len(lead)] = c[lead] + 1
    for r in counts.groupBy("shape").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[TOP + r.shape] += r.m
    np.subtract.at(mass, TOP + shape[lead], c[lead] + 1.0)
    return Statistics(n, v, h[lead], h, c, mass)


class Bilinear:
    """The parameters, and what they predict."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 11):
        k = TOP + SHAPES
        self.shapes = [(k, WIDTH), (k, WIDTH), (CONTEXT, WIDTH), (k,)]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.1, 2 * k * WIDTH), np.full(CONTEXT * WIDTH, 1 / CONTEXT), np.zeros(k)]).astype(np.float32)
        self.flat = flat
        out, at = [], 0
        for s in self.shapes:
            size = int(np.prod(s))
            out.append(flat[at : at + size].reshape(s))
            at += size
        self.context, self.target, self.place, self.bias = out

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """Predicted vectors of contexts (rows of CONTEXT classes)."""
        q = self.context[contexts[:, 0]] * self.place[0]
        for c in range(1, CONTEXT):
            q += self.context[contexts[:, c]] * self.place[c]
        return q

    def logs(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logs of the targets' normalised probabilities."""
        base = TOP + SHAPES
        key = contexts.astype(np.int64) @ (base ** np.arange(CONTEXT))
        uses, number = np.unique(key, return_inverse=True)
        distinct = (uses[:, None] // base ** np.arange(CONTEXT)) % base
        out = np.empty(len(targets), np.float32)
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(0, len(uses) + CONTEXTS, CONTEXTS))
        weights = np.ascontiguousarray(np.vstack((self.target.T, self.bias[None])))
        q = np.ones((len(uses), WIDTH + 1), np.float32)
        q[:, :WIDTH] = self.predict(distinct)
        for i in range(0, len(uses), CONTEXTS):
            z = q[i : i + CONTEXTS] @ weights
            z -= z.max(axis=1, keepdims=True)
            mine = order[bounds[i // CONTEXTS] : bounds[i // CONTEXTS + 1]]
            row = number[mine] - i
            out[mine] = z[row, targets[mine]]
            out[mine] -= np.log(np.exp(z, out=z).sum(axis=1))[row]
        return out


def contexts(cls: np.ndarray, first: np.ndarray, end_class: int) -> np.ndarray:
    """The classes before each token; before the text there are ends."""
    out = np.full((len(cls), CONTEXT), end_class, np.int64)
    begin = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(cls))
    for k in range(1, CONTEXT + 1):
        ok = at - k >= begin
        out[ok, k - 1] = cls[at[ok] - k]
    return out


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.int16), kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    into[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


class Trainer:
    """Noise-contrastive estimation by AdaGrad, a batch of tokens at a time."""

    def __init__(self, model: Bilinear, noise: np.ndarray, rate: float, seed: int):
        self.m, self.rate, self.rng, self.noise = model, rate, np.random.default_rng(seed), noise
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.squares = np.full(len(model.flat), 1.0, np.float32)
        self.seen = 0

    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        m, b = self.m, len(target)
        drawn = np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1])
        q = m.predict(ctx)
        good = (q * m.target[target]).sum(axis=1) + m.bias[target] - self.log_noise[target]
        bad = q @ m.target[drawn].T + (m.bias[drawn] - self.log_noise[drawn])
        up = 0.5 - 0.5 * np.tanh(0.5 * good)  # 1 - sigmoid
        down = -0.5 - 0.5 * np.tanh(0.5 * bad)  # - sigmoid
        dq = up[:, None] * m.target[target] + down @ m.target[drawn]
        g = Bilinear(np.zeros_like(m.flat))
        _add_rows(g.target, target, up[:, None] * q)
        np.add.at(g.target, drawn, down.T @ q)
        g.bias += np.bincount(target, up, len(g.bias)).astype(np.float32)
        np.add.at(g.bias, drawn, down.sum(axis=0))
        for c in range(CONTEXT):
            _add_rows(g.context, ctx[:, c], dq * m.place[c])
            g.place[c] = (dq * m.context[ctx[:, c]]).sum(axis=0)
        flat = g.flat / np.float32(np.sqrt(b))
        self.squares += flat**2
        m.flat += np.float32(self.rate) * flat / np.sqrt(self.squares)
        self.seen += b

    def learn(self, cls: np.ndarray, first: np.ndarray, end_class: int) -> None:
        ctx = contexts(cls, first, end_class)
        order = self.rng.permutation(len(cls))
        for i in range(0, len(cls), BATCH):
            self.step(ctx[order[i : i + BATCH]], cls[order[i : i + BATCH]])


def train(docs: DataFrame, stats: Statistics, sample_texts: int = SAMPLE_TEXTS) -> Bilinear:
    """Fit the model on all texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    if not stats.n:
        return Bilinear()
    noise = stats.mass / stats.mass.sum()
    end_class = int(np.searchsorted(stats.top, END))
    small = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id", "text").limit(sample_texts).select("text").toArrow()
    start = Bilinear()
    start.bias[:] = np.log(noise)
    coach = Trainer(start, noise, 0.1, 1)
    for _ in range(2):
        for _, d, o in slices(small.column("text")):
            h, shape, first = tokens(d, o)
            coach.learn(stats.classes(h, shape), first, end_class)
    shared = spark.sparkContext.broadcast((start.flat, coach.squares, stats.top, noise))

    def fit(batches):
        flat, squares, top, noise = shared.value
        own = Trainer(Bilinear(flat.copy()), noise, 0.05, 2)
        own.squares = squares.copy()
        light = Statistics(0, 0, top, top, top, noise)
        for batch in batches:
            for _, d, o in slices(batch.column(0)):
                h, shape, first = tokens(d, o)
                own.learn(light.classes(h, shape), first, end_class)
        if own.seen:
            total = own.m.flat.astype(np.float64) * own.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), own.seen))], ["k", "x", "w"])

    got = docs.select("text").mapInArrow(fit, "k long, x double, w long").groupBy("k").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
    flat = start.flat.copy()
    flat[got.column("k").to_numpy()] = got.column("x").to_numpy()
    return Bilinear(flat)


def score_texts(docs: DataFrame, held_out, learned_from=None) -> DataFrame:
    """Scores of every text, learning from the rows where ``learned_from`` (or not ``held_out``) holds.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); log10.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", held_out.alias("held_out"), (learned_from if learned_from is not None else ~held_out).alias("may"), "text")
    learn = own.filter("may").select("doc_id", "text")
    counts = written(count_words(learn), "words")
    stats = statistics(counts)
    model = train(learn, stats)
    shared = spark.sparkContext.broadcast((stats, model.flat))

    def run(batches):
        stats, flat = shared.value
        model = Bilinear(flat)
        end_class = int(np.searchsorted(stats.top, END)) if len(stats.top) else TOP
        mass = np.log10(stats.mass)
        for batch in batches:
            for first_row, d, o in slices(batch.column(2)):
                h, shape, first = tokens(d, o)
                cls = stats.classes(h, shape)
                value = model.logs(contexts(cls, first, end_class), cls).astype(np.float64) / np.log(10)
                in_shape = cls >= TOP
                value[in_shape] -= mass[cls[in_shape]]
                at = np.minimum(np.searchsorted(stats.hashes, h), max(0, len(stats.hashes) - 1))
                often = stats.hashes[at] == h if len(stats.hashes) else np.zeros(len(h), bool)
                known = np.log10(np.where(often, stats.counts[at] if len(stats.hashes) else 0, 0) + 1.0)
                value[in_shape] += known[in_shape]
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end
                rest = ~often
                per = add(rest.astype(np.int64))
                ends = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                n = np.diff(first)
                rows = [batch.column(i).slice(first_row, len(n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(n), pa.array(n - per), pa.array(add(known)), pa.array(add(value)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[rest].view(np.int64)))],
                    ["doc_id", "held_out", "n_tokens", "n_often", "base", "model", "rest"],
                )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_often long, base double, model double, rest array<long>"
    part = own.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    part = written(part, "scored")
    asked = part.select("row", F.explode("rest").alias("h"))
    rare = counts.filter(F.col("c") * BROADCAST_WORDS <= stats.n).select("h", "c")
    found = asked.join(rare, "h").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("s"))
    more, logs = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0))
    space = float(np.log10(stats.n + stats.distinct + 1))
    return part.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + more).alias("n_known"), F.lit(stats.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * space).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
