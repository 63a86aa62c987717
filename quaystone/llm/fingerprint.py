"""Context-triggered piecewise hashing of whole texts.

A rolling hash of seven bytes cuts a text where its low bits are zero, so cuts
depend on what surrounds them and an edit moves only the cuts near it.  The
block size is the smallest power of two (4 at least) with at most 64 chunks,
which makes cuts of a larger block size a subset of those of a smaller one.
Each chunk gives two characters; the fingerprint ``size:chunks:chunks`` holds
the signatures at the block size and at twice that.  Two fingerprints are
likened at a block size that both have, by edit distance over chunks (insert
and delete cost 1): 1 - distance / (chunks of both).  Equal fingerprints are 1,
and without a common block size likeness is 0.

Edge cases: a null text is the empty text, whose fingerprint has no chunks; a
text shorter than seven bytes is one chunk; equal texts have equal
fingerprints.  ``fingerprint_edits`` takes a null doc_id after all others, and
rows that repeat a doc_id in order of their text; no other column is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .text import SLICE_BYTES, mix

WINDOW = 7
CHUNKS = 64
SMALLEST = 2

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _TABLES or len(_TABLES["up"]) < n:
        size = 1 << max(12, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _TABLES[name] = np.multiply.accumulate(x)
    return _TABLES["up"], _TABLES["down"]


def _signatures(sums, down, cuts, cut_doc, offsets) -> list[str]:
    """Signature of each text from the cut positions (a chunk ends before each)."""
    docs = len(offsets) - 1
    ends = np.concatenate((cuts, offsets[1:][offsets[1:] > offsets[:-1]]))
    doc = np.concatenate((cut_doc, np.flatnonzero(offsets[1:] > offsets[:-1])))
    order = np.lexsort((ends, doc))
    ends, doc = ends[order], doc[order]
    fresh = np.concatenate(([True], (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1]))) if len(ends) else np.zeros(0, bool)
    ends, doc = ends[fresh], doc[fresh]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    with np.errstate(over="ignore"):
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    code = (h >> np.uint64(52)).astype(np.int64)
    chars = np.stack((_LETTERS[code >> 6], _LETTERS[code & 63]), axis=1).tobytes().decode("ascii")
    bound = 2 * np.searchsorted(doc, np.arange(docs + 1))
    return [chars[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text (UTF-8)."""
    out: list[str] = []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_BYTES):
            size += len(texts[last])
            last += 1
        out += _some(texts[first:last])
        first = last
    return out


def _some(texts: list[bytes]) -> list[str]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        roll = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: max(0, len(data) + 1 - WINDOW)]) if len(data) >= WINDOW else np.zeros(0, np.uint64)
    at = np.flatnonzero((roll & np.uint64((1 << SMALLEST) - 1)) == 0)
    doc = np.searchsorted(offsets, at, side="right") - 1
    inside = at + WINDOW <= offsets[doc + 1]
    at, doc = at[inside], doc[inside]
    low = roll[at]
    level = np.minimum(np.log2((low & (~low + np.uint64(1))).astype(np.float64), where=low > 0, out=np.full(len(low), 40.0)), 40).astype(np.int64)
    cuts = at + WINDOW
    held = np.bincount(doc * 42 + level, minlength=42 * len(texts)).reshape(len(texts), 42)
    held = held[:, ::-1].cumsum(axis=1)[:, ::-1]
    held[:, :SMALLEST] = CHUNKS
    chosen = np.argmax(held < CHUNKS, axis=1)
    sig = []
    for k in (0, 1):
        use = level >= chosen[doc] + k
        sig.append(_signatures(sums, down, cuts[use], doc[use], offsets))
    return [f"{1 << c}:{a}:{b}" for c, a, b in zip(chosen.tolist(), *sig)]


def _common(a: str, b: str) -> float:
    """1 - edit distance / (chunks of both), for signatures of two characters a chunk."""
    if not a or not b:
        return float(a == b)
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    free = full  # zeros mark the chunks of a longest common subsequence
    for c in y:
        if m := where.get(c):
            u = free & m
            free = ((free + u) | (free - u)) & full
    same = len(x) - free.bit_count()
    return 2 * same / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_common(a1, b1), _common(a2, b2) if a2 and b2 else 0.0)
    if p == 2 * q:
        return _common(a1, b2)
    if q == 2 * p:
        return _common(a2, b1)
    return 0.0


LAST = (1 << 63) - 1


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's beginning.

    Texts are dealt once, to ranges of doc_id whose bounds are ids that occur
    (approximate quantiles).  The first document of a range is also sent to the
    range before it, as what its last document is followed by; the very first
    goes to the last range.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    n = partitions(spark)
    shares = [i / (3 * n) for i in range(1, 3 * n)]
    found = own.agg(F.min("k").alias("low"), F.percentile_approx("k", shares, 100 * len(shares)).alias("cut")).first()
    bounds = sorted({found.low, *(found.cut or [])}) if found.low is not None else [0]
    coarse = F.array(*[F.lit(x).cast("long") for x in bounds[::32]])
    fine = F.array(*[F.lit(x).cast("long") for x in bounds])
    group = (F.size(F.filter(coarse, lambda x: x <= F.col("k"))) - 1) * 32
    bucket = group + F.size(F.filter(F.slice(fine, group + 1, F.lit(32)), lambda x: x <= F.col("k"))) - 1
    starts = F.array_contains(fine, F.col("k"))
    before = F.when(F.col("b") == 0, len(bounds) - 1).otherwise(F.col("b") - 1)
    here = F.struct(F.col("b"), F.lit(0).alias("ahead"))
    both = own.withColumn("b", bucket).withColumn("to", F.explode(F.when(starts, F.array(here, F.struct(before.alias("b"), F.lit(1).alias("ahead")))).otherwise(F.array(here))))
    dealt = both.select("doc_id", "t", F.col("to.b").alias("b"), F.col("to.ahead").alias("ahead"), "k").repartition(n, "b").sortWithinPartitions("b", "ahead", "k", "t")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        ids, texts, places, marks = [], [], [], []  # the last row waits for the next batch

        def done(rows: int):
            pairs = [(texts[i], texts[i + 1], ids[i], marks[i], marks[i + 1]) for i in range(rows) if not places[i][1]]
            if not pairs:
                return None
            edited = [(t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode() for t, nxt, *_ in pairs]
            marked = fingerprints(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[2] for p in pairs], out_type), pa.array([len(p[0]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([p[3] for p in pairs]), pa.array(marked), pa.array([likeness(p[3], m) for p, m in zip(pairs, marked)]), pa.array([likeness(p[3], p[4]) for p in pairs]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            out_type = batch.schema.field(0).type
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                fresh = part.column(1).to_pylist()
                ids += part.column(0).to_pylist()
                places += list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                texts += fresh
                marks += fingerprints([t.encode() for t in fresh])
                if (out := done(len(texts) - 1)) is not None:
                    yield out
                del ids[:-1], texts[:-1], places[:-1], marks[:-1]

    return dealt.select("doc_id", "t", "b", "ahead").mapInArrow(run, schema)
