"""Maximal periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are
identical), at least ``least`` words and at least two periods long, that no
neighbouring word extends.  The dictionary names, for each power of two, equal
factors of that many words within a text by equal numbers; a factor is made of
two of half its length, and one that occurs once in its text is dropped with
all longer ones that begin there, so plain prose leaves little to sort.

At length m = 2**k the dictionary proposes the periods of m .. 2m - 1.
Occurrences of a factor at most m / 2 apart form an arithmetic progression
(its difference is the factor's smallest period); occurrences of one
progression propose none of these periods, as the progression's difference
divides them.  Of two progressions within 2m of each other, only pairs with
the first of either can start a run, since before all others the same word
stands; and at most three progressions fit, so the pairs are linear in the
text.  A proposal (start, period) that the word before extends is no start;
the others are extended to the right through the dictionary, longest factors
first, and of equal stretches the smallest period stays.

Texts are handled some at a time, bounded by bytes; a text over that bound is
handled alone, in 4 bytes a word and level besides its words.

Edge cases: null, empty and blank texts have no words and no runs; a row's
result depends on its text alone, so repeated rows have equal results; other
columns pass through, and one named like a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import applied, released
from .text import slices

#: Bytes of text handled at once.
SLICE = 1 << 20
LEAST = 12


def _proposals(base: np.ndarray, at: np.ndarray, group: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods (m .. 2m - 1) that the occurrences ``at``, sorted within each ``group``, propose at length ``m``."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = (group[1:] != group[:-1]) | ((at[1:] - at[:-1]) * 2 > m)
    first = np.flatnonzero(fresh)
    own = np.cumsum(fresh) - 1  # each occurrence's progression
    heads, kin = at[first], group[first]
    starts, periods = [], []
    for away in (1, 2, 3):
        if len(heads) <= away:
            break
        for i, j, same in (
            (at, heads[np.minimum(own + away, len(heads) - 1)], (own + away < len(heads)) & (kin[np.minimum(own + away, len(heads) - 1)] == group)),
            (heads[np.maximum(own - away, 0)], at, (own >= away) & (kin[np.maximum(own - away, 0)] == group)),
        ):
            fits = same & (j - i >= m) & (j - i < 2 * m)
            i, j = i[fits], j[fits]
            begins = (i == 0) | (base[i - 1] != base[j - 1])
            starts.append(i[begins])
            periods.append((j - i)[begins])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64),) * 2


def runs_of(base: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs in ``base``, numbers of words that are equal only within one text.

    Runs are in order of start, then period.
    """
    n = len(base)
    names: list[np.ndarray] = []  # per level: each position's factor, -1 where it occurs once
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, key, m = np.arange(n), base, 1
    while len(at):
        order = np.argsort(key, kind="stable")
        key, pos = key[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        often = np.repeat(np.diff(edge) > 1, np.diff(edge))
        pos, group = pos[often], group[often]
        if not len(pos):
            break
        name = np.full(n, -1, np.int32)
        name[pos] = group
        names.append(name)
        found.append(_proposals(base, pos, group, m))
        at = np.flatnonzero(name[: max(0, n - m)] >= 0)
        at = at[name[at + m] >= 0]
        key = name[at].astype(np.int64) * (len(edge) + 1) + name[at + m]
        m *= 2
    start, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    a, b = start.copy(), start + period
    for k in range(len(names) - 1, -1, -1):
        there = np.minimum(b, n - 1)
        same = (b < n) & (names[k][a] >= 0) & (names[k][a] == names[k][there])
        a, b = a + (same << k), b + (same << k)
    long = b - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], b[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    kept = np.ones(len(start), bool)
    kept[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _found(data: np.ndarray, offsets: np.ndarray, least: int):
    """Of a slice of texts: words of each, their runs (start, length, period) one after another, runs of each, and each text without repeats."""
    raw = data.tobytes()
    words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    counts = np.array([len(w) for w in words])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(x, len(seen)) for w in words for x in w], np.int64)
    start, length, period = runs_of(number * len(words) + np.repeat(np.arange(len(words)), counts), least)
    doc = np.searchsorted(bounds, start, side="right") - 1
    cover = np.zeros(len(number) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    some = set(doc.tolist())
    texts = [b" ".join([x for x, k in zip(w, kept[a:b].tolist()) if k] if d in some else w) for d, (w, a, b) in enumerate(zip(words, bounds[:-1].tolist(), bounds[1:].tolist()))]
    return counts, (start - bounds[doc], length, period), np.bincount(doc, minlength=len(words)), texts


def find_runs(docs: DataFrame, keep: list[str], least: int = LEAST, text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that
    some run holds after its first period.
    """

    def run(texts):
        for column in texts:
            counts, runs, per, collapsed = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 3], [np.zeros(0, np.int64)], []
            for _, data, offsets in slices(column, SLICE):
                c, r, p, t = _found(data, offsets, least)
                counts.append(c)
                runs.append(r)
                per.append(p)
                collapsed += t
            fields = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*runs)], names=["start", "length", "period"])
            ends = np.concatenate(([0], np.cumsum(np.concatenate(per)))).astype(np.int32)
            yield [pa.array(np.concatenate(counts)), pa.ListArray.from_arrays(pa.array(ends), fields), pa.array(collapsed, pa.binary()).cast(pa.string())]
        released()

    return applied(docs, keep, run, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", text)


def _repeated(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    out = []
    for text, number in zip(texts.to_pylist(), numbers.to_pylist()):
        words = (text or "").encode().split()
        if words:
            g = number // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + (words[a : a + p] * ((len(words) - a) // p + 1))[: len(words) - a]
        out.append(text if text is None else b" ".join(words).decode())
    return pa.array(out, pa.string())


def with_repeats(text: Column, number: Column) -> Column:
    """The text, of one in ten whose words from some place on repeat a stretch instead; ``number`` is unsigned and decides.

    Null and blank texts and those of a null number stay without words or as they are.
    """
    chosen = F.coalesce(number % 10 == 0, F.lit(False))
    return F.when(chosen, F.arrow_udf(_repeated, "string")(F.when(chosen, text), number)).otherwise(text)


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, the longest run and digests of what ``find_runs`` gives."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        *keep, "n_words", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
