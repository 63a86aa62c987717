"""Token counts of a unigram vocabulary, without making tokens.

An Aho-Corasick automaton enumerates every piece that ends at each character;
dynamic programming keeps, for each position, the best score of a segmentation
and how many pieces it has.  Ties follow the tokenizer: of equal scores, the
piece that starts first (the longest) wins, as it reaches the position first.
A character that is no piece of its own may be unknown, at 10 below the lowest
score; with byte pieces it counts as its UTF-8 bytes.

The pieces and scores are those of the vocabulary file, taken as unigram
scores; counts equal those of a Unigram tokenizer made of the same pieces.
Edge cases: null and empty texts have no tokens; other columns pass through.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import applied, released
from .vocabulary import MODEL, Vocabulary, chunks, load, trim

PENALTY = 10.0


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for text, score in vocabulary.scores.items():
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.single = {t for t in vocabulary.scores if len(t) == 1}
        self.unknown = min(vocabulary.scores.values()) - PENALTY
        self.bytes = vocabulary.bytes_from is not None
        self.cache: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Tokens of one chunk."""
        n = len(text)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        unknown_ends = [False] * (n + 1)
        done = 0  # all ways to reach positions up to here have been seen

        def finish(k: int) -> None:
            if text[k - 1] not in self.single and best[k - 1] + self.unknown > best[k]:
                best[k] = best[k - 1] + self.unknown
                # as bytes, each unknown character counts by itself; otherwise a run of them is one token
                count[k] = count[k - 1] + (len(text[k - 1].encode()) if self.bytes else not unknown_ends[k - 1])
                unknown_ends[k] = True

        for end, (length, score) in self.automaton.iter(text):  # of those with one end, the longest comes first
            while done < end:
                done += 1
                finish(done)
            start = end + 1 - length
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        while done < n:
            done += 1
            finish(done)
        return int(count[n])

    def count(self, text: str | None) -> int:
        parts = chunks(text)
        cache = self.cache
        for new in set(parts).difference(cache):
            cache[new] = self.chunk(new)
        total = sum(map(cache.__getitem__, parts))
        trim(cache)
        return total


_COUNTERS: dict[str, Counter] = {}


def _counter(shared, name: str) -> Counter:
    """This worker's counter, kept from task to task."""
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(shared.value)
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` for every row of ``docs``; a kept column of that name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        counter = _counter(shared, path)
        for texts in batches:
            yield [pa.array([counter.count(t.as_py()) for t in texts], pa.int64())]
        released()

    return applied(docs, keep, run, "n_tokens long")
