"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks are laid end to end and indexed by a suffix array
over their first characters (as many as the longest piece has).  Every piece is
binary-searched for its range of occurrences; the occurrences are the edges of
a lattice, sorted by the position where they end and then relaxed in that
order.  The vocabulary file here is a BPE model, so relaxing keeps, for each
position, the one token with which the encoding up to there ends: an edge is
taken if merging the two neighbours' characters gives those two tokens again.
A sequence whose neighbours all agree is the encoding, so the ids equal those
of the merging procedure.  Whether two pieces agree is remembered in a hash
table; the way back through the lattice is walked for all chunks at once.

Characters of no piece become byte pieces.  Decoding joins the pieces, turns
U+2581 into spaces and drops the one that encoding put first; it is the text
again unless the text itself has U+2581 (which decodes as a space).

Edge cases: null and empty texts have no ids and decode to the empty text;
other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import applied, released
from .text import portions
from .vocabulary import MODEL, SPACE, Vocabulary, chunks, load, trim

#: Characters indexed at once.
INDEXED = 500_000
#: Most pairs of pieces whose agreement is remembered.
PAIRS = 1_000_000
UNKNOWN = -2


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The merging procedure itself: join the neighbours with the best score, leftmost first, until none join."""
    part: list[str | None] = list(text)
    after = list(range(1, len(part) + 1))
    before = list(range(-1, len(part) - 1))
    heap = [(-scores[p + q], i, p + q) for i, (p, q) in enumerate(zip(part, part[1:])) if p + q in scores]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= len(part) or part[j] is None or part[i] + part[j] != joined:
            continue
        part[i], part[j] = joined, None
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
            if (new := joined + part[after[i]]) in scores:
                heapq.heappush(heap, (-scores[new], i, new))
        if before[i] >= 0 and (new := part[before[i]] + joined) in scores:
            heapq.heappush(heap, (-scores[new], before[i], new))
    return [p for p in part if p is not None]


def packed(codes: np.ndarray) -> np.ndarray:
    """Three consecutive codes (zeros beyond the end) in one number, for each position."""
    wide = np.zeros(len(codes) + 2, np.int64)
    wide[: len(codes)] = codes
    return wide[:-2] << 42 | wide[1:-1] << 21 | wide[2:]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` codes that start there; ``words``: the codes, packed by three."""
    n, k, key = len(words), 3, words
    while True:
        order = np.argsort(key)
        if k >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
        key = rank * (n + 2)
        key[:-k] += rank[k:]
        k *= 2


class Pairs:
    """Whether two neighbouring pieces stay as they are when merged: a hash table of the pairs met so far."""

    def __init__(self, texts: list[str], scores: dict[str, float]):
        self.texts, self.scores = texts, scores
        self._clear(18)

    def _clear(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.answers = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """The place of each pair, or the empty one where it belongs."""
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        off = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[off]]
            off = off[(there != key[off]) & (there >= 0)]
        return slot

    def _put(self, key: np.ndarray, answer: np.ndarray) -> None:
        while len(key):
            slot = self._slots(key)
            first = np.unique(slot, return_index=True)[1]  # of those for one place, one at a time
            self.keys[slot[first]], self.answers[slot[first]] = key[first], answer[first]
            self.used += len(first)
            left = np.ones(len(key), bool)
            left[first] = False
            key, answer = key[left], answer[left]

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = len(self.texts)
        key = left.astype(np.int64) * n + right
        slot = self._slots(key)
        if len(new := np.unique(key[self.keys[slot] < 0])):
            answer = np.array([merge(a + b, self.scores) == [a, b] for a, b in ((self.texts[k // n], self.texts[k % n]) for k in new.tolist())], bool)
            if 2 * (self.used + len(new)) > len(self.keys):
                known = self.keys >= 0
                keys, answers = np.concatenate((self.keys[known], new)), np.concatenate((self.answers[known], answer))
                if len(keys) > PAIRS:  # forget the earlier ones; they are worked out again where needed
                    keys, answers = new, answer
                self._clear(int(4 * len(keys)).bit_length())
                self._put(keys, answers)
            else:
                self._put(new, answer)
            slot = self._slots(key)
        return self.answers[slot]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.scores = vocabulary, vocabulary.scores
        # a piece that merging its own characters doesn't give is never made
        made = [t for t in self.scores if merge(t, self.scores) == [t]]
        self.ids = np.array([vocabulary.ids[t] for t in made], np.int32)
        self.depth = max(map(len, made))
        self.lengths = np.array([len(t) for t in made], np.int32)
        self.words = np.zeros((-(-self.depth // 3), len(made)), np.int64)
        self.masks = np.zeros_like(self.words)
        for i, t in enumerate(made):
            for k, c in enumerate(t):
                self.words[k // 3, i] |= ord(c) << 21 * (2 - k % 3)
                self.masks[k // 3, i] |= 0x1FFFFF << 21 * (2 - k % 3)
        self.pairs = Pairs(made, self.scores)
        self.cache: dict[str, bytes] = {}

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece."""
        words = packed(codes)
        order = suffix_array(words, self.depth)
        words = np.concatenate((words, np.zeros(self.depth, np.int64)))

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.lengths), np.int64), np.full(len(self.lengths), len(order), np.int64)
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                at = order[mid]
                less, same = np.zeros(len(at), bool), np.arange(len(at))
                for k in range(len(self.words)):
                    piece = open_[same]
                    have, want = words[at[same] + 3 * k] & self.masks[k, piece], self.words[k, piece]
                    less[same] = have < want
                    same = same[(have == want) & (self.lengths[piece] > 3 * k + 3)] if not upper else same[have == want]
                    if not len(same):
                        break
                if upper:
                    less[same] = True
                lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            return lo

        lo, hi = bound(False), bound(True)
        many = hi - lo
        piece = np.repeat(np.arange(len(many), dtype=np.int32), many)
        at = order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(piece))]
        return at.astype(np.int32), piece

    def _relax(self, parts: list[str]) -> None:
        """Encode chunks into the cache."""
        text = "".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int32, len(parts))
        first = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        begin = np.repeat(first[:-1], lengths)  # of the chunk at each character
        start, piece = self._edges(codes)
        inside = start + self.lengths[piece] <= np.repeat(first[1:], lengths)[start]
        start, piece = start[inside], piece[inside]
        covered = np.zeros(len(text), bool)
        covered[start[self.lengths[piece] == 1]] = True
        alone = np.flatnonzero(~covered).astype(np.int32)
        size = np.concatenate((self.lengths[piece], np.ones(len(alone), np.int32)))
        start, piece = np.concatenate((start, alone)), np.concatenate((piece, np.full(len(alone), UNKNOWN, np.int32)))
        depth = start - begin[start] + size
        order = np.argsort(depth.astype(np.int64) << 32 | start)
        start, piece, size = start[order], piece[order], size[order]
        steps = np.searchsorted(depth[order], np.arange(1, int(lengths.max()) + 2))
        head = start == begin[start]
        last, back = np.full(len(text) + 1, -1, np.int32), np.full(len(text) + 1, -1, np.int32)
        # last[k]: the token that ends before character k of the same chunk; k = end of a chunk is held at its last character + 1
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            s, p = start[a:b], piece[a:b]
            left = np.where(head[a:b], UNKNOWN, last[s])
            ok = left != -1
            both = np.flatnonzero((left >= 0) & (p >= 0))  # unknown characters merge with nothing
            ok[both] = self.pairs.agree(left[both], p[both])
            e = s[ok] + size[a:b][ok]
            last[e], back[e] = p[ok], s[ok]
        ends, cur, floor = np.zeros(len(text) + 1, bool), first[1:], first[:-1]
        while len(cur):
            ends[cur] = True
            cur = back[cur]
            more = cur > floor
            cur, floor = cur[more], floor[more]
        at = np.flatnonzero(ends)
        token = last[at]
        ids = self.ids[token]
        bounds = np.searchsorted(at, first, side="right")
        if len(odd := np.flatnonzero(token == UNKNOWN)):
            rest = [self.v.fallback(text[k - 1]) for k in at[odd].tolist()]
            many = np.ones(len(at), np.int64)
            many[odd] = [len(r) for r in rest]
            before = np.concatenate(([0], np.cumsum(many)))
            ids = np.repeat(ids, many)
            for k, r in zip(before[odd].tolist(), rest):
                ids[k : k + len(r)] = r
            bounds = before[bounds]
        flat = ids.astype("<i4").tobytes()
        bounds = (4 * bounds).tolist()
        self.cache.update(zip(parts, map(flat.__getitem__, map(slice, bounds[:-1], bounds[1:]))))

    def learn(self, new) -> None:
        """Put the encodings of chunks into the cache."""
        group, size = [], 0
        for c in new:
            if group and size + len(c) > INDEXED:
                self._relax(group)
                group, size = [], 0
            group.append(c)
            size += len(c)
        if group:
            self._relax(group)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        cut = [chunks(t) for t in texts]
        self.learn({c for p in cut for c in p}.difference(self.cache))
        out = [b"".join(map(self.cache.__getitem__, p)) for p in cut]
        trim(self.cache)
        return out

    def decode(self, ids) -> bytes:
        """The text that ids stand for, in UTF-8."""
        out = b"".join(map(self.v.surface.__getitem__, ids)).replace(SPACE.encode(), b" ")
        return out[1:] if out[:1] == b" " else out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared, name: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encode(docs: DataFrame, keep: list[str], path: str = MODEL, digests: bool = False, ids: bool | None = None) -> DataFrame:
    """The ``keep`` columns and, for every row, ``ids`` (unless only ``digests``: their number and hash, and what they decode to).

    Digests: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit
    numbers), ``decoded_sha256`` (of the decoded text in UTF-8) and
    ``round_trip`` (whether that is the text).  A kept column of a result's
    name gives way to it.
    """
    with_ids = not digests if ids is None else ids
    more = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean"] * digests + ["ids array<int>"] * with_ids
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        own = _encoder(shared, path)
        for column in batches:
            n, coded, decoded, same, flat = [], [], [], [], []
            for part in portions(column):
                texts = part.to_pylist()
                for text, raw in zip(texts, own.encode(texts)):
                    numbers = np.frombuffer(raw, np.int32)
                    n.append(len(numbers))
                    if with_ids:
                        flat.append(numbers)
                    if digests:
                        back = own.decode(numbers.tolist())
                        coded.append(hashlib.sha256(raw).hexdigest())
                        decoded.append(hashlib.sha256(back).hexdigest())
                        same.append(back == (text or "").encode())
            out = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())] if digests else []
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)]))))
            yield out
        released()

    return applied(docs, keep, run, ", ".join(more))


def decode(encoded: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """The ``keep`` columns and the ``text`` of ``ids``; null ids are the empty text, and a kept ``text`` gives way."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        own = _encoder(shared, path)
        for column in batches:
            yield [pa.array([own.decode(i or []).decode("utf-8", "replace") for i in column.to_pylist()], pa.string())]

    return applied(encoded, keep, run, "text string", text="ids")
