"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy.

Windows are strings of one length (short ones are padded with a character of
its own).  Letters lose their case and digits their value, so that formats are
learned rather than particular data.
"""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 12, 20
PAD, OTHER = 0, 1
#: Scores of sequences decoded together.
DECODED = 4_000_000
#: A sequence of more steps than this is decoded in blocks of so many.
BLOCK = 1024


def codes(texts: list[str], length: int) -> np.ndarray:
    out = np.full((len(texts), length), PAD, np.int64)
    for i, t in enumerate(texts):
        c = np.frombuffer(t[:length].encode("utf-32-le"), np.uint32).astype(np.int64)
        c = np.where((c >= 65) & (c <= 90), c + 32, c)
        c = np.where((c >= 48) & (c <= 57), 48, c)
        out[i, : len(c)] = np.where((c < 9) | (c > 127), OTHER, c)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, seed: int = 4):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"embed": r.normal(0, 0.3, (128, EMBED)).astype(np.float32), "out": g(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states over time (T, N, HIDDEN), and what the way back needs."""
        p, (steps, n, _) = self.p, x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, saved = np.empty((steps, n, HIDDEN), np.float32), []
        given = x @ p[f"x{d}"] + p[f"b{d}"]
        for t in range(steps):
            z = given[t] + h @ p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            before, prior = c, h
            c = f * c + i * u
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep:
                saved.append((i, f, o, u, before, prior, th))
        return out, saved

    def _lstm_back(self, x, d, saved, dout, grads):
        p = self.p
        dx = np.empty_like(x)
        dh = np.zeros_like(dout[0])
        dc = np.zeros_like(dh)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, before, prior, th = saved[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th**2)
            dz = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u**2)), axis=1)
            grads[f"x{d}"] += x[t].T @ dz
            grads[f"h{d}"] += prior.T @ dz
            grads[f"b{d}"] += dz.sum(axis=0)
            dx[t] = dz @ p[f"x{d}"].T
            dh, dc = dz @ p[f"h{d}"].T, dc * f
        return dx

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (N, T, tags) of windows."""
        x = self.p["embed"][ids.T]
        f, _ = self._lstm(x, "f", False)
        b, _ = self._lstm(x[::-1], "b", False)
        return (np.concatenate((f, b[::-1]), axis=2) @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2)

    def _loss(self, ids: np.ndarray, gold: np.ndarray):
        p, move = self.p, self.p["move"]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        x = p["embed"][ids.T]
        f, fs = self._lstm(x, "f", True)
        b, bs = self._lstm(x[::-1], "b", True)
        both = np.concatenate((f, b[::-1]), axis=2)
        e = both @ p["out"] + p["out_b"]  # T, N, K
        steps, n, k = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        y = gold.T
        at, every = np.arange(steps)[:, None], np.arange(n)[None]
        right = e[at, every, y].sum(axis=0) + move[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - z[:, None])
        de[at, every, y] -= 1
        pairs = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        grads["move"] = pairs.sum(axis=(0, 1))
        np.add.at(grads["move"], (y[:-1], y[1:]), -1)
        flat = both.reshape(-1, 2 * HIDDEN)
        grads["out"] = flat.T @ de.reshape(-1, k)
        grads["out_b"] = de.sum(axis=(0, 1))
        dboth = de @ p["out"].T
        dx = self._lstm_back(x, "f", fs, dboth[:, :, :HIDDEN], grads)
        dx += self._lstm_back(x[::-1], "b", bs, dboth[::-1, :, HIDDEN:], grads)[::-1]
        np.add.at(grads["embed"], ids.T, dx)
        return float((z - right).sum()), grads

    def fit(self, texts: list[str], tags: list[list[int]], length: int, epochs: int = 9, batch: int = 64, rate: float = 0.012, seed: int = 9) -> None:
        """Adam on the CRF's negative log-likelihood."""
        ids = codes(texts, length)
        gold = np.zeros(ids.shape, np.int64)
        for i, t in enumerate(tags):
            gold[i, : min(len(t), length)] = t[:length]
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                _, grads = self._loss(ids[pick], gold[pick])
                step += 1
                now = rate * (1 - epoch / (epochs + 1))
                for k, g in grads.items():
                    g = np.clip(g / len(pick), -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of sequences of any lengths, by Viterbi over some of like length together (``DECODED`` scores, but for a longer one)."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        out = [np.zeros(0, np.int64)] * len(scores)
        while order and len(scores[order[0]]) > BLOCK:
            i = order.pop(0)
            out[i] = self._in_blocks(scores[i])
        while order and len(scores[order[0]]):
            n = max(1, DECODED // scores[order[0]].size)
            for i, tags in zip(order[:n], self._viterbi([scores[i] for i in order[:n]])):
                out[i] = tags
            order = order[n:]
        return out

    def _in_blocks(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi over one long sequence, all its blocks side by side.

        First each block's best score from every first to every last tag, then
        the best way through the blocks, then the way inside each.
        """
        steps, k = scores.shape
        blocks = -(-steps // BLOCK)
        e = np.zeros((blocks * BLOCK, k))
        e[:steps] = scores
        e = e.reshape(blocks, BLOCK, k)
        move = self.p["move"].astype(np.float64)
        last = np.full(blocks, BLOCK - 1)
        last[-1] = (steps - 1) % BLOCK
        through = np.where(np.eye(k, dtype=bool), e[:, 0, None, :], -np.inf)  # block, first tag, last tag
        for t in range(1, BLOCK):
            live = slice(0, blocks if t <= last[-1] else blocks - 1)
            through[live] = (through[live, :, :, None] + move).max(axis=2) + e[live, t, None, :]
        best, firsts, before = through[0].max(axis=0), np.zeros((blocks, k), np.int64), np.zeros((blocks, k), np.int64)
        firsts[0] = through[0].argmax(axis=0)
        for b in range(1, blocks):
            ways = best[:, None] + move
            before[b] = ways.argmax(axis=0)
            ways = ways.max(axis=0)[:, None] + through[b]
            firsts[b] = ways.argmax(axis=0)
            best = ways.max(axis=0)
        first, now, tag = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), int(best.argmax())
        for b in range(blocks - 1, -1, -1):
            now[b], first[b] = tag, firsts[b, tag]
            tag = int(before[b, first[b]])
        each = np.arange(blocks)
        held = np.full((blocks, k), -np.inf)
        held[each, first] = e[each, 0, first]
        back = np.zeros((BLOCK, blocks, k), np.int8)
        for t in range(1, BLOCK):
            ways = held[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            held = ways.max(axis=1) + e[:, t]
        tags = np.zeros((blocks, BLOCK), np.int8)
        for t in range(BLOCK - 1, -1, -1):
            live = t <= last
            tags[live, t] = now[live]
            now = np.where(live, back[t, each, now], now)
        return tags.ravel()[:steps]

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The longest comes first."""
        lengths = np.array([len(s) for s in scores])
        k = scores[0].shape[1]
        e = np.zeros((lengths[0], len(scores), k), np.float32)
        for j, s in enumerate(scores):
            e[: len(s), j] = s
        best, back = e[0].copy(), np.zeros((lengths[0], len(scores), k), np.int8)
        for t in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -t))  # those longer than t
            ways = best[:live, :, None] + self.p["move"]
            back[t, :live] = ways.argmax(axis=1)
            best[:live] = ways.max(axis=1) + e[t, :live]
        tags = np.zeros((lengths[0], len(scores)), np.int8)
        now = best.argmax(axis=1)
        for t in range(lengths[0] - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t))
            tags[t, :live] = now[:live]
            now[:live] = back[t, np.arange(live), now[:live]]
        return [tags[:n, j] for j, n in enumerate(lengths.tolist())]
