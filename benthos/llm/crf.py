"""A linear-chain conditional random field over sparse binary features, in numpy: fitted by Adam on the exact likelihood, decoded
by Viterbi, both for many sequences at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np


class Sequences:
    """Sequences of items with their features, and the items' labels, as flat arrays."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, sizes: np.ndarray, gold: np.ndarray):
        """features: of all items in a row; counts: features by item; sizes: items by sequence."""
        self.features, self.counts, self.sizes, self.gold = features, counts, sizes, gold

    @classmethod
    def of(cls, items: np.ndarray, features: np.ndarray, sizes: np.ndarray, gold: np.ndarray) -> Sequences:
        """items and features are parallel, in any order."""
        return cls(features[np.argsort(items, kind="stable")], np.bincount(items, minlength=len(gold)), sizes, gold)

    @classmethod
    def listed(cls, sequences: list[list[list[int]]], labels: list[list[int]]) -> Sequences:
        flat = [f for s in sequences for f in s]
        return cls(np.fromiter((x for f in flat for x in f), np.int64), np.array([len(f) for f in flat], np.int64), np.array([len(s) for s in sequences], np.int64), np.fromiter((y for ys in labels for y in ys), np.int64))

    def lists(self) -> tuple[list[list[list[int]]], list[list[int]]]:
        ends, at = np.cumsum(self.counts).tolist(), np.cumsum(self.sizes).tolist()
        all_, flat = self.features.tolist(), self.gold.tolist()
        items = [all_[b - n : b] for b, n in zip(ends, self.counts.tolist())]
        return [items[b - n : b] for b, n in zip(at, self.sizes.tolist())], [flat[b - n : b] for b, n in zip(at, self.sizes.tolist())]

    def some(self, which: np.ndarray) -> Sequences:
        items = ranges((np.cumsum(self.sizes) - self.sizes)[which], self.sizes[which])
        counts = self.counts[items]
        return Sequences(self.features[ranges(self.starts[items], counts)], counts, self.sizes[which], self.gold[items])

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... to sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Crf:
    def __init__(self, n_features: int, n_labels: int):
        self.w = np.zeros((n_labels, n_features)).T  # by label in a row
        self.t = np.zeros((n_labels, n_labels))
        self.moments, self.steps = None, 0

    def emissions(self, items: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """(n, labels): the sum of the weights of each item's features; items and features are parallel."""
        return np.stack([np.bincount(items, self.w[:, k][features], n) for k in range(self.w.shape[1])], 1)

    def fit(self, sequences: list[list[list[int]]], labels: list[list[int]], epochs: int = 8, batch: int = 256, rate: float = 0.05, decay: float = 2e-6, seed: int = 1) -> Crf:
        """Called again, it goes on from where it is with other sequences."""
        return self.fit_on(Sequences.listed(sequences, labels), epochs, batch, rate, decay, seed)

    def fit_on(self, given: Sequences, epochs: int = 8, batch: int = 256, rate: float = 0.05, decay: float = 2e-6, seed: int = 1) -> Crf:
        rng = np.random.default_rng(seed)
        state = self.moments = self.moments or [np.zeros_like(x) for x in (self.w, self.w, self.t, self.t)]
        step = self.steps
        blocks = [(x.T[j, at : at + 16384], m.T[j, at : at + 16384], v.T[j, at : at + 16384]) for x, m, v in ((self.w, *state[:2]),) for j in range(x.shape[1]) for at in range(0, len(x), 16384)]
        spare = np.empty(16384)
        for _ in range(epochs):
            order = rng.permutation(len(given.sizes))
            for at in range(0, len(order), batch):
                step += 1
                part = order[at : at + batch]
                gw, gt = self.gradient(given.some(part))
                shrink, grow = 1 / np.sqrt(1 - 0.999**step), rate / (1 - 0.9**step)
                gs = [gw.T[j, at : at + 16384] for j in range(gw.shape[1]) for at in range(0, len(gw), 16384)]
                for (x, m, v), g in zip(blocks, gs):
                    s = spare[: len(x)]
                    g *= 1 / len(part)
                    g += np.multiply(x, decay, out=s)
                    _adam(x, g, m, v, s, shrink, grow)
                gt /= len(part)
                _adam(self.t, gt, *state[2:], np.empty_like(gt), shrink, grow)
        self.steps = step
        return self

    def _gradient(self, sequences, labels):
        return self.gradient(Sequences.listed(sequences, labels))

    def gradient(self, given: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts, by forward-backward over all sequences at once, the longest first, in shares of each step's sum."""
        longest = np.argsort(-given.sizes, kind="stable")
        starts, sizes = (np.cumsum(given.sizes) - given.sizes)[longest], given.sizes[longest]
        features, k = given.features, self.t.shape[0]
        items = np.repeat(np.arange(len(given.gold)), given.counts)
        e = self.emissions(items, features, len(given.gold))
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        move = np.exp(self.t - self.t.max())
        live = (sizes[None] > np.arange(sizes[0])[:, None]).sum(1).tolist()  # sequences that have an item at each step
        at = [starts[:n] + i for i, n in enumerate(live)]
        alpha, beta = [e[at[0]]], [np.ones((n, k)) for n in live]
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for i in range(1, len(live)):
            a = (alpha[i - 1][: live[i]] @ move) * e[at[i]]
            alpha.append(a / a.sum(1, keepdims=True))
        gt = np.zeros_like(self.t)
        for i in range(len(live) - 2, -1, -1):
            n = live[i + 1]
            ahead = e[at[i + 1]] * beta[i + 1]
            b = ahead @ move.T
            before = alpha[i][:n]
            gt += (before / (before * b).sum(1, keepdims=True)).T @ ahead
            beta[i][:n] = b / b.sum(1, keepdims=True)
        gt *= move
        diff = np.empty_like(e)
        for i in range(len(live)):
            p = alpha[i] * beta[i]
            diff[at[i]] = p / p.sum(1, keepdims=True)
        gold = given.gold
        diff[np.arange(len(gold)), gold] -= 1
        gw = np.stack([np.bincount(features, diff[:, j][items], len(self.w)) for j in range(k)]).T
        follow = np.ones(len(gold), bool)
        follow[starts] = False
        after = np.flatnonzero(follow)
        np.add.at(gt, (gold[after - 1], gold[after]), -1)
        return gw, gt

    def decode(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels of all items; sizes: of the sequences, in a row. Sequences of like length are decoded together."""
        out = np.empty(len(e), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        one = sizes == 1
        out[starts[one]] = e[starts[one]].argmax(1) if one.any() else 0
        for n in np.unique(sizes[sizes > 1]):
            at = starts[sizes == n]
            best, back = e[at], []
            for i in range(1, n):
                scores = best[:, :, None] + self.t
                back.append(scores.argmax(1))
                best = scores.max(1) + e[at + i]
            last = best.argmax(1)
            out[at + n - 1] = last
            for i in range(n - 2, -1, -1):
                last = back[i][np.arange(len(at)), last]
                out[at + i] = last
        return out


def _adam(x: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, s: np.ndarray, shrink: float, grow: float) -> None:
    m *= 0.9
    m += np.multiply(g, 0.1, out=s)
    v *= 0.999
    g *= g
    g *= 0.001
    v += g
    np.sqrt(v, out=s)
    s *= shrink
    s += 1e-8
    np.divide(m, s, out=s)
    s *= grow
    x -= s
