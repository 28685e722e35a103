"""A small FM-index over integer symbols: wavelet-matrix ranks, sampled suffix positions, many searches at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Every 0 ends its run and differs from all others."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        follow = np.append(rank[step:], np.zeros(min(step, n), np.int64) - 1)[:n] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """Ranks of symbols below 2 ** ``levels`` in a sequence."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.ones: list[np.ndarray] = []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.levels = levels

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start, end = np.zeros_like(end), end.copy()
        for level, ones in zip(range(self.levels - 1, -1, -1), self.ones):
            zeros = len(ones) - 1 - ones[-1]
            up = (symbol >> level) & 1 == 1
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Index of a text whose runs end with 0; other symbols are at most ``top``."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        order = suffix_array(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(top).bit_length()))
        self.bwt = bwt
        counts = np.bincount(text, minlength=top + 2)
        self.before = np.append(0, np.cumsum(counts))
        self.n = len(text)
        # sampled: every few positions, and each start of a run, so that no walk back leaves its run
        kept = (order % sample == 0) | (bwt == 0)
        self.sampled = kept
        self.sample_at = np.append(0, np.cumsum(kept))
        self.positions = order[kept]

    def search(self, sequence: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with the ``width`` symbols of ``sequence`` from each start."""
        m = len(starts)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(width - 1, -1, -1):
            symbol = sequence[starts[live] + j].astype(np.int64)
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walks back to sampled ones."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            ended = open_[done]
            out[ended] = self.positions[self.sample_at[at[ended]]] + steps
            open_ = open_[~done]
            symbol = self.bwt[at[open_]].astype(np.int64)
            at[open_] = self.before[symbol] + self.wavelet.rank(symbol, at[open_])
            steps += 1
        return out
