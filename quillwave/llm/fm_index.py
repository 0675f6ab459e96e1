"""A small FM-index over word numbers: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search in lockstep."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes (cyclic) sorted by at least their first `depth` symbols, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    done = 1
    while True:
        pair = rank * len(text) + np.roll(rank, -done)
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        new = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        rank = np.empty_like(rank)
        rank[order] = new
        done *= 2
        if done >= depth or new[-1] == len(text) - 1:
            return order


class Bits:
    """A packed bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[np.pad(packed, (0, -len(packed) % 8)).view(np.uint64), np.zeros(1, np.uint64)]
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Counts occurrences of symbol sequences up to `depth` long in `text` (symbols from 0)."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        order = suffix_order(text, depth)
        bwt = np.roll(text, 1)[order]
        self.symbols = int(text.max(initial=0)) + 1
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=self.symbols))]
        self.levels: list[Bits] = []
        for level in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            bit = (bwt >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(self.symbols)
        self.first = self._descend(symbols, np.zeros(self.symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, bits in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - i) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of `symbol` before what the ranges [lo, hi) stand for."""
        n = len(symbol)
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.starts[symbol] - self.first[symbol]
        return base + both[:n], base + both[n:]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, least: np.ndarray) -> np.ndarray:
    """Per stream text[start : start + length], a bit for each window that occurs at least `least` times in the index.

    Every stream runs backward at its own pace, all in step: a match is drawn out to the left as far as it goes, and marks all
    windows inside; where it ends, the next search begins at the last end that a window not yet judged can have.
    """
    masks = np.zeros(len(starts), np.uint64)
    live = np.flatnonzero(lengths >= window)
    end = lengths[live].astype(np.int64)
    at = end.copy()
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), index.starts[-1])
    while len(live):
        symbol = text[starts[live] + at - 1]
        fresh = at == end
        nlo, nhi = index.starts[symbol], index.starts[symbol + 1]
        go = np.flatnonzero(~fresh)
        if len(go):
            nlo[go], nhi[go] = index.step(symbol[go], lo[go], hi[go])
        fits = nhi - nlo >= least[live]
        lo, hi = nlo, nhi
        at = at - fits
        over = ~fits | (at == 0)  # the match [at, end) goes no further
        if over.any():
            o = np.flatnonzero(over)
            n = end[o] - window - at[o] + 1
            full = o[n > 0]
            bits = (np.uint64(1) << (end[full] - window - at[full] + 1).astype(np.uint64)) - np.uint64(1)
            masks[live[full]] |= bits << at[full].astype(np.uint64)
            end[o] = np.where(n > 0, at[o] + window - 1, end[o] - 1)
            at[o] = end[o]
            keep = ~over | (end >= window)
            keep[o] &= ~((n > 0) & (at[o] - window + 1 <= 0) & (end[o] < window))
            live, end, at, lo, hi = (x[keep] for x in (live, end, at, lo, hi))
    return masks
