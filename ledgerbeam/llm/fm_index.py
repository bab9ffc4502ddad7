"""Suffix order, wavelet matrix and FM-index over a bounded sequence of small integers; every step works on whole arrays."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of `text`, whose last symbol is 0 and stands nowhere else: packed first symbols, then doubling of what ties."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    packed = min(n, 64 // bits)
    padded = np.zeros(n + packed, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(packed):
        key = key << np.uint64(bits) | padded[k : k + n]
    order = np.argsort(key).astype(np.int64)
    key = key[order]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.zeros(n + 1, np.int64)  # of the first suffix of each group; 0 past the end is shared by the last symbol alone
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = starts
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = packed
    while len(tied):
        at = order[tied]
        key = rank[at] << 32 | rank[np.minimum(at + step, n)]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[tied] = at
        new = np.ones(len(tied), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class BitRanks:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector a bit of the symbols, from the highest."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            bit = (sequence >> k & 1).astype(bool)
            self.bits.append(BitRanks(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the positions come to stand when all levels have been gone down along the bits of `symbols`."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = bits.ones(at)
            at = np.where(symbols >> (self.levels - 1 - k) & 1, zeros + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and where it comes to stand."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            bit, one = bits.get(at), bits.ones(at)
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + one, at - one)
        return symbols, at

    def split(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all symbols that occur in any of the ranges: symbol and where the range comes to stand."""
        symbols = np.zeros(len(low), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one_low, one_high = bits.ones(low), bits.ones(high)
            left, right = (low - one_low < high - one_high), one_low < one_high
            symbols = np.concatenate([symbols[left] << 1, symbols[right] << 1 | 1])
            low, high = np.concatenate([(low - one_low)[left], zeros + one_low[right]]), np.concatenate([(high - one_high)[left], zeros + one_high[right]])
        return symbols, low, high


class FMIndex:
    """Backward search over a text whose last symbol is 0 and stands nowhere else. Keeps ranks and every `sample`-th position only."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 0, keep_order: bool = False):
        text = text.astype(np.int64)
        order = suffix_order(text, sigma)
        last = text[order - 1]
        self.n, self.sigma = len(text), sigma
        self.ranks = WaveletMatrix(last, sigma)
        counts = np.bincount(text, minlength=sigma)
        every = np.arange(sigma)
        #: What leads from the foot of the wavelet matrix to the rows that begin with a symbol.
        self.lead = np.cumsum(counts) - counts - self.ranks.down(every, np.zeros(sigma, np.int64))
        self.order = order if keep_order else None
        if sample:
            marked = order % sample == 0
            self.sample, self.marks, self.places = sample, BitRanks(marked), order[marked]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the strings with one more symbol in front."""
        lead = self.lead[symbols]
        both = self.ranks.down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return both[: len(low)] + lead, both[len(low) :] + lead

    def fronts(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by one symbol in front that occur: symbol and row range."""
        symbols, low, high = self.ranks.split(low, high)
        lead = self.lead[symbols]
        return symbols, low + lead, high + lead

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the next sampled position."""
        rows, found, steps = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.marks.get(at)
            done = left[hit]
            found[done] = self.places[self.marks.ones(at[hit])] + steps[done]
            left, at = left[~hit], at[~hit]
            symbols, at = self.ranks.access(at)
            rows[left] = at + self.lead[symbols]
            steps[left] += 1
        return found
