"""Intervals of a few rows are extended row by row; results as by brute force."""

import numpy as np

from ledgerbeam.llm import byte_repeats
from ledgerbeam.llm.fm_index import FMIndex


def by_force(text, order, least):
    suffixes = [tuple(text[i : i + least]) for i in order]
    return np.array([False, *[len(b) == least and a == b for a, b in zip(suffixes, suffixes[1:])]])


def test_prefixes_by_rows_and_by_wavelet_matrix(monkeypatch):
    rng, asked = np.random.default_rng(7), []
    fronts = FMIndex.fronts

    def counted(self, low, high):
        asked.extend((high - low).tolist())
        return fronts(self, low, high)

    monkeypatch.setattr(FMIndex, "fronts", counted)
    for narrow, few in ((1, 0), (3, 0), (8, 0), (8, 1 << 14)):
        monkeypatch.setattr(byte_repeats, "NARROW", narrow, raising=False)
        monkeypatch.setattr(byte_repeats, "FEW", few, raising=False)
        for _ in range(60):
            text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
            index, least = FMIndex(text, int(text.max()) + 1, keep_order=True), int(rng.integers(1, 12))
            asked.clear()
            got = byte_repeats.repeated_in_shard(text, np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), least)[index.order]
            like = by_force(text, index.order, least)
            assert (got == (like | np.append(like[1:], False))).all()
            assert not asked or min(asked) > narrow and sum(asked) > few
