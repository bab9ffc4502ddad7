"""Texts of an Arrow column as flat symbol arrays: bytes, word bounds and 64-bit word digests, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19
_RANDOM = np.random.default_rng(20250101)
#: A random value for each byte, and odd factors for sums that are folded after each step, so that no arrangement of symbols cancels out.
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: What is kept of eight bytes of which so many belong to a word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Symbols of a run that are digested together.
RUN_BLOCK = 32

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: What stands between words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text; bytes of other characters are over 0x7F.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in pieces of about `limit` bytes of text, each with its bytes and row offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word, and the number of words before each row (with the total at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(between[data], out=inside[1:-1])
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets] = True
    first = inside[1:-1] & (~inside[:-2] | starts_row[:-1])
    last = inside[1:-1] & (~inside[2:] | starts_row[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit digest of the bytes of each span, equal for equal bytes (after `fold`) wherever they stand. Spans are taken eight bytes
    at a time through a bijection: spans of one length up to eight bytes never share a digest, longer ones share one by chance only."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if fold is None else fold[data]
    eights = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    left = ends - starts
    digests = mix(left.astype(np.uint64) + _SEED)
    alive, at = np.arange(len(starts)), starts
    while len(alive):
        digests[alive] = mix(digests[alive] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    return digests


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A value of the two in this order."""
    both = a * _ODD + b
    return both ^ both >> np.uint64(29)


def gram_digests(symbols: np.ndarray, size: int) -> np.ndarray:
    """Digests of every run of `size` symbols (64-bit values), by doubling; length is len(symbols) - size + 1, 0 at least."""
    if len(symbols) < size:
        return np.zeros(0, np.uint64)
    have, block, done, width, rest = None, symbols.copy(), 0, 1, size
    while rest:
        n = len(symbols) - size + 1
        if rest & 1:
            part = block[done : done + n]
            have = part.copy() if have is None else _folded(have, part)
            done += width
        rest >>= 1
        if rest:
            block = _folded(block[:-width], block[width:])
            width *= 2
    return mix(have)


def byte_digests(data: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return _VALUES[data]


def run_digests(symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A digest of each run of symbols, equal for equal runs wherever they stand: blocks of `RUN_BLOCK` symbols (the last one from the end
    back), or single symbols of a shorter run, one after the other."""
    digests = mix((high - low).astype(np.uint64) + _SEED)
    for short, width in ((True, 1), (False, RUN_BLOCK)):
        alive = np.flatnonzero((high - low < RUN_BLOCK) == short)
        grams = symbols if short else gram_digests(symbols, RUN_BLOCK)
        at, last = low[alive], high[alive] - width
        some = at <= last
        while some.any():
            alive, at, last = alive[some], at[some], last[some]
            digests[alive] = mix(_folded(digests[alive], grams[at]))
            some = at < last
            at = np.minimum(at + width, last)
    return digests


def spans_of(mask: np.ndarray, rows: np.ndarray) -> pa.Array:
    """For each row the maximal stretches of set symbols, as (start, stop) counted from the row's first symbol."""
    edge = np.zeros(len(mask) + 1, bool)
    if len(mask):
        edge[1:-1] = mask[1:] != mask[:-1]
        edge[rows] = True
    cuts = np.flatnonzero(edge)
    low, high = cuts[:-1], cuts[1:]
    low, high = low[mask[low]], high[mask[low]]
    row = np.searchsorted(rows, low, "right") - 1
    counts = np.bincount(row, minlength=len(rows) - 1) if len(row) else np.zeros(len(rows) - 1, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(low - rows[row], pa.int32()), pa.array(high - rows[row], pa.int32())], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), spans)
