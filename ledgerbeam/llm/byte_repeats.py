"""Suffix-array dedup: removes every byte covered by a string of a given number of bytes that stands at two places or more.

Candidates meet in bounded shards (see repeats.py). In a shard, rows of the Burrows-Wheeler transform that share a prefix are
found by threshold-bounded interval expansion: starting from the empty string, all intervals of strings of one length are
extended by one byte in front, breadth first, so that common prefixes are derived by increasing value; an interval whose end is
known already is not followed, and the expansion stops at the threshold. What then has no value shares a prefix at least as long.

Null text: no bytes. Texts shorter than the threshold lose nothing. Repeated rows are two places. Other columns pass through
unless they are named like an output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .fm_index import FMIndex
from .repeats import BYTES, covered, with_repeats
from .shared import Scratch
from .symbols import slices, spans_of

#: Rows of an interval up to which they are followed one by one, and of all wider ones together up to which these are, too.
NARROW, FEW = 8, 1 << 14
#: Intervals that are followed row by row at once, so that their rows take little memory beside the index.
AT_ONCE = 1 << 15
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def narrow_fronts(low: np.ndarray, high: np.ndarray, front: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``FMIndex.fronts`` of intervals of a few rows, row by row: where each row comes to stand with the symbol before it in front
    (`front`), and the first symbols of rows (`heads`) tell which of one interval stay together."""
    size = high - low
    single = front[low[size == 1]]
    low, size = low[size > 1], size[size > 1]
    owner = np.repeat(np.arange(len(low)), size)
    rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
    at = front[rows].astype(np.int64)
    if len(size) and size.max() > 2:
        at = np.sort(owner << 32 | at) & 0xFFFFFFFF  # within an interval by symbol; rows of one symbol follow each other as before
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (owner[1:] != owner[:-1]) | (heads[at[1:]] != heads[at[:-1]])
    first = np.flatnonzero(new)
    start = at[first[:-1]]
    return np.concatenate([start, single]), np.concatenate([start + np.diff(first), single + 1])


def long_prefixes(index: FMIndex, text: np.ndarray, least: int) -> np.ndarray:
    """For each row of the transform, whether it shares a prefix of `least` symbols or more with the row before it.

    Intervals of a few rows, which nearly all are after some steps, are extended row by row; only wide ones go down the wavelet matrix."""
    place = np.empty(index.n, np.int32)
    place[index.order] = np.arange(index.n, dtype=np.int32)
    front, heads = place[index.order - 1], text.astype(np.uint16)[index.order]
    del place
    known = np.zeros(index.n + 1, bool)
    known[[0, index.n]] = True
    low, high = np.array([0]), np.array([index.n])
    known[index.n] = False
    for _ in range(least):
        size = high - low
        narrow = size <= (NARROW if size[size > NARROW].sum() > FEW else index.n)
        few_low, few_high = low[narrow], high[narrow]
        parts = [narrow_fronts(few_low[k : k + AT_ONCE], few_high[k : k + AT_ONCE], front, heads) for k in range(0, len(few_low), AT_ONCE)]
        if not narrow.all():
            parts.append(index.fronts(low[~narrow], high[~narrow])[1:])
        low, high = (np.concatenate(side) for side in zip(*parts, strict=True))
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(high):
            break
    return ~known[: index.n]


def repeated_in_shard(text: np.ndarray, at: np.ndarray, sizes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    index = FMIndex(text, int(text.max()) + 1, keep_order=True)
    like = long_prefixes(index, text, window)
    repeated = np.zeros(len(text), bool)
    repeated[index.order] = like | np.append(like[1:], False)
    return repeated


def remove_repeated_bytes(docs: DataFrame, text: str = "text", least: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """`docs` with `kept` (binary: the bytes that stay) and `removed` (maximal removed stretches of bytes, start and stop)."""
    kind = BYTES if least == BYTES.window else replace(BYTES, window=least, grams=grams(least))
    marked, repeats = with_repeats(docs, text, kind, repeated_in_shard, scratch or Scratch(docs.sparkSession, "byte-repeats"))
    columns = [c for c in docs.columns if c not in ("kept", "removed")]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("kept", T.BinaryType()), T.StructField("removed", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            gone = covered(batch.column(repeats), offsets, least)
            kept, left = data[~gone].tobytes(), np.append(0, np.cumsum(~gone))[offsets]
            bodies = pa.array([kept[a:b] for a, b in zip(left[:-1], left[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], bodies, spans_of(gone, offsets)], [*columns, "kept", "removed"])

    return marked.mapInArrow(run, schema)


def grams(window: int) -> tuple[int, ...]:
    """Lengths of the runs by which windows meet: about a sixth of the window, then longer, at last the window."""
    return tuple(sorted({max(1, window // 6), max(1, window // 2), max(1, window * 5 // 6), window}))
