"""Substring dedup: removes every word covered by a window of consecutive words that stands at two places or more.

Candidates meet in bounded shards (see repeats.py). Each shard gets a compressed FM-index: bits of a wavelet matrix over the
Burrows-Wheeler transform of its word numbers, with counts each 64 bits. Its texts are then streamed against it from their ends:
backward search keeps the longest stretch that occurs twice or more (the matching statistic of its end) and reports stretches of
a window or more. All texts of a shard step together, as arrays.

Null text: no words. Texts with fewer words than a window lose nothing. Repeated rows are two places. Other columns pass through
unless they are named like an output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_repeats import SPANS, grams
from .fm_index import FMIndex
from .repeats import WORDS, covered, with_repeats
from .shared import Scratch
from .symbols import WHITE, slices, spans_of, word_bounds


def matching_stretches(index: FMIndex, text: np.ndarray, at: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of stretches of `window` symbols or more that occur at least twice in the index."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    keep = sizes >= window
    begin, stop = at[keep], (at + sizes)[keep]
    here, low, high = stop.copy(), np.zeros(len(begin), np.int64), np.full(len(begin), index.n)
    while len(begin):
        going = here > begin
        new_low, new_high = index.extend(text[np.maximum(here - 1, 0)], low, high)
        more = going & (new_high - new_low > 1)
        ends = ~more & (stop - here >= window)
        if ends.any():
            found.append((here[ends], stop[ends]))
        # a window that holds the failing stretch cannot repeat: the next one starts at its first symbol, or ends one earlier
        turn = np.minimum(stop - 1, here - 1 + window)
        stop = np.where(more, stop, turn)
        here, low, high = np.where(more, here - 1, turn), np.where(more, new_low, 0), np.where(more, new_high, index.n)
        left = (going | more) & (stop - begin >= window)
        if not left.all():
            begin, stop, here, low, high = (x[left] for x in (begin, stop, here, low, high))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_in_shard(text: np.ndarray, at: np.ndarray, sizes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    index = FMIndex(text, int(text.max()) + 1)
    low, high = matching_stretches(index, text, at[~whole], sizes[~whole], window)
    mark = np.zeros(len(text) + 1, np.int64)
    np.add.at(mark, low, 1)
    np.add.at(mark, high - window + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeated_words(docs: DataFrame, text: str = "text", window: int = 35, scratch: Scratch | None = None) -> DataFrame:
    """`docs` with `n_words`, `kept` (the words that stay, joined by one space) and `removed` (maximal removed stretches of words)."""
    kind = WORDS if window == WORDS.window else replace(WORDS, window=window, grams=grams(window))
    marked, repeats = with_repeats(docs, text, kind, repeated_in_shard, scratch or Scratch(docs.sparkSession, "word-repeats"))
    outputs = ("n_words", "kept", "removed")
    columns = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("n_words", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            starts, ends, rows = word_bounds(data, offsets, WHITE)
            gone = covered(batch.column(repeats), rows, window)
            # kept words with a space after each: bytes of kept words, and one more byte each that is made a space
            length = np.where(gone, 0, ends - starts + 1)
            place = np.append(0, np.cumsum(length))
            source = np.repeat(starts - place[:-1], length) + np.arange(place[-1])
            out = np.where(np.arange(place[-1]) + 1 == np.repeat(place[1:], length), 32, data[np.minimum(source, len(data) - 1)] if len(data) else 0).astype(np.uint8).tobytes()
            bounds = place[rows]
            kept = pa.array([out[a:max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.diff(rows), pa.int64()), kept, spans_of(gone, rows)], [*columns, *outputs])

    return marked.mapInArrow(run, schema)
