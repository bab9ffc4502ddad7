"""Benchmark decontamination: which words of each text stand in a passage of a benchmark item.

The words of a shard of texts become an FM-index over the benchmark's vocabulary: stretches of words that no item has, and
stretches too short for any passage, are one separator each, which no passage holds. All passages of the benchmark are searched
backward at once through ranks of the wavelet matrix, occurrences are located by sampled positions, and what they cover is merged
into spans. There is no shuffle: each text is read, indexed with its neighbours and answered in one task.

Passages: every `size` consecutive words of an item; an item of fewer words is one passage. Items come to the tasks in blocks of
bounded size, one pass over the same task for each block, so the benchmark may have any size.

Null or empty texts have no words, no spans and no items. A null item id takes part without being listed. Items that are equal
or repeated each count. Other columns pass through unless they are named like an output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_repeats import SPANS
from .fm_index import FMIndex
from .symbols import LOWER, NOT_ALNUM, slices, span_digests, spans_of, text_bytes, word_bounds

#: Bytes of item texts in one block, but for a longer item alone.
BLOCK_BYTES = 4 << 20
#: Words that are kept for the index of a shard.
SHARD_WORDS = 1 << 19
BETWEEN = NOT_ALNUM[LOWER]
SAMPLE = 8


class Passages:
    """The distinct passages of a block of items, as numbers of its vocabulary from 2, by their length."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, size: int):
        data, offsets = text_bytes(texts)
        starts, ends, rows = word_bounds(data, offsets, BETWEEN)
        self.words, codes = np.unique(span_digests(data, starts, ends, LOWER), return_inverse=True)
        self.sigma, self.ids = len(self.words) + 2, ids
        lengths = np.diff(rows)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(lengths[lengths > 0], size)):
            of = np.flatnonzero(np.minimum(lengths, size) == length)
            counts = lengths[of] - length + 1
            item = np.repeat(of, counts)
            first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + rows[item]
            distinct, which = np.unique(codes[first[:, None] + np.arange(length)] + 2, axis=0, return_inverse=True)
            by = np.argsort(which.ravel(), kind="stable")
            self.by_length.append((distinct, np.searchsorted(which.ravel()[by], np.arange(len(distinct) + 1)), item[by]))
        self.shortest = min((len(p[0][0]) for p in self.by_length), default=0)

    def number(self, digests: np.ndarray) -> np.ndarray:
        """Numbers of words, 1 for those of no item."""
        if not len(self.words):
            return np.ones(len(digests), np.int64)
        at = np.minimum(np.searchsorted(self.words, digests), len(self.words) - 1)
        return np.where(self.words[at] == digests, at + 2, 1)


def kept_stretches(codes: np.ndarray, rows: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last word of the stretches of known words that are long enough, within rows."""
    edge = np.zeros(len(codes) + 1, bool)
    known = codes > 1
    edge[1:-1] = known[1:] != known[:-1]
    edge[rows] = True
    cuts = np.flatnonzero(edge)
    low, high = cuts[:-1], cuts[1:]
    keep = known[low] & (high - low >= shortest) if len(low) else np.zeros(0, bool)
    return low[keep], high[keep]


def search(passages: Passages, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and (row, item) of all items with a passage in a row."""
    hit, pairs = np.zeros(len(codes) + 1, np.int64), [np.zeros((2, 0), np.int64)]
    low, high = kept_stretches(codes, rows, passages.shortest) if len(codes) and passages.by_length else (np.zeros(0, np.int64),) * 2
    if len(low):
        sizes = high - low
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.ones(int((sizes + 1).sum()) + 1, np.int64)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(begin, sizes) + within] = codes[np.repeat(low, sizes) + within]
        text[-1] = 0
        index = FMIndex(text, passages.sigma, sample=SAMPLE)
        for grams, item_at, items in passages.by_length:
            alive = np.arange(len(grams))
            a, b = np.zeros(len(grams), np.int64), np.full(len(grams), index.n)
            for k in range(grams.shape[1] - 1, -1, -1):
                a, b = index.extend(grams[alive, k], a, b)
                found = b > a
                alive, a, b = alive[found], a[found], b[found]
            if not len(alive):
                continue
            count = b - a
            place = index.locate(np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum()))
            stretch = np.searchsorted(begin, place, "right") - 1
            word = low[stretch] + place - begin[stretch]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + grams.shape[1], -1)
            both = np.unique(np.stack([np.searchsorted(rows, word, "right") - 1, np.repeat(alive, count)]), axis=1)
            n = item_at[both[1] + 1] - item_at[both[1]]
            pairs.append(np.stack([np.repeat(both[0], n), items[np.repeat(item_at[both[1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]]))
    return np.cumsum(hit[:-1]) > 0, *np.unique(np.concatenate(pairs, axis=1), axis=1)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13) -> DataFrame:
    """`docs` with `n_words`, `hits` (spans of hit words, start and stop), `hit_bytes` (the same as bytes of the text) and `items`
    (ids of items with passages in the text, as text)."""
    spark, outputs = docs.sparkSession, ["n_words", "hits", "hit_bytes", "items"]
    columns = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS), T.StructField("hit_bytes", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    nothing = [F.lit(0).cast("long").alias("n_words"), *[F.array().cast(SPANS).alias(c) for c in outputs[1:3]], F.array().cast("array<string>").alias("items")]
    found = docs.select(*columns, *nothing)
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block) if blocks > 1 else benchmark
        part = part.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).toArrow().combine_chunks()
        shipped = spark.sparkContext.broadcast((part.column("id").to_pylist(), part.column("text").to_pylist()))
        found = found.mapInArrow(_pass(shipped, columns, text, size), schema)
    return found


def _pass(shipped, columns: list[str], text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shipped.value
        passages = Passages(pa.array(texts, pa.string()), np.array(ids, object), size)
        held, n = [], 0

        def answer(parts: list) -> Iterator[pa.RecordBatch]:
            every = np.concatenate([p[1] for p in parts]).astype(np.int64)
            sizes = np.concatenate([np.diff(p[2]) for p in parts])
            rows = np.append(0, np.cumsum(sizes))
            hit, row, item = search(passages, every, rows)
            at = 0
            for batch, _, words, own, starts, ends in parts:
                to = at + batch.num_rows
                low, high = np.searchsorted(row, [at, to])
                listed: list[list[str]] = batch.column("items").to_pylist()
                for r, i in zip(row[low:high].tolist(), item[low:high].tolist(), strict=True):
                    if passages.ids[i] is not None and passages.ids[i] not in listed[r - at]:
                        listed[r - at].append(passages.ids[i])
                before = batch.column("hits")
                mask = hit[rows[at] : rows[to]].copy()
                if len(before.flatten()):
                    owner = np.repeat(words[:-1], before.value_lengths().to_numpy(zero_copy_only=False))
                    for a, b in zip(owner + before.flatten().field("start").to_numpy(), owner + before.flatten().field("stop").to_numpy(), strict=True):
                        mask[a:b] = True
                spans = spans_of(mask, words)
                flat, first = spans.flatten(), np.repeat(words[:-1], spans.value_lengths().to_numpy(zero_copy_only=False))
                offset = np.repeat(own, spans.value_lengths().to_numpy(zero_copy_only=False))
                low_byte = starts[first + flat.field("start").to_numpy()] - offset if len(flat) else np.zeros(0, np.int64)
                high_byte = ends[first + flat.field("stop").to_numpy() - 1] - offset if len(flat) else np.zeros(0, np.int64)
                in_bytes = pa.ListArray.from_arrays(spans.offsets, pa.StructArray.from_arrays([pa.array(low_byte, pa.int32()), pa.array(high_byte, pa.int32())], ["start", "stop"]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.diff(words), pa.int64()), spans, in_bytes, pa.array(listed, pa.list_(pa.string()))],
                                                 [*columns, "n_words", "hits", "hit_bytes", "items"])
                at = to

        for batch, data, offsets in slices(batches, text):
            starts, ends, words = word_bounds(data, offsets, BETWEEN)
            codes = passages.number(span_digests(data, starts, ends, LOWER)).astype(np.int32)
            held.append((batch, codes, words, offsets[:-1], starts, ends))
            n += len(codes)
            if n >= SHARD_WORDS:
                yield from answer(held)
                held, n = [], 0
        if held:
            yield from answer(held)
    return run
