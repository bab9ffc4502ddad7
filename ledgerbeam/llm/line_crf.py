"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate; the share of words on content
lines decides whether a text stays. Plain rules on words come first.

Lines enter as a set of yes/no features; the score of a label sequence is the sum of feature weights of each line and of a weight
for each pair of neighbouring labels. Weights are fitted on a bounded sample of labelled texts: all lines of good texts are
content; the lines of bad texts begin as boilerplate and are then relabelled by decoding, `ROUNDS` times. Decoding (Viterbi) runs
over whole texts of any length.

Null text: no words, fails the rules. A text without a line that has a word has a content share of 0. Equal lines and repeated
rows get equal results. Without labelled texts of both kinds every line is content. Other columns pass through unless they are
named like an output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .symbols import WHITE, gram_digests, mix, slices, span_digests, word_bounds

#: Labelled texts of each kind that the weights are fitted on at most: those with the least digest of their id.
SAMPLE_ROWS = 1500
#: Lines of a text that are fitted on at most, the first ones (all lines of all texts are decoded).
SAMPLE_LINES = 200
ROUNDS = 3
#: A text stays if at least this share of its words stands on content lines.
CONTENT_SHARE = 0.5
FEATURES = ("always", "some symbols", "many symbols", "upper case", "exclamation", "bars", "repeated words", "no end", "short", "seen before", "digits")

SYMBOLS, END = np.zeros(256, bool), np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
END[list(b".!?:;\"')")] = True
CLASSES = np.zeros((256, 6), np.int32)  # symbol, upper, lower, exclamation, bar, digit
CLASSES[SYMBOLS, 0] = 1
CLASSES[ord("A") : ord("Z") + 1, 1] = 1
CLASSES[ord("a") : ord("z") + 1, 2] = 1
CLASSES[ord("!"), 3] = CLASSES[ord("|"), 4] = 1
CLASSES[ord("0") : ord("9") + 1, 5] = 1


@dataclass
class Lines:
    """What is known of the lines with a word, and of the rows, of one slice of texts."""

    row: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    base: dict[str, np.ndarray]


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    by = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[by[1:]] = keys[by[1:]] == keys[by[:-1]]
    return again


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends, rows = word_bounds(data, offsets, WHITE)
    n = len(offsets) - 1
    digests = span_digests(data, starts, ends)
    word_row = np.repeat(np.arange(n), np.diff(rows))
    code_points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    symbol_sum = np.append(0, np.cumsum(SYMBOLS[data]))
    base = {"n_words": np.diff(rows), "n_symbols": symbol_sum[offsets[1:]] - symbol_sum[offsets[:-1]]}
    base["word_chars"] = np.bincount(word_row, (code_points[ends] - code_points[starts]), n).astype(np.int64)
    # words in windows of three that stand twice or more in their text
    base["n_repeat_words"] = np.zeros(n, np.int64)
    grams = gram_digests(digests, 3)
    if len(grams):
        inside = word_row[: len(grams)] == word_row[2:]
        key = mix(grams ^ mix(word_row[: len(grams)].astype(np.uint64)))[inside]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(key), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        mark = np.zeros(len(digests), bool)
        at = np.flatnonzero(inside)[twice]
        mark[at] = mark[at + 1] = mark[at + 2] = True
        base["n_repeat_words"] = np.bincount(word_row[mark], minlength=n)
    # lines: stretches between line feeds and row bounds
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1])) if n else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(data))
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    some = last > first
    begin, stop, first, last = begin[some], stop[some], first[some], last[some]
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    row = word_row[first]
    words = last - first
    before = seen_before(mix(span_digests(data, begin, stop) ^ mix(row.astype(np.uint64))))
    base["n_dup_lines"] = np.bincount(row[before], minlength=n)
    sums = np.zeros((len(data) + 1, 6), np.int32)
    np.cumsum(CLASSES[data], axis=0, out=sums[1:])
    symbol, upper, lower, exclaim, bar, digit = (sums[stop] - sums[begin]).T
    next_same = np.append(digests[1:] == digests[:-1], False)
    same_sum = np.append(0, np.cumsum(next_same))
    repeats = same_sum[last - 1] - same_sum[first]
    tests = [np.ones(len(row), bool), symbol > 0.25 * words, symbol > 0.75 * words, (upper > lower) & (words > 2), exclaim > 0.5 * words, bar > 0.3 * words,
             repeats > 0.4 * words, ~END[data[ends[last - 1] - 1]] if len(row) else np.zeros(0, bool), words < 3, before, digit > 0.3 * (stop - begin)]
    codes = sum(t.astype(np.int64) << k for k, t in enumerate(tests))
    return Lines(row, words, codes, base)


def feature_matrix(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)


class Field:
    """Weights of boilerplate against content for each feature, and of neighbouring labels (from, to); label 1 is boilerplate."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    def decode(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels; `first` marks lines that begin a text. One pass keeps the lead of label 1, one goes back."""
        (a00, a01), (a10, a11) = self.step.tolist()
        scores = (feature_matrix(codes) @ self.emit).tolist()
        lead, leads, begins = 0.0, [], first.tolist()
        for k, score in enumerate(scores):
            lead = score if begins[k] else score + max(a01, lead + a11) - max(a00, lead + a10)
            leads.append(lead)
        labels, after = [False] * len(leads), False
        for k in range(len(leads) - 1, -1, -1):
            if k + 1 == len(leads) or begins[k + 1]:
                after = leads[k] > 0
            else:
                after = leads[k] + (a11 if after else a10) > (a01 if after else a00)
            labels[k] = after
        return np.array(labels, bool)

    @staticmethod
    def fit(codes: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Gradient ascent on the likelihood of the labels: forward and backward sums over all texts at once."""
        x = feature_matrix(codes)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(codes)))
        by = np.argsort(-size, kind="stable")
        start, size = start[by], size[by]
        active = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size.max()) if len(size) else 0)]  # texts with more than k lines
        follows = np.flatnonzero(~first)
        seen_steps = np.bincount(2 * labels[follows - 1] + labels[follows], minlength=4).reshape(2, 2)
        field, moment = Field(np.zeros(x.shape[1]), np.zeros((2, 2))), [0.0, 0.0]
        texts = max(1, len(codes))
        for _ in range(steps):
            score = np.stack([np.zeros(len(codes)), x @ field.emit], axis=1)
            forward, backward = score.copy(), np.zeros_like(score)
            for k in range(1, len(active)):
                at = start[: active[k]] + k
                forward[at] += np.logaddexp.reduce(forward[at - 1][:, :, None] + field.step, axis=1)
            for k in range(len(active) - 1, 0, -1):
                at = start[: active[k]] + k
                backward[at - 1] = np.logaddexp.reduce(field.step + (score[at] + backward[at])[:, None, :], axis=2)
            total = np.logaddexp.reduce(forward + backward, axis=1)
            share = np.exp(forward[:, 1] + backward[:, 1] - total)
            pair = np.exp(forward[follows - 1][:, :, None] + field.step + (score[follows] + backward[follows])[:, None, :] - total[follows][:, None, None])
            slopes = [x.T @ (labels - share) / texts - decay * field.emit, (seen_steps - pair.sum(axis=0)) / texts - decay * field.step]
            moment = [0.9 * m + s for m, s in zip(moment, slopes, strict=True)]
            field.emit, field.step = field.emit + rate * moment[0], field.step + rate * moment[1]
        return field


def fit_field(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> Field:
    """Weights from at most `rows` labelled texts of each kind, and of a longer text from its first `SAMPLE_LINES` lines, so that long texts
    teach too. Only features of these lines reach the driver."""
    picked = None
    for value in (0, 1):
        part = labels.where(F.col(label) == value).select(F.col(id_column).alias("_id"), F.col(label).alias("_label")).orderBy(F.xxhash64(id_column), id_column).limit(rows)
        picked = part if picked is None else picked.union(part)
    sample = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.dropDuplicates(["_id"])), F.col("id").eqNullSafe(F.col("_id"))).select("text", F.col("_label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            lines = read_lines(data, offsets)
            few = np.arange(len(lines.row)) - np.searchsorted(lines.row, lines.row) < SAMPLE_LINES
            first = np.append(True, lines.row[1:] != lines.row[:-1]) if len(lines.row) else np.zeros(0, bool)
            take = pa.array(lines.row[few])
            yield pa.record_batch([pa.array(lines.codes[few]), pa.array(first[few]), batch.column("label").take(take)], ["code", "first", "label"])

    got = sample.mapInArrow(run, "code long, first boolean, label int").toArrow()
    codes, first = got.column("code").to_numpy(), got.column("first").to_numpy()
    bad = got.column("label").to_numpy() == 0
    if not bad.any() or bad.all():
        return Field(np.append(-1.0, np.zeros(len(FEATURES) - 1)), np.zeros((2, 2)))
    guess = bad.copy()
    for _ in range(ROUNDS):
        field = Field.fit(codes, first, guess.astype(int))
        guess = bad & field.decode(codes, first)
    return Field.fit(codes, first, guess.astype(int))


def judge_lines(docs: DataFrame, field: Field, text: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """`docs` with the counts of the rules, `base_failed`, `content_share` and `kept`."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    outputs = (*counts, "base_failed", "content_share", "kept")
    columns = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in columns], *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            lines, n = read_lines(data, offsets), batch.num_rows
            first = np.append(True, lines.row[1:] != lines.row[:-1]) if len(lines.row) else np.zeros(0, bool)
            content = ~field.decode(lines.codes, first)
            words = lines.base["n_words"]
            part = np.bincount(lines.row[content], lines.words[content], n) / np.maximum(words, 1)
            failed = (words < 50) | (100 * lines.base["n_repeat_words"] > 50 * words)
            found = [pa.array(lines.base[c], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *found, pa.array(failed), pa.array(part), pa.array(~failed & (part >= share))], [*columns, *outputs])

    return docs.mapInArrow(run, schema)
