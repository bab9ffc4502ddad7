"""Toxicity: restores obfuscated words by a noisy-channel model, then scores the restored text.

Words with a letter and a look-alike character or a letter twice in a row, and three or more single letters or look-alikes set apart
by blanks or marks, are decoded: a lattice holds for each character what it may stand for (itself, look-alike letters, nothing for
a repetition or what stands between), and the Viterbi path is the likeliest under a trigram model of characters counted over all
texts of the corpus. Other words, and words whose path changes no letter, stay as they are written.

The score weighs the evidence of words and of their first four to six bytes, as counted over a bounded sample (`SAMPLE_ROWS`) of
the labelled texts given for learning, which no shuffle of texts is needed for. A logistic model joins the three strongest different words,
the sum over all strong ones, and that sum against the length of the text: long texts hold some such words by chance.

A null or empty text has no evidence and scores low. Ties and repeated rows get equal scores. Without labels of both kinds nothing
is evidence. Other columns pass through unless they are named like an output."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .symbols import LOWER, WHITE, mix, slices, span_digests, word_bounds

#: Slots that words and beginnings of words are hashed to.
SLOTS = 1 << 20
#: Labelled texts of each kind that evidence and the logistic step are fitted on, drawn by a digest of their id; all if there are fewer.
SAMPLE_ROWS = 20_000
PREFIXES = (4, 5, 6)
#: Evidence of a word from which on it counts in the sums; chosen by cross-validation on rows that may be learnt from.
STRONG = 1.7
TOP = 3
#: Words added to the length of a text, so that one word in a short text is no high share.
EXTRA_WORDS = 20
#: Letters that a character may stand for, and what a change costs.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
COST = {"same": 0.0, "look": -0.5, "repeat": -0.3, "double": -5.0, "joined": -1.0}
#: Classes of bytes of the character model: 0 for blanks and marks, letters, digits, and the bytes of other characters in 27 groups.
CLASSES = 64
CLASS = np.zeros(256, np.int64)
CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CLASS[ord("0") : ord("9") + 1] = np.arange(27, 37)
CLASS[128:] = 37 + np.arange(128) % 27
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ALNUM = LETTER.copy()
ALNUM[48:58] = True
LOOK = np.zeros(256, bool)
LOOK[[ord(c) for c in LOOKS]] = True
#: What stands between single letters, as blanks.
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff" + re.escape("".join(LOOKS)).encode() + rb"]+")


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a class after two classes, counted over all texts; blanks in a row count as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for _, data, _ in slices(batches, text):
            c = CLASS[data]
            c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))] if len(c) else c
            if len(c) > 2:
                counts += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], ["code", "n"])

    rows = docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # CLASSES ** 3 rows at most
    counts = np.zeros(CLASSES**3)
    counts[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    pairs = counts.sum(axis=0)
    singles = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    second = (pairs + 20 * singles) / (pairs.sum(axis=1, keepdims=True) + 20)
    return np.log((counts + 20 * second[None]) / (counts.sum(axis=2, keepdims=True) + 20))


class Restorer:
    """Viterbi decoding of words, each remembered by the task."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.restore = functools.lru_cache(maxsize=50_000)(self._restore)

    def _options(self, chars: str, k: int, apart: bool) -> list[tuple[str, float]]:
        c = chars[k]
        options = [(c, COST["same"]), *[(x, COST["look"]) for x in LOOKS.get(c, "")]]
        if k and c == chars[k - 1] and c.isalpha():
            options.append(("", COST["repeat" if c in (chars[k + 1 : k + 2], chars[max(k - 2, 0) : k - 1]) else "double"]))
        if apart and not c.isalnum():
            options.append(("", COST["joined"]))
        return options

    def _restore(self, word: bytes, apart: bool = False) -> bytes:
        """The likeliest reading of a word, or of single letters `apart`; the word as it is written if no letter changes."""
        apart = apart or b" " in word
        chars = word.decode("utf-8", "replace").lower()
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for k in range(len(chars) + 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, done) in paths.items():
                for out, cost in self._options(chars, k, apart) if k < len(chars) else [(" ", 0.0)]:
                    x, y, total = a, b, score + cost
                    for byte in out.encode():
                        z = int(CLASS[byte])
                        if y or z:  # the model counts blanks and marks in a row as one
                            total += self.model[x, y, z]
                            x, y = y, z
                    if (x, y) not in after or total > after[x, y][0]:
                        after[x, y] = (total, done + out if k < len(chars) else done)
            paths = after
        best = max(paths.values(), key=lambda p: (p[0], p[1]))[1]
        return word if best == chars else best.encode()


def letters_apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of groups of three or more single letters or look-alikes, one of them a letter, with blanks or marks between."""
    alnum = ALNUM[data]
    near = np.zeros(len(data) + 2, bool)
    near[1:-1] = alnum | LOOK[data]
    beside = near[:-2] | near[2:]  # also across rows, where a mark alone begins or ends no group
    shown = np.where(alnum | (LOOK[data] & ~beside), data, 0x20).astype(np.uint8)
    starts, ends, rows = word_bounds(shown, offsets, WHITE)
    if len(starts) < 3:
        return np.zeros((2, 0), np.int64)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    single = (points[ends] - points[starts] == 1) & (LETTER | LOOK)[data[starts]]
    within = np.ones(len(starts) - 1, bool)  # whether a gap lies within a row
    inner = rows[(rows > 0) & (rows < len(starts))]
    within[inner - 1] = False
    quote = within & (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 0x27) & single[1:] & single[:-1]
    alone = quote & ~np.append(False, quote[:-1]) & ~np.append(quote[1:], False)  # as in I'm
    cut = np.ones(len(starts) + 1, bool)
    cut[1:-1] = ~(within & single[1:] & single[:-1] & ~alone)
    at = np.flatnonzero(cut)
    low, high = at[:-1], at[1:]
    letters = np.append(0, np.cumsum(LETTER[data[starts]]))
    keep = single[low] & (high - low > 2) & (letters[high] > letters[low])
    return starts[low[keep]], ends[high[keep] - 1]


def odd_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of words with a letter and with a look-alike or a letter twice in a row."""
    starts, ends, _ = word_bounds(data, offsets, WHITE)
    low = LOWER[data]
    twice = np.zeros(len(data), bool)  # at the last byte
    twice[1:] = LETTER[data[1:]] & (data[1:] < 0x80) & (low[1:] == low[:-1])
    twice[3:] |= (data[2:-1] >= 0xC0) & (data[2:-1] == data[:-3]) & (data[3:] == data[1:-2])
    odd_sum, letter_sum = (np.append(0, np.cumsum(x)) for x in (LOOK[data] | twice, LETTER[data]))
    odd = (odd_sum[ends] > odd_sum[starts]) & (letter_sum[ends] > letter_sum[starts])
    return starts[odd], ends[odd]


def restored(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with odd words restored."""
    apart = letters_apart(data, offsets)
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, apart[0], 1)
    np.add.at(cover, apart[1], -1)
    odd = odd_words(np.where(np.cumsum(cover[:-1]) > 0, 0x20, data).astype(np.uint8), offsets)
    spans = sorted([*[(a, b, True) for a, b in zip(*(x.tolist() for x in apart), strict=True)], *[(a, b, False) for a, b in zip(*(x.tolist() for x in odd), strict=True)]])
    raw, parts, done, changed, grown = data.tobytes(), [], 0, [], []
    for a, b, group in spans:
        word = GAP.sub(b" ", raw[a:b]) if group else raw[a:b]
        new = restorer.restore(word, group)
        if new != word:
            parts += [raw[done:a], new]
            changed.append(a)
            grown.append(len(new) - (b - a))
            done = b
    if not changed:
        return data, offsets
    shift = np.zeros(len(offsets), np.int64)
    np.add.at(shift, np.searchsorted(offsets, changed, "right"), grown)
    return np.frombuffer(b"".join([*parts, raw[done:]]), np.uint8), offsets + np.cumsum(shift)


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, without marks around it, the slots of the whole and of its beginnings; and words before each row."""
    starts, ends, rows = word_bounds(data, offsets, ~ALNUM)
    found = [span_digests(data, starts, ends, LOWER)]
    found += [mix(span_digests(data, starts, np.minimum(starts + k, ends), LOWER) + np.uint64(k)) for k in PREFIXES]
    return np.stack([(f >> np.uint64(20)).astype(np.int64) % SLOTS for f in found], axis=1) if len(starts) else np.zeros((0, len(PREFIXES) + 1), np.int64), rows


@dataclass
class Evidence:
    """Log odds of each slot, and the logistic step."""

    odds: np.ndarray
    weights: np.ndarray

    def summary(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row: the `TOP` strongest different words, the sum over strong ones, the sum against the length, and 1."""
        found, rows = slots(data, offsets)
        n, length = len(offsets) - 1, np.diff(rows)
        row = np.repeat(np.arange(n), length)
        different = np.unique(row * SLOTS + found[:, 0], return_index=True)[1]
        row, word = row[different], self.odds[found[different]].max(axis=1, initial=-np.inf)
        strongest = np.lexsort((-word, row))
        count = np.bincount(row, minlength=n)
        begin = np.cumsum(count) - count
        out = np.zeros((n, TOP + 3))
        for k in range(TOP):
            some = count > k
            out[some, k] = np.maximum(word[strongest[begin[some] + k]], 0)
        total = np.bincount(row, np.where(word > STRONG, word, 0), n)
        out[:, TOP] = np.log1p(total)
        out[:, TOP + 1] = np.log1p(50 * total / (length + EXTRA_WORDS))
        out[:, TOP + 2] = 1
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(data, offsets) @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float, decay: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model by Newton steps, each halved until the likelihood grows; the last column of `x` is 1."""
    def value(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (y * z - np.logaddexp(0, z)) - decay / 2 * w @ w)

    w = np.append(np.zeros(x.shape[1] - 1), start)
    best = value(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (weight * (y - p)) - decay * w)
        while np.abs(step).max() > 1e-9 and not value(w + step) > best:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
        best = value(w)
    return w


def learn_evidence(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_column: str, text: str, label: str, smooth: float = 6.0) -> Evidence:
    """Counts slots over the sample (a text counts once in a slot), then fits the logistic step on it, weighted back to the labels' shares."""
    labels = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    totals = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    if len(totals) < 2:
        return Evidence(np.zeros(SLOTS, np.float32), np.append(np.zeros(TOP + 2), -5.0))
    part = F.when(F.col("_label") == 1, SAMPLE_ROWS / totals[1]).otherwise(SAMPLE_ROWS / totals[0])
    picked = labels.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < part * (1 << 30))  # about SAMPLE_ROWS of each kind, at any size
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id").select("text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(model), np.zeros((2, SLOTS), np.int32)
        for batch, data, offsets in slices(batches, "text"):
            found, rows = slots(*restored(data, offsets, restorer))
            row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            once = np.unique(row[:, None] * SLOTS + found)
            np.add.at(seen, (batch.column("_label").to_numpy()[once // SLOTS], once % SLOTS), 1)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["slot", "clean", "toxic"])

    rows = sample.mapInArrow(count, "slot long, clean int, toxic int").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # SLOTS rows at most
    clean, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    clean[rows.column("slot").to_numpy()], toxic[rows.column("slot").to_numpy()] = rows.column("clean").to_numpy(), rows.column("toxic").to_numpy()
    taken = [min(SAMPLE_ROWS, totals[v]) for v in (0, 1)]
    part = taken[1] / sum(taken)
    odds = np.log((toxic + smooth * part) / (taken[1] + smooth)) - np.log((clean + smooth * (1 - part)) / (taken[0] + smooth))
    evidence, share = Evidence(odds.astype(np.float32), np.zeros(TOP + 3)), totals[1] / (totals[0] + totals[1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch, data, offsets in slices(batches, "text"):
            x = evidence.summary(*restored(data, offsets, restorer))
            yield pa.record_batch([batch.column("_label"), *[pa.array(x[:, k]) for k in range(TOP + 2)]], ["label", *names])

    names = [f"x{k}" for k in range(TOP + 2)]
    got = sample.mapInArrow(sums, "label int, " + ", ".join(f"{c} double" for c in names)).orderBy("label", *names).toArrow()
    x = np.column_stack([got.column(c).to_numpy() for c in names] + [np.ones(got.num_rows)])
    y = got.column("label").to_numpy()
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    evidence.weights = logistic(x, y, weight / weight.sum(), math.log(share / (1 - share)))
    return evidence


def score_texts(docs: DataFrame, model: np.ndarray, evidence: Evidence, text: str = "text", with_text: bool = False) -> DataFrame:
    """`docs` with `score`, and with `restored` if asked for."""
    outputs = ["score", *["restored"] * with_text]
    columns = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType()), *[T.StructField("restored", T.StringType())] * with_text])
    shipped = docs.sparkSession.sparkContext.broadcast((model, evidence))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, evidence = shipped.value
        restorer = Restorer(model)
        for batch, data, offsets in slices(batches, text):
            data, offsets = restored(data, offsets, restorer)
            arrays = [*[batch.column(c) for c in columns], pa.array(evidence.scores(data, offsets))]
            if with_text:
                raw = data.tobytes()
                arrays.append(pa.array([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *outputs])

    return docs.mapInArrow(run, schema)
