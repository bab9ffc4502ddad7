"""Quality classifier: Bradley-Terry ranking of texts learned from preference pairs, with a threshold at a score quantile.

Each pair says that one labelled text is better than another; the logistic loss on the difference of their features is minimised.
The score of a text is its features times the weights. The threshold is the quantile at the share of bad labels, over the scores of
all labelled texts; scores are moved so that it comes to stand at `CUT`. Only the fit of the weights is sampled. Features are counts over whole texts.

A null or empty text has all counts 0 and a score as any other. Ties and repeated rows get equal scores. Without labels of both
kinds all weights are 0 and every text scores `CUT`. Other columns pass through unless they are named like an output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .symbols import WHITE, gram_digests, mix, slices, span_digests, word_bounds

#: Labelled texts of each kind that weights are learned from at most: those with the least digest of their id.
SAMPLE_ROWS = 3000
#: Better texts that each worse one of the sample is paired with.
PARTNERS = 12
CUT = 0.3
MARKS = b"#*$%&|<>!"
NAMES = ("words", "length", "symbols", "exclamations", "bars", "upper", "digits", "ends", "lines", "same as before", "seen", "grams seen")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    starts, ends, rows = word_bounds(data, offsets, WHITE)
    n, counts = len(offsets) - 1, np.diff(rows)
    row = np.repeat(np.arange(n), counts)
    digests = span_digests(data, starts, ends)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / words

    def of_words(flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n) / words

    def seen(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        keys = mix(keys ^ mix(owner.astype(np.uint64)))
        by = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[by[1:]] = keys[by[1:]] == keys[by[:-1]]
        return again

    words = np.maximum(counts, 1)
    grams = gram_digests(digests, 3)
    inside = row[: len(grams)] == row[2:][: len(grams)]
    upper, lower = ((data >= lo) & (data <= lo + 25) for lo in (65, 97))
    before = np.append(False, (digests[1:] == digests[:-1]) & (row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
    found = [np.log1p(counts), share(~WHITE[data]), share(np.isin(data, np.frombuffer(MARKS, np.uint8))), share(data == 33), share(data == 124),
             share(upper) / (share(upper) + share(lower) + 1e-9), share((data >= 48) & (data <= 57)), share((data == 46) | (data == 63)), share(data == 10),
             of_words(before, row), of_words(seen(digests, row), row), of_words(seen(grams[inside], row[: len(grams)][inside]), row[: len(grams)][inside])]
    return np.nan_to_num(np.stack(found, axis=1))


@dataclass
class Ranking:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, `CUT` at the threshold."""
        lead = self.raw(x) - self.threshold + np.log(CUT / (1 - CUT))
        return np.maximum(1 / (1 + np.exp(-np.clip(lead, -40, 40))), 0.0)


def learn(x: np.ndarray, good: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Ranking:
    """Gradient descent on the pairs; the threshold is left at 0."""
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    ranking = Ranking(center, scale, np.zeros(len(NAMES)), 0.0)
    if not good.any() or good.all():
        return ranking
    z = np.clip((x - center) / scale, -6, 6)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pick = (np.arange(len(worse) * PARTNERS) * 7919) % len(better)
    lead = z[better[pick]] - z[np.repeat(worse, PARTNERS)]
    for _ in range(steps):
        wrong = 1 / (1 + np.exp(np.clip(lead @ ranking.weights, -40, 40)))
        ranking.weights = ranking.weights + rate * (lead.T @ wrong / len(lead) - decay * ranking.weights)
    return ranking


def fit_ranking(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> Ranking:
    """Weights from at most `rows` labelled texts of each kind, whose features reach the driver; the threshold from all labelled texts."""
    parts = [labels.where(F.col(label) == value).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64(id_column), id_column).limit(rows) for value in (0, 1)]
    picked = F.broadcast(parts[0].union(parts[1]).dropDuplicates(["_id"]))
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).join(picked, "_id").select("text", "_id", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            x = features(data, offsets)
            yield pa.record_batch([batch.column("_id").cast(pa.string()), batch.column("_label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "label", "x"])

    got = sample.mapInArrow(run, "id string, label int, x array<double>").orderBy("id", "label", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    ranking = learn(x, got.column("label").to_numpy() == 1)
    ranking.threshold = threshold(docs, labels, ranking, id_column, text, label)
    return ranking


def threshold(docs: DataFrame, labels: DataFrame, ranking: Ranking, id_column: str, text: str, label: str) -> float:
    """The middle between the two scores about the quantile at the share of bad labels, over all labelled texts. Texts are scored
    before they meet their labels, so that only ids and scores are shuffled; one row reaches the driver."""
    if not ranking.weights.any():
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            yield pa.record_batch([batch.column("_id"), pa.array(ranking.raw(features(data, offsets)))], ["_id", "raw"])

    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_column].dataType), T.StructField("raw", T.DoubleType())])
    scored = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).mapInArrow(run, schema).join(known, "_id")
    n, bad = scored.agg(F.count("*"), F.sum(1 - F.col("_label"))).first()
    if not n:
        return 0.0
    at = min(max(bad, 1), n - 1) / n  # between the last bad score and the next one, if bad texts had the least scores
    accuracy = 1_000_000
    low, high = scored.agg(F.percentile_approx("raw", F.array(F.lit(at), F.lit(min(1.0, at + 1 / n))), accuracy)).first()[0]
    return (low + high) / 2


def rank(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """`docs` with `score`."""
    columns = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(ranking.scores(features(data, offsets)))], [*columns, "score"])

    return docs.mapInArrow(run, schema)
