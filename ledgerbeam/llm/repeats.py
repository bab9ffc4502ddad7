"""Windows of a fixed number of symbols that stand at two places or more in a corpus, found exactly without one index of everything.

Equal windows hold equal runs of `gram` symbols, and so have the same least digest of such runs. Texts are cut into segments:
stretches of consecutive windows with the same least digest. Only segments whose digest stands in two or more are looked at
further; equal segments count as one with a number of copies. What is left meets by its digest in shards of bounded size, and a
shard function (suffix intervals, or an FM-index) decides which windows repeat. Where very many different segments share a
digest, they are cut again with longer runs; with a run as long as the window, all windows of a digest are equal. So no group is
ever held whole, whatever its number of copies, and the result does not depend on any limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, free_name
from .symbols import WHITE, byte_digests, gram_digests, run_digests, slices, span_digests, text_bytes, word_bounds

#: Different segments of one digest that meet in one shard at most; beyond it the digest is cut again.
MEET = 4000
#: Bytes of the segments of a shard, but for the digest that passes it.
SHARD_BYTES = 1 << 20
KEY = ["pid", "pid2"]


@dataclass(frozen=True)
class Kind:
    """What a symbol is: bytes, or words between white space."""

    words: bool
    window: int
    grams: tuple[int, ...]

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit value for each symbol, the number of symbols before each row, first and past-the-last byte of each symbol."""
        if self.words:
            starts, ends, rows = word_bounds(data, offsets, WHITE)
            return span_digests(data, starts, ends), rows, starts, ends
        places = np.arange(len(data) + 1)
        return byte_digests(data), offsets, places[:-1], places[1:]


BYTES = Kind(False, 400, (64, 232, 330, 400))
WORDS = Kind(True, 35, (8, 22, 30, 35))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    least, have = values, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return least if have == width else np.minimum(least[: len(values) - width + 1], least[width - have :][: len(values) - width + 1])


def segments(symbols: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (counted from the row's first symbol), number of windows and least digest of every segment, and at how
    many places its windows have that digest first: windows of one segment are equal only if they are more than one."""
    if len(symbols) < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    digests = gram_digests(symbols, gram)
    least = sliding_least(digests, window - gram + 1)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(least)]
    inside = np.arange(len(least)) + window <= rows[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new & inside)
    stop = np.flatnonzero((np.append(new[1:], True) | np.append(~inside[1:], True)) & inside) + 1
    moves = np.append(0, np.cumsum(digests[: len(least)] == least))  # the window after has it first at another place
    return row[at], at - rows[row[at]], stop - at, 1 + moves[stop - 1] - moves[at], least[at]


def _cut(kind: Kind, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "body"):
            symbols, rows, starts, ends = kind.symbols(data, offsets)
            row, first, count, places, least = segments(symbols, rows, kind.window, gram)
            if not len(row):
                continue
            low, high = rows[row] + first, rows[row] + first + count + kind.window - 1
            # the digest of a segment is one of its symbols, so that other white space makes no other segment
            sid = run_digests(symbols, low, high)
            ids = [batch.column(c).take(pa.array(row)) for c in (*KEY, "copies")]
            yield pa.record_batch([*ids, pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(places, pa.int32()), pa.array(least.view(np.int64)), pa.array(sid.view(np.int64))],
                                  [*KEY, "copies", "first", "n", "places", "least", "sid"])
    return run


def _bodies(kind: Kind) -> Callable:
    """Bytes of the segments wanted of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "body"):
            _, rows, starts, ends = kind.symbols(data, offsets) if kind.words else (None, offsets, None, None)
            wanted = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            low = rows[owner] + flat.field("first").to_numpy()
            high = low + flat.field("n").to_numpy() + kind.window - 1
            lo, hi = (starts[low], ends[high - 1]) if kind.words else (low, high)
            text = data.tobytes()
            yield pa.record_batch([flat.field("least"), flat.field("sid"), flat.field("copies"), pa.array([text[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary())],
                                  ["least", "sid", "copies", "body"])
    return run


def joined(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text of all rows for an index: symbols from 2, a 1 after each row and a 0 at the end; and where each row begins in it."""
    sizes = np.diff(rows)
    text = np.ones(len(codes) + len(sizes) + 1, np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes.astype(np.int64) + 2
    text[-1] = 0
    return text, rows[:-1] + np.arange(len(sizes))


def stretches(repeated: np.ndarray, at: np.ndarray, sizes: np.ndarray, whole: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and number of consecutive windows that repeat. repeated: by place in the text; a row with copies repeats whole."""
    here = np.zeros(len(repeated) + 1, np.int8)
    windows = sizes - window + 1
    np.add.at(here, at, 1)
    np.add.at(here, at + windows, -1)
    good = np.cumsum(here[:-1]).astype(bool)
    mark = np.zeros(len(repeated) + 1, np.int8)
    np.add.at(mark, at[whole], 1)
    np.add.at(mark, (at + windows)[whole], -1)
    edge = np.diff(np.concatenate([[0], (good & (repeated | np.cumsum(mark[:-1]).astype(bool))).astype(np.int8), [0]]))
    first, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    row = np.searchsorted(at, first, "right") - 1
    return row, first - at[row], stop - first


def _shards(kind: Kind, decide: Callable) -> Callable:
    """Gathers whole digests into shards and has each decided; gives (least, sid, first, n): stretches of repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            t = t.group_by(["least", "sid"], use_threads=False).aggregate([("copies", "max"), ("body", "first")])
            body = t.column("body_first").combine_chunks()
            data, rows = text_bytes(body)
            codes = data
            if kind.words:
                digests, rows, _, _ = kind.symbols(data, rows)
                codes = np.unique(digests, return_inverse=True)[1]
            text, at = joined(codes, rows)
            whole = t.column("copies_max").to_numpy() > 1
            repeated = decide(text, at, np.diff(rows), whole, kind.window)
            owner, first, n = stretches(repeated, at, np.diff(rows), whole, kind.window)
            if len(owner):
                take = pa.array(owner)
                yield pa.record_batch([t.column("least").combine_chunks().take(take), t.column("sid").combine_chunks().take(take), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                                      ["least", "sid", "first", "n"])

        for batch in batches:
            least = batch.column("least").to_numpy()
            change = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
            lengths = text_bytes(batch.column("body"))[1]
            done = 0
            for at in change:
                if size + lengths[at] - lengths[done] >= SHARD_BYTES and not (at == 0 and (not held or held[-1].column("least")[-1].as_py() == least[0])):
                    if at > done:
                        held.append(batch.slice(done, at - done))
                    yield from flush(held)
                    held, size, done = [], 0, int(at)
            held.append(batch.slice(done))
            size += int(lengths[-1] - lengths[done])
        if held:
            yield from flush(held)
    return run


def repeated_windows(texts: DataFrame, kind: Kind, decide: Callable, scratch: Scratch, level: int = 0) -> DataFrame:
    """(pid, pid2, first, n) of `texts` (pid, pid2, copies, body): stretches of windows that stand at two places or more."""
    spark, name = texts.sparkSession, f"level{level}"
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "pid long, pid2 int, copies long, first int, n int, places int, least long, sid long"
    cuts = scratch.cut(texts.mapInArrow(_cut(kind, kind.grams[level]), schema), f"{name}-cuts")
    shared = cuts.groupBy("least").agg(F.sum(F.col("copies") * F.col("places")).alias("c")).where("c > 1").select("least")
    met = scratch.cut(cuts.join(shared, "least"), f"{name}-met")
    scratch.drop(f"{name}-cuts")
    kinds = met.groupBy("least", "sid").agg(F.sum("copies").alias("copies"), F.max("places").alias("places"), F.min(F.struct(*KEY, "first", "n")).alias("where"))
    kinds = scratch.cut(kinds, f"{name}-kinds")
    groups = kinds.groupBy("least").agg(F.count("*").alias("different"), (F.max("places") > 1).alias("within"))
    alone = kinds.join(groups.where("different = 1 and not within").select("least"), "least").where("copies > 1")
    alone = alone.select("least", "sid", F.lit(0).alias("first"), F.col("where.n").alias("n"))
    last = level + 1 == len(kind.grams)
    some = kinds.join(groups.where("different > 1 or within").select("least"), "least")
    wanted = some.groupBy(*[F.col(f"where.{c}").alias(c) for c in KEY]).agg(F.collect_list(F.struct("least", "sid", "copies", "where.first", "where.n")).alias("wanted"))
    wanted = wanted.join(texts.select(*KEY, "body").dropDuplicates(KEY) if level else texts.select(*KEY, "body"), KEY)
    bodies = wanted.select("body", "wanted").mapInArrow(_bodies(kind), "least long, sid long, copies long, body binary")
    if last:
        small = bodies
    else:
        many = groups.where(F.col("different") > MEET)
        bodies = scratch.cut(bodies, f"{name}-bodies")
        small = bodies.join(many.select("least"), "least", "left_anti")
    decided = small.repartition(spread, "least").sortWithinPartitions("least").mapInArrow(_shards(kind, decide), "least long, sid long, first int, n int")
    found = alone.union(decided)
    if not last:
        hot = scratch.cut(bodies.join(many.select("least"), "least"), f"{name}-hot")
        if not hot.isEmpty():
            again = hot.dropDuplicates(["least", "sid"]).select(F.col("sid").alias("pid"), F.hash("least").alias("pid2"), "least", "copies", "body")
            below = repeated_windows(again.select(*KEY, "copies", "body"), kind, decide, scratch, level + 1)
            found = found.union(below.join(again.select(*KEY, "least"), KEY).select("least", F.col("pid").alias("sid"), "first", "n"))
    found = found.withColumnsRenamed({"first": "from", "n": "count"})
    return met.join(found, ["least", "sid"]).select(*KEY, (F.col("first") + F.col("from")).alias("first"), F.col("count").alias("n"))


def with_repeats(docs: DataFrame, text: str, kind: Kind, decide: Callable, scratch: Scratch) -> tuple[DataFrame, str]:
    """`docs` with an array of (first, n), its stretches of repeated windows, null where it has none; and the name of that column.

    A row is known by two digests of all its columns, so that equal rows get equal stretches and a task that runs again finds
    the same rows."""
    columns = docs.columns
    keyed = docs.select(F.xxhash64(*columns).alias("pid"), F.hash(*columns).alias("pid2"), F.struct(*columns).alias("row"))  # no name of theirs meets ours
    texts = keyed.select(*KEY, F.lit(1).cast("long").alias("copies"), F.col("row").getField(text).cast("binary").alias("body"))
    found = repeated_windows(texts, kind, decide, scratch)
    found = found.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("first", "n")).alias("found"))
    name = free_name("_repeats", columns)
    return keyed.join(found, KEY, "left").select("row.*", F.col("found").alias(name)), name


def covered(repeats: pa.Array, rows: np.ndarray, window: int) -> np.ndarray:
    """Which symbols of the rows stand in a repeated window."""
    owner = np.repeat(np.arange(len(repeats)), repeats.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = repeats.flatten()
    low = rows[owner] + flat.field("first").to_numpy()
    mark = np.zeros(rows[-1] + 1, np.int64)
    np.add.at(mark, low, 1)
    np.add.at(mark, low + flat.field("n").to_numpy() + window - 1, -1)
    return np.cumsum(mark[:-1]) > 0
