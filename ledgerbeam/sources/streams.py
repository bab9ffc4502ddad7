"""Tag-length-value streams read back: one line without line ends, in which only the lengths tell where a field stops.

The text reader cuts a file at the end marker, so a stream is read by as many tasks as it has splits. The marker's letters may also
stand inside a value, and a submission may lie in several part files, so no cut says by itself where a subject begins. Each block of
cuts is therefore read from every place at which it could be entered: it becomes a map from the state before it to the state after
it. Maps are composed by a prefix scan over blocks, splits, files and the submission, which gives each block its true state, whatever
came before. Blocks that begin and end between subjects are then taken apart on their own; the few that do not are joined first.

A stream that cannot be followed to its trailer gives one fault and no records."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cross_rows import whole_file_issues
from ..operators.partitioning import by_submission, cut, small_enough
from ..specs.model import Format
from ..storage import file_paths
from .bureau_files import _submission

#: Bytes of a block, but for what comes with its last cut. Writers and readers of tables hold some hundred rows at a time, so blocks are small.
BLOCK_BYTES = 1 << 16
#: Bytes of the blocks that a task holds at a time when they are written and read back.
GROUP_BYTES = 1 << 23
#: Segments that a task takes apart before it hands them on.
SEGMENTS = 4096
#: Bytes of a file whose splits are composed together.
REACH = 1 << 33

#: States between blocks: between subjects, 1 to 99 bytes of a value to come, between fields of a subject, after the trailer, not
#: readable, and before the header.
FRESH, MID, DONE, BAD, HEAD = 0, 100, 101, 102, 103
STATES = 104
PLACE = ("submission_id", "file", "reach", "block_start", "n")
_RECORDS = "submission_id string, file string, reach long, block_start long, n int, subject int, part int, tag string, values array<string>, unknown array<string>"
_BLOCK = "submission_id string, file string, file_size long, block_start long, n int, open boolean, body binary"


class Stream(NamedTuple):
    records: DataFrame
    faults: DataFrame


class Grammar:
    """The markers of a layout and the fields that may follow each of them."""

    def __init__(self, fmt: Format):
        self.end, self.trailer = fmt.body[-1].fields[0].default.encode(), fmt.trailer.fields[0].default.encode()
        self.header = sum(f.width for f in fmt.header.fields)
        self.markers = [(s.tlv_prefix or s.fields[0].default).encode() for s in fmt.body]
        self.tags = [s.tag for s in fmt.body]
        self.codes = [{f.tlv: i for i, f in enumerate(s.fields) if f.tlv} for s in fmt.body]
        self.blank = [[f.default if f.key.startswith("_") else "" for f in s.fields] for s in fmt.body]

    def follow(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a block, if a token begins there: where the next one begins, as a byte or (from the block's length on) as a
        state after the block; and which marker the token is, -1 for a field."""
        n = len(body)
        data = np.frombuffer(body, np.uint8)
        padded = np.append(data, np.zeros(16, np.uint8)).astype(np.int32)
        digit = (padded >= 48) & (padded <= 57)
        field = digit[:n] & digit[1 : n + 1] & digit[2 : n + 2] & digit[3 : n + 3]
        place = np.arange(n, dtype=np.int32)
        to = np.where(field, place + 4 + 10 * (padded[2 : n + 2] - 48) + padded[3 : n + 3] - 48, -1)
        which = np.full(n, -1, np.int16)
        for k, marker in enumerate((*self.markers, self.trailer)):
            here = np.ones(n, bool)
            for j, byte in enumerate(marker):
                here &= padded[j : n + j] == byte
            which[here], to[here] = k, place[here] + len(marker)
        out = np.where(to < n, to, np.where(to == n, n + MID, to))  # past the end: what is left of the value
        out = np.where(to > n, np.minimum(to - n, 99) + n, out)
        out[(to == n) & (which == len(self.markers) - 1)] = n + FRESH
        ends = which == len(self.markers)
        out[ends] = n + BAD
        if len(rest := np.flatnonzero(ends)) and not body[rest[-1] + len(self.trailer) :].strip():
            out[rest[-1]] = n + DONE
        out[to < 0] = n + BAD
        return out, which

    def transfer(self, body: bytes) -> np.ndarray:
        """The state after the block for each state before it."""
        n = len(body)
        jump = np.concatenate([self.follow(body)[0], n + np.arange(STATES, dtype=np.int32)])
        entry = np.arange(STATES)
        at = np.where(entry < n, entry, np.where(entry == n, n + MID, n + np.minimum(entry - n, 99)))
        at[[FRESH, MID]] = 0
        at[DONE] = n + (DONE if not body.strip() else BAD)
        at[BAD] = n + BAD
        at[HEAD] = n + BAD if n < self.header else self.header if n > self.header else n + FRESH
        while (at < n).any():
            at, jump = jump[at], jump[jump]
        return at - n

    def records(self, body: bytes, start: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """(subject, marker, values in layout order, codes the segment does not have) of a block entered between subjects."""
        to, which = (x.tolist() for x in self.follow(body))
        n, at, subject, marker, values, odd = len(body), start, 0, -1, [], []
        while at < n:
            k, step = which[at], to[at]
            if k >= 0:
                if marker >= 0:
                    yield subject, marker, values, odd
                    subject += marker == len(self.markers) - 1
                if k == len(self.markers):
                    return
                marker, values, odd = k, list(self.blank[k]), []
            else:
                code, text = body[at : at + 2].decode(), body[at + 4 : step if step < n else n].decode("latin-1")
                place = self.codes[marker].get(code) if marker >= 0 else None
                if place is None:
                    odd.append(code)
                else:
                    values[place] = text
            at = step
        if marker >= 0:
            yield subject, marker, values, odd


def _gather(end: bytes):
    """Consecutive pieces of a split as blocks. The last piece of a split is left open: only the file's size tells what follows it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, parts, size = None, 0, [], 0

        def block(is_open: bool) -> pa.RecordBatch:
            body = end.join(parts) if is_open else end.join([*parts, b""])
            return pa.record_batch([pa.array([v]) for v in at] + [pa.array([n], pa.int32()), pa.array([is_open]), pa.array([body], pa.binary())],
                                   ["submission_id", "file", "file_size", "block_start", "n", "open", "body"])

        for batch in batches:
            for *place, piece in zip(*[batch.column(c).to_pylist() for c in ("submission_id", "file", "file_size", "block_start", "piece")], strict=True):
                if place != at:
                    if at:
                        yield block(True)
                    at, n, parts, size = place, 0, [], 0
                elif size >= BLOCK_BYTES:
                    yield block(False)
                    n, parts, size = n + 1, [], 0
                parts.append(piece)
                size += len(piece) + len(end)
        if at:
            yield block(True)
    return run


def read_blocks(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(submission_id, file, reach, block_start, n, body): all bytes of the files below a path in blocks, in file order."""
    raw = spark.read.option("lineSep", end).option("recursiveFileLookup", True).text(file_paths(spark, path))
    pieces = raw.select(_submission(F.col("_metadata.file_path")).alias("submission_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
                        F.col("_metadata.file_block_start").alias("block_start"), F.col("value").cast("binary").alias("piece"))
    blocks = cut(pieces.mapInArrow(_gather(end.encode()), _BLOCK), "stream", GROUP_BYTES)
    held = F.sum(F.length("body") + F.when(F.col("open"), len(end)).otherwise(0))
    last = blocks.groupBy("file").agg((held > F.max("file_size")).alias("short"), F.max(F.struct("block_start", "n")).alias("at"))
    closed = F.when(F.col("short") & (F.struct("block_start", "n") == F.col("at")), F.col("body")).otherwise(F.concat("body", F.lit(end).cast("binary")))
    whole = blocks.filter("open").join(last, "file").withColumn("body", closed).select(*blocks.columns).unionByName(blocks.filter("not open"))
    return whole.withColumn("reach", F.floor(F.col("block_start") / REACH)).select(*PLACE, "body").filter("length(body) > 0")


def _transfers(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [grammar.transfer(b.as_buffer().to_pybytes()).tolist() for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in PLACE], pa.array(maps, pa.list_(pa.int32()))], [*PLACE, "map"])
    return run


def _composed(maps: str) -> Column:
    """One map of an array of them, the first one first."""
    same = F.array(*[F.lit(s) for s in range(STATES)])
    return F.aggregate(maps, same, lambda done, m: F.transform(done, lambda s: F.get(m["map"], s)))


def _before(maps: str, entry: str) -> Column:
    """The state before each map of an array, from the state before the first."""
    start = F.struct(F.array().cast("array<int>").alias("before"), F.col(entry).alias("now"))
    return F.aggregate(maps, start, lambda a, m: F.struct(F.concat(a["before"], F.array(a["now"])).alias("before"), F.get(m["map"], a["now"]).alias("now")), lambda a: a["before"])


def block_states(maps: DataFrame) -> DataFrame:
    """``maps`` (PLACE, map) with ``entry`` and ``exit``, the states before and after each block, by a scan over four levels: blocks
    of a split, splits of a stretch of a file, stretches of a file, files of a submission.  No level holds more than its members' maps."""
    levels = [maps]
    for depth in range(len(PLACE) - 1, 0, -1):
        member = F.struct(F.col(PLACE[depth]).alias("key"), "map")
        up = levels[-1].groupBy(*PLACE[:depth]).agg(F.array_sort(F.collect_list(member)).alias("maps"))
        levels.append(up.withColumn("map", _composed("maps")))
    states = levels.pop().select("submission_id", "maps", F.lit(HEAD).alias("entry"))
    for depth in range(1, len(PLACE)):
        flat = F.explode(F.arrays_zip(F.col("maps").alias("m"), _before("maps", "entry").alias("e"))).alias("x")
        entries = states.select(*PLACE[:depth], flat).select(*PLACE[:depth], F.col("x.m.key").alias(PLACE[depth]), F.col("x.e").alias("entry"), F.col("x.m.map").alias("map"))
        if depth == len(PLACE) - 1:
            return entries.withColumn("exit", F.get("map", F.col("entry")))
        states = entries.drop("map").join(levels.pop().drop("map"), list(PLACE[: depth + 1]))


def _cut_fields(grammar: Grammar):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def segments(batch: pa.RecordBatch) -> Iterator[tuple]:
        heads = [batch.column(c).to_pylist() for c in (*PLACE, "entry")]
        for *place, entry, body in zip(*heads, batch.column("body"), strict=True):
            found = grammar.records(body.as_buffer().to_pybytes(), grammar.header if entry == HEAD else 0)
            for k, (subject, marker, values, odd) in enumerate(found):
                yield (*place, subject, k, grammar.tags[marker], values, odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = segments(batch)
            while some := list(islice(rows, SEGMENTS)):  # the fields of a whole batch, as Python's texts, are many times its size
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [*PLACE, "subject", "part", "tag", "values", "unknown"])
    return run


def read_stream(spark: SparkSession, path: str, fmt: Format) -> Stream:
    """Records and faults of the tag-length-value files below a path.

    records: (PLACE, subject, part, tag, values, unknown), ordered by PLACE and part within a submission; a subject is known by PLACE and
    its number.  ``unknown`` lists codes that the segment does not have.  faults: (submission_id, reason)."""
    grammar = Grammar(fmt)
    blocks = cut(read_blocks(spark, path, grammar.end.decode()), "blocks", GROUP_BYTES)
    # states are numbers, so from here on bytes move only for blocks that a subject crosses
    states = cut(block_states(cut(blocks.mapInArrow(_transfers(grammar), "submission_id string, file string, reach long, block_start long, n int, map array<int>"), "maps")).drop("map"), "states")
    ends = states.groupBy("submission_id").agg(F.max_by("exit", F.struct(*PLACE[1:])).alias("last"))
    faults = cut(ends.filter(F.col("last") != DONE).select("submission_id", F.when(F.col("last") == BAD, F.lit("a field or marker cannot be read")).otherwise(F.lit("the trailer is missing")).alias("reason")), "faults")

    def sound(df: DataFrame) -> DataFrame:
        return by_submission(df, faults.select("submission_id"), small_enough(faults), PLACE[1:], "left_anti")

    # blocks that begin or end elsewhere than between subjects: one at each end of a submission, and where a value holds the marker
    marks = cut(states.filter((F.col("entry") != FRESH) | (F.col("exit") != FRESH)), "marks")
    few_marks = small_enough(marks)
    alone = F.coalesce("entry", F.lit(FRESH)).isin(FRESH, HEAD) & F.coalesce("exit", F.lit(FRESH)).isin(FRESH, DONE)
    easy = blocks.join(F.broadcast(marks) if few_marks else marks, list(PLACE), "left").filter(alone).select(*PLACE, F.coalesce("entry", F.lit(FRESH)).alias("entry"), "body")
    opens = F.when(F.col("entry").isin(FRESH, HEAD), F.struct(*PLACE[1:]))
    order = Window.partitionBy("submission_id").orderBy(*PLACE[1:])
    homes = marks.filter(~alone).withColumn("home", F.last(opens, ignorenulls=True).over(order))
    crossed = blocks.join(F.broadcast(homes) if few_marks else homes, list(PLACE)).groupBy("submission_id", "home").agg(
        F.min_by("entry", F.struct(*PLACE[1:])).alias("entry"), F.array_sort(F.collect_list(F.struct(*PLACE[1:], "body"))).alias("b"))  # blocks of one crossing
    joined = F.aggregate("b", F.lit(b""), lambda a, x: F.concat(a, x["body"]))
    crossed = crossed.select("submission_id", *[F.col(f"home.{c}").alias(c) for c in PLACE[1:]], "entry", joined.alias("body"))
    sound = by_submission(easy.unionByName(crossed), faults.select("submission_id"), small_enough(faults), PLACE[1:], "left_anti")
    return Stream(sound.mapInArrow(_cut_fields(grammar), _RECORDS), faults)


def stream_issues(faults: DataFrame, fmt: Format) -> DataFrame:
    """One finding, which no one may let through, for each stream that could not be followed to its trailer."""
    text = F.concat(F.lit("The file cannot be followed to its end ("), F.col("reason"), F.lit("); none of it was taken over."))
    return whole_file_issues(faults.withColumns({"sheet": F.lit(None).cast("string"), "row_no": F.lit(None).cast("long")}), fmt, text)

