"""Hard negatives: for each anchor its nearest rows of the same label, and for each of these the nearest rows of other labels within
a window of scores.

Rows become tiles: up to `TILE` vectors of integers as one matrix. Tiles of anchors meet every tile of candidates in a join by
candidate groups; each meeting is one Strassen product of exact integers. A task keeps heaps of the best rows of each anchor and
writes them when it has seen enough; heaps merge by a ranking of their rows. There are two passes, since the windows depend on the
positives: heaps of positives first, then heaps of each positive's window. No task holds more than two tiles and its heaps,
nothing passes through the driver, and labels or vectors that many rows share do not matter, as rows are dealt out in tiles.

Scores are inner products of components times `scale`, rounded down. Higher scores come first, ties by the smaller id, a null id
last, then by the order in which rows were read. Rows with a null label or vector, with a null or non-finite component, or with a
component of 2**26 or more after scaling (products would leave 64 bits) take no part. Shorter vectors count as filled up with zeros,
so an empty one scores 0. Repeated rows are rows of their own, and positives and negatives of each other where labels say so. An
empty table, or one without anchors, gives an empty result. Only the three columns named are read, whatever else the table has."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .strassen import product

#: Rows of a tile at most.
TILE = 1024
#: Bytes of candidate tiles of a group; anchors are sent to each group once.
GROUP_BYTES = 64 << 20
#: Rows that a task's heaps hold before they are written.
HELD_ROWS = 1 << 17
LARGEST = 1 << 26
NONE = np.iinfo(np.int64).min

TILES = "tile long, grp int, rows array<long>, ids array<long>, labels array<long>, width int, body binary"


def _tiles(spread: int):
    """Rows (row, id, label, values) as tiles, ids ascending (null last), so that the first of equal scores is the right one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = pa.Table.from_batches([batch.slice(at, TILE)]).sort_by([("id", "ascending"), ("row", "ascending")])
                values = part.column("values").combine_chunks()
                sizes = values.value_lengths().to_numpy()
                width = int(sizes.max())
                body = np.zeros((part.num_rows, width), np.int64)
                body[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.flatten().to_numpy()
                raw = body.tobytes()
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "id", "label")]
                yield pa.record_batch([pa.array([part.column("row")[0].as_py()], pa.int64()), pa.array([zlib.crc32(raw) % spread], pa.int32()), *lists, pa.array([width], pa.int32()), pa.array([raw], pa.binary())],
                                      ["tile", "grp", "rows", "ids", "labels", "width", "body"])
    return run


def _matrix(body: pa.Scalar, width: int, count: int) -> np.ndarray:
    return np.frombuffer(body.as_buffer(), np.int64).reshape(count, width) if width else np.zeros((count, 0), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, the narrower one filled up with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    return product(a, np.ascontiguousarray(b.T))


def best_of(table: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first `count` entries of each row by value, ties by column; entries that are NONE don't count. Eats the table."""
    rows, columns = [], []
    alive = np.arange(len(table))
    for _ in range(min(count, table.shape[1])):
        at = np.argmax(table, axis=1)
        some = table[np.arange(len(table)), at] > NONE
        if not some.all():
            table, alive, at = table[some], alive[some], at[some]
        if not len(alive):
            break
        rows.append(alive)
        columns.append(at)
        table[np.arange(len(table)), at] = NONE
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Heaps:
    """The best rows found so far of each key, as arrays that are cut back to the best `count` when they grow."""

    def __init__(self, count: int):
        self.count, self.parts, self.size, self.floor = count, [], 0, HELD_ROWS

    def add(self, key: np.ndarray, score: np.ndarray, row: np.ndarray, identity: np.ndarray, none: np.ndarray) -> None:
        self.parts.append((key, score, row, identity, none))
        self.size += len(key)

    def best(self) -> tuple[np.ndarray, ...]:
        """Key, score, row, id and whether the id is null, of the best rows."""
        key, score, row, identity, none = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        by = np.lexsort([row, identity, none, -score, key])
        key = key[by]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        by = by[np.arange(len(key)) - start < self.count]
        return tuple(c[by] for c in (np.concatenate([p[k] for p in self.parts]) for k in range(5)))

    def full(self) -> bool:
        """Cuts the heaps back when they have grown; true if even so they should be written."""
        if self.size >= 2 * self.floor:
            self.parts = [self.best()]
            self.size = len(self.parts[0][0])
        return self.size > self.floor

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            key, score, row, identity, none = self.best()
            yield pa.record_batch([pa.array(key), pa.array(score), pa.array(row), pa.array(identity, mask=none)], ["key", "score", "row", "id"])
        self.parts, self.size = [], 0


def _meet(same: bool, count: int, low: int, high: int):
    """Heaps of meetings of an anchor tile (a_...) and a candidate tile. same: of rows of the anchor's label, by anchor; else of rows of
    other labels in the windows of the anchor's positives (a_keys, a_at: position in the tile, a_scores), by positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(count)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                got = {c: columns[c][k] for c in columns}
                a_rows, rows, a_labels, labels = (np.array(got[c].values, np.int64) for c in ("a_rows", "rows", "a_labels", "labels"))
                ids, none = got["ids"].values.fill_null(0).to_numpy(), got["ids"].values.is_null().to_numpy(zero_copy_only=False)
                table = scores(_matrix(got["a_body"], got["a_width"].as_py(), len(a_rows)), _matrix(got["body"], got["width"].as_py(), len(rows)))
                alike = a_labels[:, None] == labels
                if same:
                    table[~alike | (a_rows[:, None] == rows)] = NONE
                    value = table.copy()
                    i, j = best_of(table, count)
                    heaps.add(a_rows[i], value[i, j], rows[j], ids[j], none[j])
                else:
                    keys, at, wanted = (np.array(got[c].values, np.int64) for c in ("a_keys", "a_at", "a_scores"))
                    table[alike] = NONE
                    for begin in range(0, len(keys), TILE):
                        p = slice(begin, begin + TILE)
                        value = table[at[p]]
                        inside = (value > NONE) & (100 * value >= low * wanted[p, None]) & (100 * value <= high * wanted[p, None])
                        i, j = best_of(np.where(inside, value, NONE), count)
                        heaps.add(keys[p][i], value[i, j], rows[j], ids[j], none[j])
                if heaps.full():
                    yield from heaps.take()
        yield from heaps.take()
    return run


HEAP = "key long, score long, row long, id long"


def _ranked(heaps: DataFrame, count: int) -> DataFrame:
    """Merged heaps: the best rows of each key with their rank."""
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `is_anchor` (of `id`) holds and each
    of its positives, the first negatives with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "negatives")
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.lit(scale) * x.cast("double")) < LARGEST), F.lit(False)))
    read = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(fit)
    read = read.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("values"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.cut(read, "rows")
    total = rows.agg(F.sum(8 * F.size("values") + 24)).first()[0] or 0
    groups = max(spread, -(-total // GROUP_BYTES))
    tiles = scratch.cut(rows.mapInArrow(_tiles(groups), TILES), "tiles")
    anchors = rows.where(is_anchor).coalesce(max(1, spread // 4)).mapInArrow(_tiles(groups), TILES)
    anchors = scratch.cut(anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("tile", "rows", "ids", "labels", "width", "body")]), "anchors")

    def meetings(sides: DataFrame) -> DataFrame:
        """Every tile of anchors with every tile of candidates, which stay in their groups."""
        sent = sides.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return tiles.join(sent.hint("merge"), "grp").drop("grp", "tile", "a_tile", "a_ids")

    near = _ranked(meetings(anchors).mapInArrow(_meet(True, positives, low, high), HEAP), positives)
    near = scratch.cut(near.select(F.col("key").alias("anchor"), F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "near")
    place = anchors.select("a_tile", F.posexplode("a_rows").alias("at", "anchor"))
    own = anchors.select(F.explode(F.arrays_zip("a_rows", "a_ids")).alias("x")).select(F.col("x.a_rows").alias("anchor"), F.col("x.a_ids").alias("anchor_id"))
    # a positive's key is made of its anchor's row and its rank; rows are below 2 ** 60
    key = (F.col("anchor") * positives + F.col("rank") - 1).alias("key")
    asked = near.join(place, "anchor").groupBy("a_tile").agg(F.sort_array(F.collect_list(F.struct(key, "at", "positive_score"))).alias("asked"))  # at most TILE * positives
    asked = asked.select("a_tile", F.col("asked.key").alias("a_keys"), F.col("asked.at").alias("a_at"), F.col("asked.positive_score").alias("a_scores"))
    found = _ranked(meetings(anchors.join(asked, "a_tile")).mapInArrow(_meet(False, negatives, low, high), HEAP), negatives)
    found = found.select("key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = found.join(near.select(key, "anchor", "positive_id", "positive_score"), "key").join(own, "anchor")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
