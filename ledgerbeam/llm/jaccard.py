"""N-gram Jaccard join: links texts whose sets of word shingles overlap by a share, and gives each its class of linked texts.

Equal sets count once. Sets that may link meet by equal pairs of least digests of their shingles, under `MEETINGS` pairs of
orders: two sets that link at 0.8 miss all of them with a probability under 0.36 ** 30 (5e-14). Sets joined by meetings are brought
together once, in one unit; where that would be too large, each meeting is a unit, and one with very many tokens is dealt as
pairs of blocks over tasks, so that none is held whole and none is cut short. In a unit a signature tree is built over the sets:
each node holds the OR (and the AND) of its sets' token bitmaps and the range of their sizes. Two trees, or a tree and itself, are
gone down together; a pair of nodes is left when its largest possible overlap is too small for any of its sets, or when all its
sets are in one class already. What remains is decided on the exact sets. Classes of all units join in connected components.

A null text, or one without words, has an empty set and links with nothing. A text with fewer words than a shingle is one shingle.
Repeated rows and ids are in one class; a null id is never the smallest of a class with others. Columns named like outputs go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import KEY
from .shared import Scratch, components
from .symbols import LOWER, WHITE, gram_digests, mix, run_digests, slices, span_digests, word_bounds

MEETINGS = 30
#: Least digests that must be equal in a meeting.
TOGETHER = 2
#: Tokens of a block of sets that one task holds, twice at most.
BLOCK_TOKENS = 1 << 19
BITMAP_WORDS = 32
FAN = 8
#: Node pairs that are looked at together.
STEP_PAIRS = 1 << 13
_ODD = np.random.default_rng(7).integers(1, 1 << 63, (2, MEETINGS * TOGETHER), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct shingles of each row, ascending within a row, and the bounds of the rows."""
    starts, ends, rows = word_bounds(data, offsets, WHITE)
    words = span_digests(data, starts, ends, LOWER)
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    grams = gram_digests(words, size)
    inside = row[: len(grams)] == row[size - 1 :][: len(grams)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    tokens = np.concatenate([grams[inside], run_digests(words, rows[short], rows[short + 1])])
    owner = np.concatenate([row[: len(grams)][inside], short])
    by = np.lexsort([tokens, owner])
    tokens, owner = tokens[by], owner[by]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(counts))))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "body"):
            tokens, rows = shingle_sets(data, offsets, size)
            counts = np.diff(rows)
            some = np.flatnonzero(counts)
            least = np.zeros((batch.num_rows, MEETINGS), np.uint64)
            ids = np.zeros(batch.num_rows, np.uint64)
            if len(some):
                for k in range(MEETINGS * TOGETHER):
                    v = tokens * _ODD[0, k]
                    first = np.minimum.reduceat((v ^ v >> np.uint64(32)) * _ODD[1, k], rows[some])
                    least[some, k // TOGETHER] = mix(least[some, k // TOGETHER] + np.uint64(k)) ^ first
                ids[some] = mix(np.add.reduceat(mix(tokens), rows[some]) ^ counts[some].astype(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * MEETINGS, pa.int32()), pa.array(least.ravel().view(np.int64)))
            yield pa.record_batch([*[batch.column(c) for c in (*KEY, "id")], pa.array(counts, pa.int64()), pa.array(ids.view(np.int64)), lists], [*KEY, "id", "n", "sid", "least"])
    return run


def _bring(size: int):
    """The sets wanted, once for each pair of blocks of a meeting that they take part in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "body", 1 << 17):
            tokens, rows = shingle_sets(data, offsets, size)
            raw, sids = tokens.view(np.int64).tobytes(), batch.column("sid").to_pylist()
            out: list[tuple] = []
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                body = raw[8 * rows[k] : 8 * rows[k + 1]]
                for w in wanted:
                    own = int(np.uint64(sids[k] & (1 << 64) - 1) % np.uint64(w["blocks"]))
                    out += [(w["meeting"], min(own, j), max(own, j), own, sids[k], body) for j in range(w["blocks"])]
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["meeting", "i", "j", "own", "sid", "body"])


class SignatureTree:
    """Levels of nodes over sets ordered by size; level 0 are the sets, each node above holds FAN of the level below."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        bit = (flat >> np.uint64(7)).astype(np.int64) % (64 * BITMAP_WORDS)
        dense = np.zeros((n, 64 * BITMAP_WORDS), bool)
        dense[owner, bit] = True
        some = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
        sizes = np.array([len(s) for s in sets])
        self.levels = [(some, some, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high = self.levels[-1]
            at = np.arange(0, len(some), FAN)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any set below node i may link with any below node j: by sizes, and by tokens that the other side cannot hold."""
    some_a, every_a, low_a, high_a = (x[i] for x in a)
    some_b, every_b, low_b, high_b = (x[j] for x in b)
    most_a = high_a - np.bitwise_count(every_a & ~some_b).sum(axis=1, dtype=np.int64)
    most_b = high_b - np.bitwise_count(every_b & ~some_a).sum(axis=1, dtype=np.int64)
    return np.minimum(most_a, most_b) * (100 + percent) >= percent * (low_a + low_b)


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of the sets, of `left` (and itself if right is None) with `right`, numbered left first."""
    every = left + (right or [])
    root = list(range(len(every)))
    shift = len(left) if right is not None else 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = SignatureTree(left)
    b = a if right is None else SignatureTree(right)
    top = max(len(a.levels), len(b.levels)) - 1
    joined: list[tuple[int, int]] = []
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > STEP_PAIRS:
            stack += [(level, i[k : k + STEP_PAIRS], j[k : k + STEP_PAIRS]) for k in range(0, len(i), STEP_PAIRS)]
            continue
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        keep = may_link(a.levels[la], b.levels[lb], i, j, percent)
        if joined and level <= 2:
            # nodes whose sets are all in one class hold no new link
            label = np.array([find(x) for x in range(len(every))])
            one = [np.stack([f.reduceat(part, np.arange(0, len(part), FAN**lv)) for f in (np.minimum, np.maximum)]) for part, lv in ((label[: len(left)], la), (label[shift:], lb))]
            keep &= ~((one[0][0][i] == one[0][1][i]) & (one[1][0][j] == one[1][1][j]) & (one[0][0][i] == one[1][0][j]))
        i, j = i[keep], j[keep]
        if level:
            ka = np.arange(FAN) if level == la else np.zeros(1, np.int64)
            kb = np.arange(FAN) if level == lb else np.zeros(1, np.int64)
            i, j = (x.ravel() for x in np.broadcast_arrays((i[:, None] * (FAN if level == la else 1) + ka)[:, :, None], (j[:, None] * (FAN if level == lb else 1) + kb)[:, None, :]))
            good = (i < len(a.levels[min(level - 1, len(a.levels) - 1)][0])) & (j < len(b.levels[min(level - 1, len(b.levels) - 1)][0]))
            if right is None:
                good &= i <= j
            stack.append((level - 1, i[good], j[good]))
            continue
        for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
            if x != y and find(x) != find(y):
                both = len(every[x]) + len(every[y])
                common = len(np.intersect1d(every[x], every[y], assume_unique=True))
                if 100 * common >= percent * (both - common):
                    root[find(x)] = find(y)
                    joined.append((x, y))
    return joined


def _join(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, links = None, {}, []

        def close() -> None:
            sides = [sorted(part.items(), key=lambda s: (len(s[1]), s[0])) for part in sets.values()]
            if sum(map(len, sides)) > 1 and (at[1] == at[2] or len(sides) == 2):
                names = [s[0] for side in sides for s in side]
                links.extend((names[x], names[y]) for x, y in links_within([s[1] for s in sides[0]], [s[1] for s in sides[1]] if len(sides) == 2 else None, percent))

        for batch in batches:
            for meeting, i, j, own, sid, body in zip(*[batch.column(c).to_pylist() for c in ("meeting", "i", "j", "own", "sid")], batch.column("body"), strict=True):
                if at != (meeting, i, j):
                    if at:
                        close()
                    at, sets = (meeting, i, j), {}
                sets.setdefault(own, {})[sid] = np.frombuffer(body.as_buffer(), np.uint64).copy()
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
                links = []
        if at:
            close()
        if links:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
    return run


def _classes(docs: DataFrame, id_column: str, text: str, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two digests of all columns with the `row`, and (pid, pid2, id, n, class) of each row; class is null for empty sets."""
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.xxhash64(*docs.columns).alias("pid"), F.hash(*docs.columns).alias("pid2"), F.struct(*docs.columns).alias("row"))
    texts = keyed.select(*KEY, F.col("row").getField(id_column).alias("id"), F.col("row").getField(text).alias("body"))
    kind = docs.schema[id_column].dataType.simpleString()
    sketch = scratch.cut(texts.mapInArrow(_sketch(size), f"pid long, pid2 int, id {kind}, n long, sid long, least array<long>"), "sketch")
    sets = sketch.where("n > 0").groupBy("sid").agg(F.max("n").alias("n"), F.min(F.struct(*KEY)).alias("one"), F.max("least").alias("least"))
    keys = sets.select("sid", F.posexplode("least").alias("k", "v")).select("sid", F.xxhash64("k", "v").alias("meeting"))
    shared = keys.groupBy("meeting").agg(F.count("*").alias("members"), F.min("sid").alias("first")).where("members > 1")
    met = scratch.cut(keys.join(shared, "meeting"), "met")
    near = scratch.cut(components(met.select(F.col("sid").alias("a"), F.col("first").alias("b")), scratch), "near")
    sizes = scratch.cut(near.join(sets.select("sid", "n", "one"), F.col("node") == F.col("sid")).select("sid", "n", "one", F.col("component").alias("unit")), "sizes")
    units = sizes.groupBy("unit").agg(F.sum("n").alias("tokens"))
    fits = sizes.join(units.where(F.col("tokens") <= BLOCK_TOKENS).select("unit"), "unit").select("sid", "unit", F.lit(1).alias("blocks"))
    over = sizes.join(units.where(F.col("tokens") > BLOCK_TOKENS).select("unit"), "unit").select("sid", "n")
    over = met.select("sid", "meeting", "members", "first").join(over, "sid")
    same = over.groupBy("meeting").agg(F.first("members").alias("members"), F.bit_xor(F.xxhash64("sid")).alias("like"), F.first("first").alias("first"), F.sum("n").alias("tokens"))
    same = same.groupBy("members", "like", "first").agg(F.min("meeting").alias("meeting"), F.max("tokens").alias("tokens"))  # meetings of the same sets are one
    over = over.join(same.select("meeting", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks")), "meeting").select("sid", F.col("meeting").alias("unit"), "blocks")
    wanted = fits.union(over).groupBy("sid").agg(F.collect_list(F.struct(F.col("unit").alias("meeting"), "blocks")).alias("wanted"))  # a set has MEETINGS at most
    wanted = wanted.join(sizes.select("sid", "one"), "sid").select(F.col("one.pid").alias("pid"), F.col("one.pid2").alias("pid2"), "sid", "wanted")
    brought = wanted.join(texts.select(*KEY, "body"), KEY).select("sid", "wanted", "body")
    brought = brought.mapInArrow(_bring(size), "meeting long, i int, j int, own int, sid long, body binary")
    links = brought.repartition(spread, "meeting", "i", "j").sortWithinPartitions("meeting", "i", "j").mapInArrow(_join(percent), "a long, b long")
    linked = components(links, scratch)
    scratch.drop("met", "near", "sizes")
    rows = sketch.join(linked.withColumnRenamed("node", "sid"), "sid", "left")
    return keyed, rows.select(*KEY, "id", "n", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("class"))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the number of shingles, and the smallest id that links reach."""
    _, rows = _classes(docs, id_column, text, size, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    least = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("component_id"))
    rows = rows.join(least, "class", "left")
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The row of the smallest id of each class (an id before none), and every row with an empty set; of rows equal in all columns one."""
    keyed, rows = _classes(docs, id_column, text, size, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    first = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *KEY)).alias("one"))
    stay = first.select("one.pid", "one.pid2").union(rows.where(F.col("class").isNull()).select(*KEY).distinct())
    return keyed.join(stay, KEY).dropDuplicates(KEY).select("row.*")
