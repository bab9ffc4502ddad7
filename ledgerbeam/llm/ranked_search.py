"""Ranked lexical search: the best texts for each item of a query set, by MaxScore over pairs of terms.

Texts become shards: lists of (text, occurrences) for each term of the items. With the corpus counts known, a second table, the index,
holds for each shard the impact of every entry, each term's largest impact, and for pairs of terms that items ask for together the
largest joint impact of a text that holds both. A pair's bound is the largest of its joint and its two single impacts, which is less
than the sum of the single ones wherever the two never peak in one text. A query orders its pairs by bound. Pairs whose bounds add up
to less than the score of its last rank so far can't bring in a text by themselves: texts come from the other pairs' lists only, and
are left as soon as what they have and the bounds of the pairs to come fall below that score. Some of the shards are searched first,
and their scores are where all other tasks begin. Tasks keep one heap per item; heaps merge by a ranking.

Items go to the tasks in blocks of `BLOCK_BYTES` (an item beyond that is a block of its own), one pass over the texts for each block, so the
query set may have any size. A term is a run of letters A-Z, digits and characters beyond ASCII, only A-Z lower-cased.

Null and empty texts and items have no terms and are in no result. A text of any length is one entry of its lists. Repeated rows, of texts
or of items, each count and each get a rank. Equal scores are ranked by id, a null id last. Empty tables give an empty result. Ids are long.
Only the columns named are read, whatever else the tables have. Terms are told apart by 64-bit digests: equal length up to eight bytes
never collide, others only by chance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch
from .symbols import LOWER, NOT_ALNUM, slices, span_digests, text_bytes, word_bounds

#: Bytes of item texts in one block, but for a longer item alone.
BLOCK_BYTES = 4 << 20
#: A shard is closed when it has so many texts or so many words of the items.
SHARD_TEXTS = 1 << 12
SHARD_WORDS = 1 << 20
#: One in so many shards is searched first.
FIRST = 16
BETWEEN = NOT_ALNUM[LOWER]

LISTS = "texts long, words long, ids array<long>, ns binary, terms array<int>, sizes array<int>, docs binary, tfs binary"
INDEX = "shard int, ids array<long>, terms array<int>, sizes array<int>, most array<long>, docs binary, impacts binary, pairs array<int>, joint array<long>"
FOUND = "item int, id long, score long"


class Queries:
    """The items of a block: each item's terms as numbers of the block's vocabulary, which is ordered by digest."""

    def __init__(self, texts: list[str | None]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        starts, ends, rows = word_bounds(data, offsets, BETWEEN)
        self.words, codes = np.unique(span_digests(data, starts, ends, LOWER), return_inverse=True)
        self.terms = [np.unique(codes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]

    def number(self, digests: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those of no item."""
        if not len(self.words):
            return np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.words, digests), len(self.words) - 1)
        return np.where(self.words[at] == digests, at, -1)

    def weigh(self, counts: dict[int, int], texts: int, words: int) -> None:
        """Takes in the counts of the corpus: the weight of each term, and the pairs: an item's terms side by side in order of weight."""
        df = [counts.get(t, 0) for t in range(len(self.words))]
        self.texts, self.total = texts, words
        self.weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * n + 1))) for n in df], np.int64)
        numbers: dict[tuple[int, int], int] = {}
        self.units: list[tuple[np.ndarray, np.ndarray]] = []  # of each item: its terms two by two (-1 if alone), and the numbers of the pairs
        for terms in self.terms:
            terms = terms[np.argsort(self.weights[terms], kind="stable")]
            two = np.append(terms, [-1] * (len(terms) % 2)).astype(np.int64).reshape(-1, 2)
            self.units.append((two, np.array([numbers.setdefault((a, b), len(numbers)) if b >= 0 else -1 for a, b in two.tolist()], np.int64)))
        self.pairs = np.array(list(numbers), np.int64).reshape(-1, 2)


def _lists(shipped, text: str):
    """Shards of the texts: lists of the terms of the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shipped.value
        ids, ns, keys, texts, words, held = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            code, doc = (np.concatenate([k[c] for k in keys]) if keys else np.zeros(0, np.int64) for c in (0, 1))
            some, doc = np.unique(doc, return_inverse=True)
            entry, tf = np.unique(code * max(1, len(some)) + doc, return_counts=True)
            terms, sizes = np.unique(entry // max(1, len(some)), return_counts=True)
            identity = pa.concat_arrays(ids).take(pa.array(some)) if ids else pa.array([], pa.int64())
            n = np.concatenate(ns)[some] if ns else np.zeros(0, np.int64)
            return pa.record_batch([pa.array([texts]), pa.array([words]), pa.ListArray.from_arrays(pa.array([0, len(identity)], pa.int32()), identity), pa.array([n.astype(np.int64).tobytes()]),
                                    pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32())),
                                    pa.array([(entry % max(1, len(some))).astype(np.int32).tobytes()]), pa.array([tf.astype(np.int32).tobytes()])],
                                   ["texts", "words", "ids", "ns", "terms", "sizes", "docs", "tfs"])

        seen = 0
        for batch, data, offsets in slices(batches, text):
            starts, ends, rows = word_bounds(data, offsets, BETWEEN)
            code = queries.number(span_digests(data, starts, ends, LOWER))
            n = np.diff(rows)
            known = np.flatnonzero(code >= 0)
            keys.append((code[known], np.searchsorted(rows, known, "right") - 1 + seen))
            ids.append(batch.column("id"))
            ns.append(n)
            texts, words, seen, held = texts + int((n > 0).sum()), words + int(n.sum()), seen + batch.num_rows, held + len(known)
            if seen >= SHARD_TEXTS or held >= SHARD_WORDS:
                yield close()
                ids, ns, keys, texts, words, held, seen = [], [], [], 0, 0, 0, 0
        if seen:
            yield close()
    return run


def _numbers(scalar: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    """The values of a list or of raw bytes."""
    return np.frombuffer(scalar.as_buffer(), kind) if isinstance(scalar, pa.BinaryScalar) else scalar.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _index(shipped):
    """Impacts, each term's largest, and the joint ones of the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shipped.value
        for batch in batches:
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                terms, sizes, n = (_numbers(got[c]) for c in ("terms", "sizes", "ns"))
                if not len(terms):
                    continue
                docs, tf = _numbers(got["docs"], np.int32), _numbers(got["tfs"], np.int32).astype(np.int64)
                length = 50 + 50 * n * queries.texts // queries.total
                impacts = np.repeat(queries.weights[terms], sizes) * (1_000_000_000 * tf // (1000 * tf + 20 * length[docs]))
                bounds = np.append(0, np.cumsum(sizes))
                most = np.maximum.reduceat(impacts, bounds[:-1])
                where = np.full(len(queries.words), -1)
                where[terms] = np.arange(len(terms))
                both = np.flatnonzero((where[queries.pairs] >= 0).all(axis=1))
                row, joint, before = np.zeros(len(n), np.int64), np.zeros(len(both), np.int64), -1
                for p in np.argsort(where[queries.pairs[both, 0]], kind="stable").tolist():  # pairs of one first term after another
                    a, b = where[queries.pairs[both[p]]]
                    if a != before:
                        if before >= 0:
                            row[docs[bounds[before] : bounds[before + 1]]] = 0
                        row[docs[bounds[a] : bounds[a + 1]]] = impacts[bounds[a] : bounds[a + 1]]
                        before = a
                    first = row[docs[bounds[b] : bounds[b + 1]]]
                    joint[p] = np.max(first + impacts[bounds[b] : bounds[b + 1]], where=first > 0, initial=0)
                yield pa.record_batch([*[pa.array([got[c].as_py()], batch.schema.field(c).type) for c in ("shard", "ids", "terms", "sizes")],
                                       pa.array([most.tolist()], pa.list_(pa.int64())), pa.array([docs.tobytes()]), pa.array([impacts.tobytes()]),
                                       pa.array([both.tolist()], pa.list_(pa.int32())), pa.array([joint.tolist()], pa.list_(pa.int64()))],
                                      ["shard", "ids", "terms", "sizes", "most", "docs", "impacts", "pairs", "joint"])
    return run


class Shard:
    """One shard of the index, ready for queries."""

    def __init__(self, got: dict[str, pa.Scalar], queries: Queries):
        terms, sizes = _numbers(got["terms"]), _numbers(got["sizes"])
        self.docs, self.impacts, self.bounds = _numbers(got["docs"], np.int32), _numbers(got["impacts"]), np.append(0, np.cumsum(sizes))
        self.where = np.full(len(queries.words) + 1, -1)  # the last one stands for the missing half of a pair
        self.where[terms] = np.arange(len(terms))
        self.most = np.append(_numbers(got["most"]), 0)
        self.joint = np.zeros(len(queries.pairs) + 1, np.int64)
        self.joint[_numbers(got["pairs"])] = _numbers(got["joint"])
        self.score = np.zeros(len(got["ids"].values), np.int64)

    def entries(self, term: int) -> slice:
        return slice(self.bounds[term], self.bounds[term + 1])

    def search(self, two: np.ndarray, pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Texts with a score of `least` or more and their scores, for the pairs of an item; and how many texts were looked at."""
        places = self.where[two]
        some = (places >= 0).any(axis=1)
        places, pair = places[some], pair[some]
        bound = np.maximum(self.most[places].max(axis=1), self.joint[pair])
        order = np.argsort(bound, kind="stable")
        places, reach = places[order], np.cumsum(bound[order])  # reach[k]: the most that pairs 0..k can give together
        skipped = int(np.searchsorted(reach, least, "left"))  # they stay below it by themselves
        if skipped == len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        score = self.score
        for term in places[skipped:].ravel().tolist():
            if term >= 0:
                at = self.entries(term)
                score[self.docs[at]] += self.impacts[at]
        texts = np.flatnonzero(score)
        sums, looked = score[texts], len(texts)
        score[texts] = 0
        for k in range(skipped - 1, -1, -1):
            stay = sums + reach[k] >= least
            texts, sums = texts[stay], sums[stay]
            if not len(texts):
                break
            for term in places[k].tolist():
                if term >= 0:
                    at = self.entries(term)
                    docs = self.docs[at]
                    found = np.minimum(np.searchsorted(docs, texts), len(docs) - 1)
                    sums = sums + np.where(docs[found] == texts, self.impacts[at][found], 0)
        stay = sums >= least
        return texts[stay], sums[stay], looked


def _search(shipped, floors, count: int):
    """The heap of each item over a task's shards; floors: a score that the last rank has at least, by item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shipped.value
        heaps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        least = np.maximum(np.array(floors.value, np.int64), 1)
        for batch in batches:
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                shard = Shard(got, queries)
                ids = got["ids"].values
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                for item, (two, pair) in enumerate(queries.units):
                    texts, sums, _ = shard.search(two, pair, int(least[item]))
                    if len(texts):
                        new = (sums, none[texts], ids[texts])
                        sums, absent, identity = (np.concatenate(c) for c in zip(heaps[item], new, strict=True)) if item in heaps else new
                        best = np.lexsort([identity, absent, -sums])[:count]
                        heaps[item] = sums[best], absent[best], identity[best]
                        if len(best) == count:
                            least[item] = max(least[item], sums[best[-1]])
        for item, (sums, absent, identity) in heaps.items():
            yield pa.record_batch([pa.array(np.full(len(sums), item), pa.int32()), pa.array(identity, pa.int64(), mask=absent), pa.array(sums)], ["item", "id", "score"])
    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of (item, text) in blocks; the driver holds one block and one partition of the items at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        own = len((row[1] or "").encode())
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(row)
        size += own
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, count: int = 50, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the first `count` texts with a score above 0 for each item."""
    spark = docs.sparkSession
    scratch, context = scratch or Scratch(spark, "search"), spark.sparkContext
    read = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("body"))
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_id, kind)])
    parts = [spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, {id_column} long, score long")]
    for number, block in enumerate(_blocks(items.select(item_id, item_text))):
        queries = Queries([row[1] for row in block])
        shipped = context.broadcast(queries)
        lists = scratch.cut(read.mapInArrow(_lists(shipped, "body"), LISTS), f"lists-{number}")
        texts, words = lists.agg(F.sum("texts"), F.sum("words")).first()
        shipped.unpersist()
        if not words:
            continue
        counted = lists.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
        queries.weigh({r[0]: r[1] for r in counted.collect()}, texts, words)  # terms of the block only
        shipped = context.broadcast(queries)
        shards = lists.withColumn("shard", F.pmod(F.xxhash64("ids", "docs"), F.lit(FIRST)).cast("int"))
        index = scratch.cut(shards.mapInArrow(_index(shipped), INDEX), f"index-{number}")
        scratch.drop(f"lists-{number}")

        def ranked(found: DataFrame) -> DataFrame:
            order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)

        zero = context.broadcast([0] * len(block))
        first = scratch.cut(ranked(index.where("shard = 0").mapInArrow(_search(shipped, zero, count), FOUND)), f"first-{number}")
        floors = [0] * len(block)
        for row in first.where(F.col("rank") == count).select("item", "score").collect():  # one row an item of the block
            floors[row.item] = row.score
        rest = index.where("shard <> 0").mapInArrow(_search(shipped, context.broadcast(floors), count), FOUND)
        names = spark.createDataFrame([(k, row[0]) for k, row in enumerate(block)], schema)
        done = ranked(first.drop("rank").union(rest)).join(F.broadcast(names), "item")
        parts.append(done.select(item_id, "rank", F.col("id").alias(id_column), "score"))
    done = parts[0]
    for part in parts[1:]:
        done = done.union(part)
    return done
