"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words (the tokenizer's pre-tokens) are counted over the whole corpus. The frequent ones, `LEXICON_WORDS` at most, get their ids by
merging and are compiled into a minimal acyclic automaton: equal suffixes share states, and each edge carries how many words come
before it, so that a walk ends in the word's number, which leads to its ids. The automaton is one flat file that every task memory-maps. A
task walks it with all new words of a slice at once; words that it does not hold are merged exactly, pair by pair. Decoding joins
the bytes of ids.

A null or empty text has no ids and decodes to an empty text. The special tokens of the file are cut out first and get their ids.
Words, texts and ids may have any length. Other columns pass through unless they are named like an output."""

from __future__ import annotations

import atexit
import functools
import heapq
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch
from .symbols import slices, span_digests

#: Words of the lexicon at most: all that are as frequent as the rarest that still fit.
LEXICON_WORDS = 200_000
#: Words a task remembers; then it forgets them all.
REMEMBERED = 100_000
#: Longer words are merged one by one.
TOGETHER = 48
NO_MERGE = 1 << 40
#: Which bytes stand for themselves in the pieces of byte-level vocabularies, and the endings cut off after an apostrophe.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
SPACE, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def character_kinds() -> np.ndarray:
    """The kind of each code point; some controls that Python's patterns take for white space are none here."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"(?![\x1c-\x1f])\s")):
        kinds[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return kinds


def cut_words(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the pre-tokens, which cover all bytes, and the number of them before each row.

    A run of letters, of numbers or of other characters is a word, with one blank before it if there is one. Of white space
    before a word the last character is cut off, at the end of a text nothing. Endings such as 's are words if no blank and no
    other mark stands before the apostrophe. A special token stands alone, as if the text ended before and began after it."""
    n = len(data)
    bounds = np.zeros(n + 1, bool)
    bounds[offsets] = True
    whole: list[tuple[int, int]] = []
    for special in specials:
        raw, at = data.tobytes(), -1
        while (at := raw.find(special, at + 1)) >= 0:
            if not bounds[at + 1 : at + len(special)].any():
                whole.append((at, at + len(special)))
    for a, b in whole:
        bounds[[a, b]] = True
    kinds = character_kinds()
    kind = kinds[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        of = kinds[np.minimum(point, 0x10FFFF)]
        kind[lead] = of
        for k in (1, 2, 3):
            more = size > k
            kind[lead[more] + k] = of[more]
    words = bounds.copy()
    words[1:-1] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(words)
    first, stop = first[:-1], first[1:]
    here = kind[first]
    follows = ~bounds[stop]  # another run of the same text comes next
    blank = (here == SPACE) & follows
    last = stop[blank] - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    words[last] = True
    joined = data[last] == 0x20
    words[stop[blank][joined]] = False
    quote = np.flatnonzero((here == OTHER) & (data[first] == 0x27) & (stop - first == 1) & follows & words[first])
    quote = quote[here[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        at, end = first[quote], stop[quote + 1]
        for ending in ENDINGS:
            fits = at + 1 + len(ending) <= end
            for k, byte in enumerate(ending):
                fits &= data[np.minimum(at + 1 + k, n - 1)] == byte
            words[at[fits] + 1] = False
            words[at[fits] + 1 + len(ending)] = True
    for a, b in whole:
        words[a + 1 : b] = False
    cuts = np.flatnonzero(words)
    return cuts, np.searchsorted(cuts, offsets)


class Vocabulary:
    """Pieces and merges of a byte-level BPE file, and exact merging of words."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text("utf-8"))
        letters = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(PRINTABLE))}
        ids = {bytes(letters[c] for c in piece): i for piece, i in file["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        pieces = {i: p for p, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.merges.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.ranks, self.makes = (np.array([self.merges[k][c] for k in self.pairs.tolist()], np.int64) for c in (0, 1))

    def merged(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word: the earliest merge first, the leftmost of equals, until no pair merges. Short words step together."""
        out: list[tuple[int, ...]] = [(self.special[w],) if w in self.special else self._merged_long([self.bytes[b] for b in w]) if len(w) > TOGETHER else () for w in words]
        short = [k for k, w in enumerate(words) if not out[k] and w]
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        ids = np.full((len(short), int(sizes.max()) + 1), -1, np.int64)
        columns = np.arange(ids.shape[1])
        ids[columns < sizes[:, None]] = np.array(self.bytes)[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        rank, makes = np.full(ids.shape, NO_MERGE), np.zeros(ids.shape, np.int64)
        rank[:, :-1], makes[:, :-1] = self._pair(ids[:, :-1], ids[:, 1:])
        done = np.zeros(len(short), bool)
        live, result = np.arange(len(short)), [()] * len(short)
        while len(live):
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            done = rank[rows, at] == NO_MERGE
            if done.any():
                over, counts = ids[done], (ids[done] >= 0).sum(axis=1)
                flat, end = over[over >= 0].tolist(), np.cumsum(counts).tolist()
                for k, a, b in zip(live[done].tolist(), [0, *end], end, strict=False):
                    result[k] = tuple(flat[a:b])
                live, ids, rank, makes, at = live[~done], ids[~done], rank[~done], makes[~done], at[~done]
                rows = np.arange(len(live))
                if not len(live):
                    break
            made = makes[rows, at]
            source = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)  # all behind the pair moves up by one
            ids, rank, makes = (np.take_along_axis(part, source, axis=1) for part in (ids, rank, makes))
            ids[rows, at] = made
            rank[rows, at], makes[rows, at] = self._pair(made, ids[rows, at + 1])
            inner = np.flatnonzero(at)
            k = at[inner] - 1
            rank[inner, k], makes[inner, k] = self._pair(ids[inner, k], made[inner])
        for k, i in zip(short, result, strict=True):
            out[k] = i
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging two ids."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (right >= 0) & (left >= 0)
        return np.where(hit, self.ranks[at], NO_MERGE), self.makes[at]

    def _merged_long(self, ids: list[int]) -> tuple[int, ...]:
        """One word, with a heap of pairs (rank, place, both ids) and linked neighbours."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (m := self.merges.get(ids[k] << 32 | ids[after[k]])):
                heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if ids[k] != a or after[k] < 0 or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone] = self.merges[a << 32 | b][1], -1
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return tuple(i for i in ids if i >= 0)


def compile_lexicon(words: list[tuple[bytes, tuple[int, ...]]], path: str) -> None:
    """Writes the minimal acyclic automaton of the words and their ids to a file.

    Words come in byte order; once a word has branched off, the states behind the branch are final, and each is replaced by an
    equal one that exists already."""
    words = sorted(dict(words).items())
    known: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []  # of finished states: (byte, state)
    ends: list[bool] = []
    open_edges, open_end = [[]], [False]  # of the states along the last word

    def finish(depth: int) -> None:
        while len(open_edges) > depth + 1:
            key = (open_end.pop(), tuple(open_edges.pop()))
            if key not in known:
                known[key] = len(edges)
                edges.append(key[1])
                ends.append(key[0])
            byte = open_edges[-1][-1][0]
            open_edges[-1][-1] = (byte, known[key])

    last = b""
    for word, _ in words:
        same = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        finish(same)
        for byte in word[same:]:
            open_edges[-1].append((byte, -1))
            open_edges.append([])
            open_end.append(False)
        open_end[-1] = True
        last = word
    finish(0)
    edges.append(tuple(open_edges[0]))
    ends.append(open_end[0])
    below: list[int] = []  # words that a state leads to; a state comes after those it leads to
    keys, targets, skips = [], [], []
    for state, (out, end) in enumerate(zip(edges, ends, strict=True)):
        count = int(end)
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            skips.append(count)
            count += below[to]
        below.append(count)
    bounds = np.append(0, np.cumsum([len(ids) for _, ids in words]))
    ids = np.fromiter(chain.from_iterable(ids for _, ids in words), np.int32)
    with Path(path).open("wb") as f:
        np.array([len(keys), len(edges), len(words), len(ids)], np.int64).tofile(f)
        for part, kind in ((keys, np.int64), (targets, np.int32), (skips, np.int32), (bounds, np.int32), (ids, np.int32), (ends, np.uint8)):
            np.asarray(part, kind).tofile(f)


class Lexicon:
    """The automaton's file, memory-mapped."""

    def __init__(self, path: str):
        edges, states, words, ids = np.fromfile(path, np.int64, 4).tolist()
        at, parts = 32, []
        for size, kind in ((edges, np.int64), (edges, np.int32), (edges, np.int32), (words + 1, np.int32), (ids, np.int32), (states, np.uint8)):
            parts.append(np.memmap(path, kind, "r", at, size) if size else np.zeros(0, kind))
            at += size * np.dtype(kind).itemsize
        self.keys, self.targets, self.skips, self.bounds, self.ids, self.ends = parts
        self.root = states - 1

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Ids of each word, or none: all words walk together, a byte at a time."""
        sizes = np.array([len(w) for w in words])
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            state[:] = -1
        depth = 0
        while len(live := live[sizes[live] > depth]):
            key = state[live] << 8 | flat[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
            depth += 1
        found = (state >= 0) & (self.ends[state] > 0)
        low, high = self.bounds[number * found], self.bounds[number * found + found]
        return [tuple(self.ids[a:b].tolist()) if f else None for f, a, b in zip(found.tolist(), low.tolist(), high.tolist(), strict=True)]


def slice_words(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the distinct words, bounds of one occurrence of each, the number of each word in order, and words before each row."""
    cuts, rows = cut_words(data, offsets, specials)
    starts, ends = cuts[:-1], cuts[1:]
    distinct, one, number = np.unique(span_digests(data, starts, ends), return_index=True, return_inverse=True)
    return distinct, starts[one], ends[one], number, rows


def count_words(docs: DataFrame, vocabulary, text: str = "text") -> DataFrame:
    """(word, n) over all texts; words are bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        specials = list(vocabulary.value.special)

        def told() -> pa.RecordBatch:
            words, counts = zip(*seen.values(), strict=True)
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

        for _, data, offsets in slices(batches, text):
            distinct, starts, ends, number, _ = slice_words(data, offsets, specials)
            raw = data.tobytes()
            for digest, a, b, n in zip(distinct.tolist(), starts.tolist(), ends.tolist(), np.bincount(number, minlength=len(distinct)).tolist(), strict=True):
                if digest in seen:
                    seen[digest][1] += n
                else:
                    seen[digest] = [raw[a:b], n]
            if len(seen) > REMEMBERED:
                yield told()
                seen.clear()
        if seen:
            yield told()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary, text: str, scratch: Scratch, most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of the corpus and sends the file to all executors; gives its name."""
    spark = docs.sparkSession
    counts = scratch.cut(count_words(docs, vocabulary, text).where("n > 1"), "word-counts")
    step = F.floor(F.log2("n") * 8).cast("int")  # at most 8 * 63 steps
    left, least = most, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("word"), pa.array(vocabulary.value.merged(batch.column("word").to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    rows = counts.where(step >= least).select("word").mapInArrow(run, "word binary, ids array<int>").toArrow() if least is not None else None
    words = list(zip(rows.column("word").to_pylist(), map(tuple, rows.column("ids").to_pylist()), strict=True)) if rows else []
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = Path(tempfile.mkdtemp()).resolve()  # the driver's own, from where executors fetch the file while the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    compile_lexicon(words, str(folder / name))
    spark.sparkContext.addFile(str(folder / name))
    scratch.drop("word-counts")
    return name


def encode(docs: DataFrame, tokenizer: str, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """`docs` with `ids` (array of int)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    name = build_lexicon(docs, vocabulary, text, scratch or Scratch(docs.sparkSession, "bpe"))
    columns = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(name)
        specials = list(vocabulary.value.special)
        for batch, data, offsets in slices(batches, text):
            distinct, starts, ends, number, rows = slice_words(data, offsets, specials)
            at = known.places(distinct, starts, ends, data, vocabulary.value)[number]
            size = known.size[at]
            place = np.append(0, np.cumsum(size))
            ids = known.flat[np.repeat(known.begin[at] - place[:-1], size) + np.arange(place[-1])]
            lists = pa.ListArray.from_arrays(pa.array(place[rows], pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], lists], [*columns, "ids"])

    return docs.mapInArrow(run, schema)


class Remembered:
    """Ids of words that a worker has met, by the words' 64-bit digests."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.size, self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, digests: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Numbers of the words, with new ones looked up in the lexicon, or else merged."""
        if len(self.number) > REMEMBERED:
            self.forget()
        numbers = np.array([self.number.get(k, -1) for k in digests.tolist()], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids = self.lexicon.find(words)
            rest = [k for k, i in enumerate(ids) if i is None]
            for k, i in zip(rest, vocabulary.merged([words[k] for k in rest]), strict=True):
                ids[k] = i
            numbers[new] = np.arange(len(new)) + len(self.size)
            self.number.update(zip(digests[new].tolist(), numbers[new].tolist(), strict=True))
            size = np.array([len(i) for i in ids], np.int64)
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())))
        return numbers


@functools.lru_cache(maxsize=1)
def remembered(name: str) -> Remembered:
    """One memory for all tasks of a worker with the same lexicon."""
    return Remembered(Lexicon(SparkFiles.get(name)))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`: the text of the ids, special tokens included. Ids that no piece has add nothing."""
    shipped = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).pieces)
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in columns], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shipped.value
        piece = np.array([len(p) for p in pieces], np.int64)
        flat, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(piece) - piece
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(ids)
                values = column.flatten().to_numpy(zero_copy_only=False)
                values = np.where((values >= 0) & (values < len(pieces)), values, len(pieces))
                size = np.append(piece, 0)[values]
                place = np.append(0, np.cumsum(size))
                data = flat[np.repeat(np.append(begin, 0)[values] - place[:-1], size) + np.arange(place[-1])].tobytes()
                rows = place[np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))]
                texts = [data[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
                try:
                    decoded = pa.array(texts, pa.binary()).cast(pa.string())
                except pa.ArrowInvalid:  # ids that break off within a character
                    decoded = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], decoded], [*columns, "decoded"])

    return encoded.mapInArrow(run, schema)
