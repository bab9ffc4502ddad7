"""Ranked search, exact dedup and hard negatives against brute force on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns named like outputs or like what the operators use inside."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import exact_dedup, hard_negatives, ranked_search
from ledgerbeam.llm.strassen import product
from ledgerbeam.llm.symbols import gram_digests, run_digests, span_digests

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASHES = ["id", "row", "rank", "score", "digest", "plain", "hot", "best", "n", "item", "key", "keep_id", "body", "label_"]


def stored(spark, folder, rows, schema, clashes=True):
    """The rows as a table of three files, with columns of clashing names beside them."""
    df = spark.createDataFrame(rows, schema)
    if clashes:
        df = df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
    df.repartition(3).write.mode("overwrite").parquet(str(folder / "rows.parquet"))
    return spark.read.parquet(str(folder / "rows.parquet"))


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, count):
    lists = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in lists if c), sum(sum(c.values()) for _, c in lists)
    df = Counter(w for _, c in lists for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in lists:
            size = 50 + 50 * sum(c.values()) * n // total
            x = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * size)) for w in set(terms(text)) if c[w])
            scores += [(-x, i is None, i or 0)] if x else []
        out += [(str(item), k + 1, None if none else i, -x) for k, (x, none, i) in enumerate(sorted(scores)[:count])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "block"), [(1 << 12, 4 << 20), (5, 40)])  # many small shards, so that bounds skip; an item to a block
def test_search_matches_brute_force(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "SHARD_TEXTS", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    rng = np.random.default_rng(5)
    words = [f"W{k}" for k in range(40)] + ["é", "Ñu", "x1"]
    share = 1 / np.arange(1, len(words) + 1)
    some = lambda n: " -".join(rng.choice(words, n, p=share / share.sum()).tolist())
    docs = [(i, some(int(rng.integers(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, " .;"), (None, "w30 w31"), (5, "w30 w31"), (5, "w30 w31"), (203, some(30_000))]
    items = [(i, some(int(rng.integers(0, 12)))) for i in range(8)] + [(20, None), (21, "nowhere"), (None, "w30 é"), (7, "w30"), (7, "w30"), (22, "W30 w30  W31-é")]
    got = ranked_search.search(stored(spark, tmp_path, docs, "doc_id long, text string"), stored(spark, tmp_path / "i", items, "item_id long, text string"), count=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([(str(r[0]), r[1], r[2], r[3]) for r in got.collect()], key=str) == ranked(docs, items, 7)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(docs.where("false"), items).count() == ranked_search.search(docs, items.where("false")).count() == 0
    assert ranked_search.search(docs, items).count() == 1


def test_pair_bounds_skip_texts():
    """Two terms that never stand in one text: their pair's bound is one impact, not two, so both lists are skipped."""
    import pyarrow as pa

    queries = ranked_search.Queries(["a b c"])
    texts = ["a"] * 50 + ["b"] * 50 + ["c c c"] + ["z"] * 900
    lists = next(ranked_search._lists(type("B", (), {"value": queries}), "body")(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "body"])])))
    queries.weigh({t: int(n) for t, n in zip(lists.column("terms")[0].as_py(), lists.column("sizes")[0].as_py())}, len(texts), 1004)
    lists = lists.append_column("shard", pa.array([0], pa.int32()))
    index = next(ranked_search._index(type("B", (), {"value": queries}))(iter([lists])))
    shard = ranked_search.Shard({c: index.column(c)[0] for c in index.schema.names}, queries)
    (two, pair), = queries.units
    single = int(shard.most[shard.where[two[0]]].max())
    assert sorted(index.column("joint")[0].as_py()) == [0] and shard.most[shard.where[two[0]]].sum() > single + 1
    assert shard.search(two, pair, single + 1)[2] == 1  # only the text of c is looked at
    assert shard.search(two, pair, 1)[2] == 101


def groups(rows):
    white = str.maketrans("", "", exact_dedup.WHITE)
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(white)].append((-len(t or ""), i is None, i or 0))
    return {plain: (min(v), len(v)) for plain, v in by.items()}, lambda t: (t or "").translate(white)


@pytest.mark.parametrize(("share", "digest"), [(4096, 32), (1, 32), (8, 32), (8, 0), (1, 1)])  # salts for all or some, none; all digests equal
def test_exact_dedup_matches_brute_force(spark, tmp_path, monkeypatch, share, digest):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(["a", "é", " ", "\n", " "], rng.integers(0, 5)).tolist())) for i in range(300)]
    rows += [(i, "the same " * 3 + " " * (i % 3)) for i in range(400, 600)] + [(700, None), (701, ""), (702, " \t\n\x0b\x0c\r"), (None, "null id"), (None, "null id"), (3, rows[3][1]), (3, rows[3][1]), (None, " a"), (900, "long " * 50_000), (901, "long" * 50_000)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string")
    want, plain = groups(rows)
    by_id = defaultdict(set)
    for i, t in rows:
        by_id[i].add(plain(t))
    done = exact_dedup.group_copies(docs, digest_bytes=digest).collect()
    assert len(done) == len(rows) and sum(r.kept for r in done) == len(want)
    import hashlib

    keys = {hashlib.sha256(p.encode()).hexdigest(): v for p, v in want.items()}
    for r in done:
        (_, none, i), size = keys[r.text_sha256]
        assert r.group_size == size and r.keep_id == (None if none else i) and (not r.kept or r.doc_id == r.keep_id)
    assert Counter(r.text_sha256 for r in done) == Counter({k: v[1] for k, v in keys.items()})
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(v[0] for v in want.values())


def test_exact_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.group_copies(docs).count() == exact_dedup.drop_copies(docs).count() == 0


def test_exact_dedup_runs_in_the_jvm(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "a"), (2, "a ")], "doc_id long, text string")
    for df in (exact_dedup.group_copies(docs), exact_dedup.drop_copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("shape", [(0, 3, 4), (1, 0, 2), (7, 5, 9), (33, 64, 31), (70, 33, 65), (2, 100, 2)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 25), 1 << 25, shape[:2]), rng.integers(-(1 << 25), 1 << 25, shape[1:])
    assert (product(a, b, leaf=2) == a @ b).all() and product(a, b, leaf=2).shape == (a @ b).shape


def negatives(rows, positives, count):
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and abs(256 * x) < 1 << 26 for x in v)]
    order = lambda k: (k[0], k[1] is None, k[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i is None or i % 3:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, m, w) in enumerate(rows) if b != a), key=order)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            near = [(j, -s) for s, j, m in scored if m != label and 30 * -ps <= 100 * -s <= 90 * -ps][:count]
            out += [(i, p, k + 1, j, -ps, s) for k, (j, s) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("tile", "held"), [(1024, 1 << 17), (4, 3)])
def test_hard_negatives_match_brute_force(spark, tmp_path, monkeypatch, tile, held):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "HELD_ROWS", held)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), [float(x) / 64 for x in rng.integers(-3, 12, 5)]) for i in range(60)]
    rows += [(60, None, [1.0] * 5), (61, 1, None), (62, 1, [1.0, None]), (63, 1, [math.nan] * 5), (66, 1, [math.inf] * 5), (69, 2, []), (72, 0, [0.5]), (None, 1, [0.2] * 5), (75, 1, [1e30] * 5), (78, 1, [0.1] * 7)]
    rows += [rows[3], rows[4], (None, 0, [0.2] * 5)]
    vectors = stored(spark, tmp_path, rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(vectors, F.col("id") % 3 == 0, positives=3, negatives=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == negatives(rows, 3, 4)


def test_hard_negatives_of_nothing(spark):
    vectors = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(vectors.where("false"), F.col("id") > 0).count() == hard_negatives.mine(vectors, F.col("id") < 0).count() == 0


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_exact_dedup", "op13_hard_negatives"])
def test_queries_match_their_sql(spark, name):
    from check import compare

    assert compare(spark, "/root/testdata/sf0.01", name).startswith("ok")


def test_digests_tell_arranged_words_apart():
    """Words and runs in the order of the Thue-Morse sequence and its complement, which cancel out in sums of powers modulo 2 ** 64."""
    bits = np.array([bin(k).count("1") % 2 for k in range(4096)])
    text = np.concatenate([np.where(bits, 97, 98), np.where(bits, 98, 97)]).astype(np.uint8)
    half = len(bits)
    assert len(set(span_digests(text, np.array([0, half, 0, half]), np.array([half, 2 * half, 1024, half + 1024])).tolist())) == 4
    symbols = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = run_digests(symbols, np.array([0, half, 0, half, 0, 3]), np.array([half, 2 * half, 1024, half + 1024, 5, 8]))
    assert len(set(runs.tolist())) == 6
    for size in (1, 2, 35, 64, 400, 1024):
        grams = gram_digests(symbols, size)
        own = {text[k : k + size].tobytes(): g for k, g in enumerate(grams.tolist())}
        assert len(set(own.values())) == len(own) and all(own[text[k : k + size].tobytes()] == g for k, g in enumerate(grams.tolist()))
    data = np.frombuffer(b"somewordsomeword" + b"x" * 84 + b"somewordandsome", np.uint8)
    assert len(set(span_digests(data, np.array([0, 8, 100]), np.array([8, 16, 108])).tolist())) == 1
