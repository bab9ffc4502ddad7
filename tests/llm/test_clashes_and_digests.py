"""Extra columns of any name, and words whose digests once were equal."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerbeam.llm import bpe, byte_repeats, decontaminate, jaccard, licences, line_crf, quality_rank, toxicity, word_repeats
from ledgerbeam.llm.queries import tokenizer_path

NAMES = ["pid", "PID2", "_form", "_id", "_sha", "_of", "_line", "_label", "row", "id", "body", "found", "_repeats", "copies", "least", "digest", "n", "label", "kept", "score"]
TEXTS = ["word " * 60 + "one two three four five six", None, "", "other words here\nMIT licence\n" * 8, "word " * 60 + "one two three four five six", "x # | y"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    plain = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in NAMES}).write.parquet(path)
    return spark.read.parquet(path)


OPERATORS = {
    "decontaminate": lambda d, labels: decontaminate.find_contamination(d, d.sparkSession.createDataFrame([(1, "one two three four")], "item_id long, text string")),
    "bpe": lambda d, labels: bpe.encode(d, tokenizer_path()),
    "toxicity": lambda d, labels: (lambda m: toxicity.score_texts(d, m, toxicity.learn_evidence(d, labels, m, "doc_id", "text", "toxic")))(toxicity.character_model(d)),
    "licences": lambda d, labels: licences.scan(d),
    "jaccard": lambda d, labels: jaccard.jaccard_classes(d),
    "keep_one": lambda d, labels: jaccard.keep_one_of_each(d),
    "quality": lambda d, labels: quality_rank.rank(d, quality_rank.fit_ranking(d, labels, "doc_id", "text", "quality")),
    "bytes": lambda d, labels: byte_repeats.remove_repeated_bytes(d),
    "words": lambda d, labels: word_repeats.remove_repeated_words(d),
    "lines": lambda d, labels: line_crf.judge_lines(d, line_crf.fit_field(d, labels, "doc_id", "text", "quality")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_column_name_passes_through(spark, docs, name):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("y") for c in ("_id", "text", "row")})
    got, plain = (OPERATORS[name](d, labels) for d in (docs, docs.select("doc_id", "text")))
    rows = got.collect()
    own = [c for c in plain.columns if c not in NAMES] if name != "jaccard" else plain.columns
    assert sorted(str(tuple(r[c] for c in own)) for r in rows) == sorted(str(tuple(r[c] for c in own)) for r in plain.collect())
    outputs = {c for c in plain.columns if c not in ("doc_id", "text")}
    for c in NAMES:
        if c in got.columns and c not in outputs:
            assert all(r[c] == f"{c}{r.doc_id}" for r in rows), c


@pytest.fixture(scope="module")
def twins():
    """Two words in the order of the Thue-Morse sequence and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_cancel_out_in_sums_stay_different(spark, twins):
    common = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(0, f"{common} {twins[0]}"), (1, f"{common} {twins[1]}")], "doc_id long, text string")
    assert [len(r.removed) for r in word_repeats.remove_repeated_words(docs).collect()] == [0, 0]
    pairs = spark.createDataFrame([(0, " ".join([twins[0]] * 3 + [f"a{k}" for k in range(2)])), (1, " ".join([twins[1]] * 3 + [f"a{k}" for k in range(2)]))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_classes(pairs).collect()} == {0, 1}
    path = tokenizer_path()
    words = spark.createDataFrame([(0, twins[0]), (1, twins[1]), (2, twins[0])], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(words, path), path).collect()} == {0: twins[0], 1: twins[1], 2: twins[0]}
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(1, twins[1])], "item_id long, text string"))
    assert {r.doc_id: list(r["items"]) for r in found.collect()} == {0: [], 1: ["1"]}


def test_byte_repeats_query_matches_brute_force(spark):
    """The registered query on every text of the smallest table."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts: dict[bytes, int] = {}
    for t in texts.values():
        for k in range(len(t) - 399):
            digest = hashlib.blake2b(t[k : k + 400], digest_size=16).digest()
            counts[digest] = counts.get(digest, 0) + 1
    want = {}
    for i, t in texts.items():
        gone, until, spans = bytearray(len(t)), 0, 0
        for k in range(len(t) - 399):
            if counts[hashlib.blake2b(t[k : k + 400], digest_size=16).digest()] > 1:
                spans += k > until or not until
                until = k + 400
                gone[k:until] = b"\x01" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op8_byte_repeats"](spark, sf).collect()} == want
