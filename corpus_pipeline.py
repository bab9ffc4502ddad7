"""From raw documents to token ids in five stages; each reads what its predecessor has written, and its decisions take effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.llm import bpe, jaccard, line_crf, word_repeats
from ledgerbeam.llm.queries import contamination, line_field, table, tokenizer_path
from ledgerbeam.llm.shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the content share of the line labels keep."""
    return line_crf.judge_lines(docs, line_field(spark, docs, sf_dir)).where("kept").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones."""
    return jaccard.keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of words that stand elsewhere too; documents of which nothing stays go, others are left untouched."""
    done = word_repeats.remove_repeated_words(docs).where("size(removed) = 0 or kept <> ''")
    text = F.when(F.size("removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts, and whether they decode to the text. Encoded rows are written in between: in one stage with the decoding,
    each task would keep two Python workers and their batches in memory."""
    path = tokenizer_path()
    done = bpe.decode(Scratch(spark, "bpe-encoding").cut(bpe.encode(docs, path), "encoded"), path)
    return done.select(*[c for c in docs.columns if c != "text"], "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The labels of lines, near copies and token ids are beyond SQL; the tests step through the stages on a small table and hold near copies
#: and repeats against brute force; of quality_rules they check the least number of words, of decontamination only that a subset stays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
