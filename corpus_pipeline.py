"""A training-data pipeline in four stages; each one's result is written and read again by the next.

All stages read whole texts of any length, give no rows for an empty table, and leave other columns as they are, whatever
their names. Null texts count as empty, and rows with a null id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import jaccard, packing, quality, substring
from tramline.llm.store import discard, owned, written

#: Near copies here: shingles of five words, 80 % or more of them in common.
SHINGLE, PERCENT = 5, 80


def stage(f: Callable) -> Callable:
    """A stage: before it begins, what those before it wrote on the way goes, as their results are written by then."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(but=docs, owner="pipeline")
        with owned("pipeline"):
            return f(spark, docs, sf_dir)

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model holds to be good, judged row by row: repeated rows and ids go or stay together with
    equal texts. Null and empty texts go."""
    judged = quality.judge(docs.select("doc_id", "text", F.struct("*").alias("row")), keep=("row",))
    return judged.where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies. Rows that share an id are one group: the one
    with the least checksum of its columns stays. Texts without words, and rows with a null id, all stay."""
    groups = written(jaccard.similar_groups(docs, percent=PERCENT, words=SHINGLE).select("doc_id", "n_shingles", "component_id"), "groups")
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if repeated.limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        first = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
        left = left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select("row.*"))
    return left


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; those that lose nothing keep their white space too. Rows with
    a null id lose nothing, rows with one id don't repeat each other, equal passages stay where the id is least."""
    out = substring.remove_repeats(docs, keep=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    columns = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))}
    return out.select(*(columns.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, each row a document; an empty one is one piece with the end."""
    return packing.digests(packing.pack_documents(docs))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("packing", pack)]

#: Expectation-maximisation, sets of shingles, automata and the byte-level BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = written(f(spark, docs, sf_dir), name)
    discard(but=docs, owner="pipeline")
    return docs
