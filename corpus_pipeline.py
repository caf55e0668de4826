"""A corpus pipeline: language ID, near duplicates, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result is
to be written before the next stage begins, which deletes what the one before it left in the shared
folder. For every stage, rows with null ids or texts, repeated rows and ids on several texts are rows
like others; an empty table gives an empty table; columns of docs beyond those of documents go.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from threadloom.llm.shared import delete, scope, sweep, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: What this thread's last stage has left, until the next one begins.
_left = threading.local()


def _tidy(spark: SparkSession, docs: DataFrame) -> None:
    made, _left.made = getattr(_left, "made", []), []
    read = docs.inputFiles()
    if not any(path.split(":")[-1].lstrip("/") in file for path, _ in made for file in read):
        delete(spark, made)
        sweep(spark)


def stage(run):
    """A stage that deletes what the stage before it left, unless docs still reads from that."""

    @wraps(run)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidy(spark, docs)
        with scope() as made:
            out = run(spark, docs, sf_dir)
        _left.made = made
        return out

    return tidied


def keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS with key, a 64-bit hash of id and text: ids may be null, or stand on several texts."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("key"))


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those that are rejected go."""
    return language_id.identify(docs, min_margin=language_id.MIN_MARGIN).where(~F.col("rejected")).select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect (five-word shingles, similarity of 0.8), the row of the least id, nulls last.

    Rows are told apart by id and text, so one id may stand on several texts, and any number of ids may be null.
    """
    docs = keyed(docs)
    grouped = jaccard_join.join(docs, id_col="key", k=5, num=80, den=100).where("n_shingles > 0")
    grouped = written(grouped.select(F.col("doc_id").alias("key"), "uid", "component"), "groups")
    # A component is named by the uid of one of its rows, so joins by uid and key find the rows that
    # are not alone; none is by component, of which one may hold a third of all rows.
    others = grouped.where("uid <> component")
    firsts = grouped.join(others.select(F.col("component").alias("uid")).distinct(), "uid", "left_semi")
    members = others.unionByName(firsts.select(*others.columns)).groupBy("key", "component").agg(F.count("*").alias("rows"))
    members = written(members.join(docs.select("key", "doc_id").distinct(), "key"), "members")
    least = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
    members = members.join(least.select("least.key", F.lit(True).alias("least")), "key", "left").select("key", "rows", F.col("least").isNotNull().alias("stays"))
    members = written(members, "marked")
    kept = docs.join(members.where("not stays").select("key"), "key", "left_anti")
    # Equal rows of one id and text: one of them stays. Rows without words are in no group.
    again = members.where("stays and rows > 1").select("key")
    if again.limit(1).count():
        kept = kept.join(again, "key", "left_anti").unionByName(kept.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select(*COLUMNS)


@stage
def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 100-byte strings with an earlier start cover; emptied documents go."""
    out = suffix_dedup.dedup(docs, carry=("lang", "source"))
    out = out.where((F.length("kept_text") > 0) | (F.col("n_bytes") == 0))
    return out.select("doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", F.length("kept_text").cast("long").alias("n_chars"))


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    docs = keyed(docs)
    leaks = decontaminate.native(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(leaks, "key", "left_anti").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (how often) and taken (words); repeated rows are one with the sum of their copies."""
    docs = keyed(docs)
    mixed = mixing.mix(docs, id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.first("target").alias("target"))
    return docs.dropDuplicates(["key"]).join(mixed.where("copies > 0"), "key").select(*COLUMNS, "copies", "taken", "target")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_spans),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage leaves of documents, in a table of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES:
        docs = written(step(spark, docs, sf_dir), name)
        if before:
            delete(spark, [before])
        before = docs.made
    _tidy(spark, docs)
    return docs
