"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, tokenising.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next one's docs.  All but the last return the columns of ``documents`` as they came, whatever those are
called.  A stage's decisions are joined back by doc_id; where an id repeats, rows of one id share a decision except that
exact dedup decides row by row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, maybe_broadcast, shrink_heaps
from factloom.llm.exact_dedup import exact_groups
from factloom.llm.jaccard_join import jaccard_components
from factloom.llm.language_id import UNKNOWN, identify_languages
from factloom.llm.mixing import mix_taken
from factloom.llm.queries import PIECE_MODEL
from factloom.llm.sentencepiece_scan import encode_documents


ROW = "__row_of_stage"  # a number of each row, while a stage runs
DRAW = 1  # seed of the mixing stage's draws

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _fresh(stage: Stage) -> Stage:
    """The stage, begun with the executors' heaps as small as they were before the stages ahead of it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the saved table ``dropped`` (_id); a null there stands for the null ids.

    Nulls are apart from the join: a null-safe join's hash table takes several times the room of one by a plain long.
    """
    left = docs.join(maybe_broadcast(dropped.where("_id is not null"), 8), docs["doc_id"] == dropped["_id"], "left_anti")
    return left if dropped.where("_id is null").isEmpty() else left.where("doc_id is not null")


@_fresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (no text, or no letter in it); an id goes if all its rows do.

    That is a test of the text's letters: which language the classifier predicts has no part in the decision.
    """
    found = identify_languages(spark, docs)
    rejected = found.groupBy(F.col("doc_id").alias("_id")).agg(F.min((F.col("lang_pred") == UNKNOWN).cast("int")).alias("all")).where("all = 1")
    return _without(docs, Scratch(spark, "stage").save(rejected.select("_id")))


@_fresh
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, those whose blocks have the same names, the row of the largest id stays, once."""
    scratch = Scratch(spark, "stage")
    rows = scratch.save(docs.withColumn(ROW, F.monotonically_increasing_id()))
    gone = scratch.save(exact_groups(spark, rows, row_col=ROW).where("not kept").select(ROW))
    return rows.join(maybe_broadcast(gone, 8), ROW, "left_anti").drop(ROW)


@_fresh
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    found = jaccard_components(spark, docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return _without(docs, Scratch(spark, "stage").save(gone))


@_fresh
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, 0, 1 or 2 times: what is beyond a whole number is drawn by a hash
    of the id, so that the sources' words keep to their targets, whatever their documents' lengths."""
    found = mix_taken(spark, docs).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    drawn = F.pmod(F.xxhash64("_id", F.lit(DRAW)), F.lit(1 << 30)) / (1 << 30)
    times = found.where("s > 0").select("_id", (F.expr("t div s") + (drawn < F.expr("t % s") / F.col("s")).cast("int")).cast("int").alias("_times")).where("_times > 0")
    times = Scratch(spark, "stage").save(times)
    drawn = docs.join(maybe_broadcast(times.where("_id is not null"), 16), docs["doc_id"] == times["_id"])
    for r in times.where("_id is null").collect():  # one row at most
        drawn = drawn.unionByName(docs.where("doc_id is null").withColumns({"_id": docs["doc_id"], "_times": F.lit(r["_times"])}))
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_id", "_times", "_copy")


@_fresh
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, with their number and whether decoding gives the text back."""
    return encode_documents(spark, docs, PIECE_MODEL)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", tokenise)]

#: Trained models, pseudorandom draws and a tokeniser: not SQL.  The tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
