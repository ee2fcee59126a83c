"""Document sources: Python lists, tables, and tables of chat turns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_list(spark: SparkSession, documents: Sequence[Any]) -> DataFrame:
    """``documents`` (doc_ord, doc_id, text, metadata) of strings or of dicts with text, doc_id and metadata; what is missing is
    numbered or empty, anything else is turned into a string.  Other keys are ignored."""
    rows = []
    for i, d in enumerate(documents):
        given = d if isinstance(d, dict) else {"text": str(d)}
        name = given["doc_id"] if "doc_id" in given else f"doc-{i}"
        notes = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (given.get("metadata") or {}).items()}
        rows.append((i, str(name), given.get("text", ""), notes))
    return spark.createDataFrame(rows, "doc_ord long, doc_id string, text string, metadata map<string,string>")


def from_table(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of a table with a key.  Whole numbers of up to 64 bits give the order; keys of another type are ordered by a
    hash of them, which is as good: a table has no order of its own."""
    whole = dict(table.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    order = F.col(id_col).cast("long") if whole else F.xxhash64(F.col(id_col).cast("string"))
    notes = [F.col("metadata")] if dict(table.dtypes).get("metadata") == "map<string,string>" else []
    return table.select(order.alias("doc_ord"), F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *notes)


def from_turns(table: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One document per conversation: its turns in order, a line each."""
    turns = F.array_sort(F.collect_list(F.struct(order_col, text_col)))
    return from_table(table.groupBy(id_col).agg(F.array_join(F.transform(turns, lambda s: s[text_col]), "\n").alias("text")), id_col)
