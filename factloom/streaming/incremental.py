"""Incremental indexing by Structured Streaming.

Each micro-batch of documents is indexed and its rows are inserted if their keys are absent.  Ids are digests of content
positions, so a batch that is replayed after a failure inserts nothing twice.  Vocabulary counts are per batch: a term must reach
the minimum frequency inside one batch.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import LoomConfig
from ..plans.index import IndexPipeline
from ..sources.documents import from_table
from ..sources.storage import TableStorage


def index_stream(spark: SparkSession, documents: DataFrame, storage: TableStorage, llm: Any, embedding: Any, config: LoomConfig, checkpoint: str, *, id_col: str = "doc_id", text_col: str = "text", **trigger: Any) -> StreamingQuery:
    """Starts a query that adds the documents of the stream to ``storage``."""
    pipeline = IndexPipeline(spark, llm, embedding, config)

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            storage.save(pipeline.run(from_table(batch, id_col, text_col)))

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
