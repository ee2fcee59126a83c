"""Queries to ranked results."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prompts
from ..config import LoomConfig
from ..operators.extraction import ask, parse_query
from ..operators.graph import FactGraph, embed
from ..operators.retrieval import beyond_named, best_found, found_counts, linked_units, named_entities, rank_chunks, rank_units, score_units, semantic_anchors, traverse
from ..sources.scratch import Scratch


@dataclass
class Item:
    content: str
    score: float
    source_chunk_id: str
    knowledge_unit_ids: list[str] = field(default_factory=list)
    entity_names: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class SearchResult:
    query: str = ""
    entities_extracted: list[str] = field(default_factory=list)
    graph_stats: dict[str, int] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self, path: str | Path | None = None) -> str:
        text = json.dumps(asdict(self), indent=2)
        if path:
            Path(path).write_text(text)
        return text

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> SearchResult:
        known = {k: data[k] for k in ("query", "entities_extracted", "graph_stats") if k in data}
        return cls(**known, items=[Item(**x) for x in data.get("items", [])])


class RetrievePipeline:
    """Searches a graph for one query, or for a table of queries in one plan."""

    def __init__(self, spark: SparkSession, graph: FactGraph, llm: Any, embedding: Any, config: LoomConfig | None = None):
        self.spark, self.graph, self.llm, self.embedding, self.config = spark, graph, llm, embedding, config or LoomConfig()
        self.template = prompts.checked(prompts.resolve(self.config.query_entity_prompt, "FACTLOOM_QUERY_PROMPT", prompts.QUERY), "query")

    def search_all(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Items, mentions and stats of ``queries`` (query_id, query)."""
        scratch, config = Scratch(self.spark), self.config
        vectors = scratch.save(embed(queries, "query", self.embedding, config.embedding_batch_size, "query_vector").select("query_id", "query_vector"))
        replies = scratch.save(ask(queries, "query_id", "query", self.llm, self.template, "query", config.ku_concurrency))
        names = F.udf(lambda r: parse_query(r or ""), "array<string>", useArrow=True)
        mentions = scratch.save(replies.select("query_id", F.posexplode(names("reply")).alias("pos", "name")))
        items, stats = self.search_vectors(scratch, vectors, mentions)
        return items, mentions, stats

    def search_vectors(self, scratch: Scratch, queries: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Items and stats of ``queries`` (query_id, query_vector) that mention (query_id, name)."""
        config, graph = self.config, self.graph
        queries, linked = scratch.save(queries), scratch.save(linked_units(graph))
        named = scratch.save(named_entities(graph, mentions.select("query_id", "name")))
        seeds = beyond_named(graph, scratch.save(semantic_anchors(graph, queries, config.anchor_top_k)), named)
        found = scratch.save(traverse(scratch, graph, queries, seeds, config, named, linked))
        best = scratch.save(best_found(scratch, graph, linked, queries, found, named, config))
        scored = scratch.save(score_units(graph, best, queries, config.min_score_threshold))
        items = rank_chunks(graph, scored, config.result_top_n, config.score_aggregation) if config.group_by_chunk else rank_units(scored, config.result_top_n)
        items = scratch.save(items)
        counts = found_counts(linked, queries, found, named, config.min_score_threshold)
        return items, counts.join(items.groupBy("query_id").agg(F.count("*").alias("items_returned")), "query_id")

    def search(self, query: str) -> SearchResult:
        """The result of one query; without an anchor it is empty."""
        table = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        items, mentions, stats = self.search_all(table)
        names = [r["name"] for r in mentions.orderBy("pos").collect()]
        counts = [{k: r[k] for k in ("kus_retrieved", "kus_scored", "items_returned")} for r in stats.collect()]
        rows = items.orderBy("rank").collect()
        return SearchResult(query, names, counts[0] if counts else {}, [Item(r["content"], r["score"], r["source_chunk_id"], list(r["knowledge_unit_ids"]), list(r["entity_names"])) for r in rows])

