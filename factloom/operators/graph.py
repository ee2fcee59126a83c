"""The three-layer graph: chunks, units, entities, and the edges between units and entities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import as_factory
from ..sources.scratch import Scratch


@dataclass(frozen=True)
class FactGraph:
    """Four tables.

    chunks (chunk_id, chunk_ord, doc_id, index, content, metadata), units (ku_id, ku_ord, chunk_id, content, embedding, entity_ids,
    metadata), entities (entity_id, entity_ord, name, name_key, entity_type, embedding, metadata), edges (ku_id, pos, entity_id;
    repeats possible).  ``entity_ord`` is an entity's place in the list of all.
    """

    chunks: DataFrame
    units: DataFrame
    entities: DataFrame
    edges: DataFrame

    def stats(self) -> dict[str, int]:
        return {r["layer"]: r["n"] for r in graph_stats(self).collect()}

    # look-ups: an equi-join each, for one value or a table of them
    def unit(self, ku_id: str) -> DataFrame:
        return self.units.where(F.col("ku_id") == ku_id)

    def entity(self, entity_id: str) -> DataFrame:
        return self.entities.where(F.col("entity_id") == entity_id)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def entity_by_name(self, name: str) -> DataFrame:
        return entities_by_name(self.entities, self.units.sparkSession.createDataFrame([(name,)], "name string"))

    def units_of(self, entity_id: str) -> DataFrame:
        return self.edges.where(F.col("entity_id") == entity_id).select("ku_id")

    def entities_of(self, ku_id: str) -> DataFrame:
        return self.edges.where(F.col("ku_id") == ku_id).select("entity_id")


def graph_stats(graph: FactGraph) -> DataFrame:
    """(layer, n): edges are counted with their repeats."""
    layers = {"chunks": graph.chunks, "knowledge_units": graph.units, "entities": graph.entities, "edges": graph.edges}
    out = None
    for name, table in layers.items():
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def entities_by_name(entities: DataFrame, names: DataFrame, name: str = "name", order: str = "entity_ord") -> DataFrame:
    """For each of ``names`` the entity of that name, ignoring case (not stripped); of several the last in ``order``, which is
    the one that linking gives a name's units to."""
    known = entities.groupBy("name_key").agg(F.max_by("entity_id", order).alias("entity_id"))
    asked = names.withColumn("name_key", F.lower(F.col(name)))
    return asked.join(known, "name_key").drop("name_key")


def filter_rare(entities: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Entities of at least ``least`` edges, repeats counted, and their edges."""
    kept = edges.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity_id")
    return entities.join(kept, "entity_id", "left_semi"), edges.join(kept, "entity_id", "left_semi")


def unit_entity_lists(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``units`` with their ordered ``entity_ids``, empty if they have none."""
    lists = edges.groupBy("ku_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda s: s["entity_id"]).alias("entity_ids"))
    return units.join(lists, "ku_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def embed(rows: DataFrame, column: str, model: Any, batch_size: int = 100, into: str = "embedding") -> DataFrame:
    """``rows`` with the vectors of ``column``: Arrow batches cut to the model's batch size; a model's error is raised."""
    make = as_factory(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        opened = make()
        for texts in batches:
            found: list[list[float]] = []
            for lo in range(0, len(texts), batch_size):
                found += opened.embed_batch(texts.iloc[lo : lo + batch_size].tolist())
            yield pd.Series(found, index=texts.index, dtype=object)

    return rows.withColumn(into, run.asNondeterministic()(F.col(column)))


def build_graph(scratch: Scratch, chunks: DataFrame, units: DataFrame, entities: DataFrame, edges: DataFrame | None, model: Any, *, least: int = 1, batch_size: int = 100, parallel: int = 1) -> FactGraph:
    """Rare entities out, vectors in, lists wired.  Every table is saved, so no model is asked twice.

    Units that have their lists ``entity_ids`` need no ``edges`` and are saved once.
    """
    if edges is None and least > 1:
        units = scratch.save(units)
        edges = units.select("ku_id", F.posexplode("entity_ids").alias("pos", "entity_id"))
        units = units.drop("entity_ids")
    if edges is None:
        if parallel > 1:
            units, entities = units.repartition(parallel), entities.repartition(parallel)
        named = scratch.save(_named(entities, model, batch_size))
        linked = scratch.save(_noted(embed(units, "content", model, batch_size)))
        return FactGraph(scratch.save(chunks), linked, named, linked.select("ku_id", F.posexplode("entity_ids").alias("pos", "entity_id")))
    if least > 1:
        entities, edges = filter_rare(entities, edges, least)
    edges = scratch.save(edges.select("ku_id", "pos", "entity_id"))
    if parallel > 1:
        units, entities = units.repartition(parallel), entities.repartition(parallel)
    vectors = scratch.save(embed(units.drop("embedding"), "content", model, batch_size))
    named = scratch.save(_named(entities, model, batch_size))
    return FactGraph(scratch.save(chunks), scratch.save(_noted(unit_entity_lists(vectors, edges))), named, edges)


def _named(entities: DataFrame, model: Any, batch_size: int) -> DataFrame:
    return embed(entities.select("entity_id", "entity_ord", "name", "name_key", "entity_type"), "name", model, batch_size)


def _noted(units: DataFrame) -> DataFrame:
    """``units`` with what is known of their extraction as ``metadata``."""
    notes = []
    if "extraction_method" in units.columns:
        notes = [F.lit("extraction_method"), F.col("extraction_method"), F.lit("matched_entities"), F.size(F.array_distinct("entity_ids")).cast("string")]
    if "raw_entities" in units.columns:
        notes = [F.lit("raw_entities"), F.to_json("raw_entities")]
    made = F.create_map(*notes) if notes else F.create_map().cast("map<string,string>")
    return units.withColumn("metadata", made).drop("extraction_method", "raw_entities")
