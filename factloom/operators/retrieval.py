"""From queries to ranked facts: anchors, traversal by beams, ranking.  All for a table of queries at once.

What a query has reached is kept as its few units and as entities, whose units are found by a scan of all units: lists of the
units of every entity of every query would grow with the square of the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LoomConfig
from ..functions import scan
from ..functions.vectors import best_of, cosine, doubles, mean_vectors, subtract_scaled, top_k_scan
from ..sources.scratch import BROADCAST_BYTES, Scratch, dealt
from .graph import FactGraph, entities_by_name

_SALTS = 64  # pieces in which an entity's list of queries is dealt


def named_entities(graph: FactGraph, mentions: DataFrame) -> DataFrame:
    """(query_id, entity_id): the entities that ``mentions`` (query_id, name) names."""
    return entities_by_name(graph.entities, mentions).select("query_id", "entity_id").distinct()


def entity_anchors(graph: FactGraph, mentions: DataFrame) -> DataFrame:
    """(query_id, entity_id, ku_id): all units of each entity that ``mentions`` (query_id, name) names; ku_id null if none.

    An edge meets the list of its entity's queries, so a much named entity with many units is spread like its edges.
    """
    scratch = Scratch(graph.edges.sparkSession)
    asked, pairs = scratch.save(named_entities(graph, mentions)), dealt(graph.edges.select("ku_id", "entity_id"), "ku_id").distinct()
    lists = asked.groupBy("entity_id", F.pmod(F.xxhash64("query_id"), F.lit(_SALTS))).agg(F.collect_list("query_id").alias("q")).select("entity_id", "q")
    small = asked.count() * 100 <= BROADCAST_BYTES
    found = pairs.join(F.broadcast(lists) if small else lists.hint("merge"), "entity_id").select(F.explode("q").alias("query_id"), "entity_id", "ku_id")
    alone = asked.join(graph.edges.select("entity_id"), "entity_id", "left_anti")
    return found.unionByName(alone.select("query_id", "entity_id", F.lit(None).cast(dict(pairs.dtypes)["ku_id"]).alias("ku_id")))


def semantic_anchors(graph: FactGraph, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, ku_id, score): the k units nearest to each of ``queries`` (query_id, query_vector)."""
    return top_k_scan(queries, graph.units, k).select("query_id", "ku_id", "score")


def seed_union(by_entity: DataFrame, by_vector: DataFrame) -> DataFrame:
    """(query_id, ku_id): the union of both kinds of seeds."""
    return by_entity.where("ku_id is not null").select("query_id", "ku_id").unionByName(by_vector.select("query_id", "ku_id")).distinct()


def beyond_named(graph: FactGraph, by_vector: DataFrame, named: DataFrame) -> DataFrame:
    """(query_id, ku_id) of ``by_vector`` that have none of the query's ``named`` (query_id, entity_id)."""
    seeds = by_vector.select("query_id", "ku_id").distinct()
    held = seeds.join(graph.edges.select("ku_id", "entity_id"), "ku_id").join(named, ["query_id", "entity_id"], "left_semi")
    return seeds.join(held.select("query_id", "ku_id"), ["query_id", "ku_id"], "left_anti")


def all_seeds(scratch: Scratch, graph: FactGraph, mentions: DataFrame, by_vector: DataFrame) -> DataFrame:
    """The same as ``seed_union`` of both anchors, each pair made once: nothing of the size of the result is shuffled."""
    named = scratch.save(named_entities(graph, mentions))
    rest = beyond_named(graph, scratch.save(by_vector), named)
    return _sharing(scan.listed(named, "query_id", "entity_id", "reach"), graph.edges).unionByName(rest)


def _entity_lists(edges: DataFrame) -> DataFrame:
    return scan.listed(dealt(edges.select("ku_id", "entity_id"), "ku_id"), "ku_id", "entity_id", "entity_ids")


def linked_units(graph: FactGraph) -> DataFrame:
    """(ku_id, chunk_id, embedding, entity_ids) of all units, and of those that only edges know."""
    units = graph.units.select("ku_id", "chunk_id", doubles(F.col("embedding")).alias("embedding"))
    rows = dealt(units, "ku_id").join(_entity_lists(graph.edges), "ku_id", "full_outer")
    return rows.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def _reach(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, entity_id): the entities of the frontier's units."""
    return frontier.select("query_id", "ku_id").join(edges.select("ku_id", "entity_id"), "ku_id").select("query_id", "entity_id").distinct()


def _sharing(queries: DataFrame, edges: DataFrame, but: bool = False) -> DataFrame:
    """(query_id, ku_id) of the units with an entity of the query's ``reach``, without those of its ``seen`` if ``but``."""
    rows = _entity_lists(edges)
    lists = ("reach", "seen") if but else ("reach",)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, ku_id {dict(edges.dtypes)['ku_id']}"
    work = scan.pairs(scan.arrow_kind(queries, "query_id"), "query_id", "ku_id", lambda t: t.mark(t.sharing("reach"), "seen", False) if but else t.sharing("reach"))
    return scan.scan(scan.blocks(queries, lists), rows, schema, work)


def expand(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(query_id, ku_id): units that share an entity with the frontier and were not visited yet, each once and as they come."""
    reach = scan.listed(_reach(frontier, edges), "query_id", "entity_id", "reach")
    return _sharing(reach.join(scan.listed(visited, "query_id", "ku_id", "seen"), "query_id", "left"), edges, True)


def beam(linked: DataFrame, queries: DataFrame, reach: DataFrame, visited: DataFrame, width: int, named: DataFrame | None = None) -> DataFrame:
    """(query_id, ku_id, score): of ``linked`` units with an entity of a query's ``reach`` the ``width`` best that it has not
    visited, ties by id; a unit without a vector scores 0, a query whose vector is zero keeps none.

    Visited are the pairs (query_id, ku_id) and all units of ``named`` (query_id, entity_id).
    """
    asked = queries.select("query_id", F.col("query_vector").alias("v")).join(scan.listed(reach, "query_id", "entity_id", "reach"), "query_id")
    asked = asked.join(scan.listed(visited, "query_id", "ku_id", "seen"), "query_id", "left")
    lists = ("reach", "seen")
    if named is not None:
        asked, lists = asked.join(scan.listed(named, "query_id", "entity_id", "named"), "query_id", "left"), (*lists, "named")

    def cells(tile: scan.Tile) -> tuple:
        ok = tile.mark(tile.sharing("reach"), "seen", False)
        if "named" in tile.block.lists:
            ok &= ~tile.sharing("named")
        return tile.scores(), ok, tile.ids

    schema = f"query_id {dict(queries.dtypes)['query_id']}, ku_id {dict(linked.dtypes)['ku_id']}, score double"
    work = scan.best_rows(scan.arrow_kind(queries, "query_id"), "query_id", "ku_id", width, cells)
    found = scan.scan(scan.blocks(asked, lists), linked.select("ku_id", "embedding", "entity_ids"), schema, work)
    return best_of(found, width, "query_id", "ku_id").drop("rank")


def update_queries(queries: DataFrame, kept: DataFrame, units: DataFrame, weight: float) -> DataFrame:
    """``queries`` moved away from the mean of the kept units' vectors, at unit length; unmoved where nothing was kept."""
    if weight <= 0:
        return queries
    vectors = kept.join(units.select("ku_id", "embedding"), "ku_id").where(F.size("embedding") > 0)
    moved = queries.join(mean_vectors(vectors, "query_id", "embedding"), "query_id", "left")
    return moved.select("query_id", F.when(F.col("mean").isNull(), F.col("query_vector")).otherwise(subtract_scaled(F.col("query_vector"), F.col("mean"), weight)).alias("query_vector"))


def traverse(scratch: Scratch, graph: FactGraph, queries: DataFrame, seeds: DataFrame, config: LoomConfig | None = None, named: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """(query_id, ku_id) of all units collected from ``seeds`` (query_id, ku_id), seeds included.

    All units of ``named`` (query_id, entity_id) are seeds too: they are walked from, but not listed, and ``seeds`` has none of them.
    Each depth is one scan over all queries; its beam and vectors, bounded by the number of queries, are saved, so the
    lineage stays short.  Seed entities have no other part in it: the first step goes from the seed units to their entities.
    """
    config = config or LoomConfig()
    width = min(config.beam_size, max(1, config.max_kus_per_depth))
    now = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    linked = scratch.save(linked_units(graph)) if linked is None else linked
    visited = frontier = scratch.save(seeds.select("query_id", "ku_id").distinct())
    for depth in range(config.traversal_depth):
        reach = _reach(frontier, graph.edges)
        if named is not None and not depth:
            units = graph.edges.join(named.select("entity_id").distinct(), "entity_id").select("ku_id", F.col("entity_id").alias("by"))
            beside = units.join(graph.edges.select("ku_id", "entity_id"), "ku_id").select("by", "entity_id").distinct()
            reach = reach.unionByName(named.withColumnRenamed("entity_id", "by").join(beside, "by").select("query_id", "entity_id")).distinct()
        frontier = scratch.save(beam(linked, now, scratch.save(reach), visited, width, named).select("query_id", "ku_id"))
        if frontier.isEmpty():
            break
        now = scratch.save(update_queries(now, frontier, graph.units, config.query_update_weight))
        visited = visited.unionByName(frontier)
    return visited


def _found_cells(tile: scan.Tile, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's scores, which units were found, and which of them are scored: those with a vector and not under ``least``."""
    score = tile.scores()
    found = tile.mark(tile.sharing("named"), "seen", True)
    return score, found, found & tile.fits[:, None] & (score >= least)


def _asked(queries: DataFrame, found: DataFrame, named: DataFrame) -> DataFrame:
    asked = queries.select("query_id", doubles(F.col("query_vector")).alias("v")).join(scan.listed(found, "query_id", "ku_id", "seen"), "query_id", "left")
    return asked.join(scan.listed(named, "query_id", "entity_id", "named"), "query_id", "left")


def best_found(scratch: Scratch, graph: FactGraph, linked: DataFrame, queries: DataFrame, found: DataFrame, named: DataFrame, config: LoomConfig) -> DataFrame:
    """(query_id, ku_id): of ``found`` and all units of ``named`` those that make a query's best items.

    Chunks (or units, if they are not grouped) are ranked where they lie, a task keeps the best of each query, and only the units of
    these are listed.  ``rank_chunks`` and ``rank_units`` make of them what they would make of all.
    """
    least, how, n = config.min_score_threshold, config.score_aggregation, config.result_top_n
    kind, schema = scan.arrow_kind(queries, "query_id"), f"query_id {dict(queries.dtypes)['query_id']}, %s string, score double"
    parts = scan.blocks(_asked(queries, found, named), ("seen", "named"), zero=True)
    if not config.group_by_chunk:

        def units(tile: scan.Tile) -> tuple:
            score, _, ok = _found_cells(tile, least)
            return score, ok, tile.ids

        best = scan.scan(parts, linked, schema % "ku_id", scan.best_rows(kind, "query_id", "ku_id", n, units))
        return best_of(best, n, "query_id", "ku_id").select("query_id", "ku_id")

    def chunks(tile: scan.Tile) -> tuple:
        score, _, ok = _found_cells(tile, least)
        own = np.logical_or.reduceat(ok, tile.begins, axis=0)
        if how == "max":
            value = np.maximum.reduceat(np.where(ok, score, -np.inf), tile.begins, axis=0)
        else:
            value = np.add.reduceat(np.where(ok, score, 0.0), tile.begins, axis=0)
            if how != "sum":
                value /= np.maximum(np.add.reduceat(ok.astype(np.int32), tile.begins, axis=0), 1)
        return value, own, tile.batch.column("chunk_id").take(tile.begins)

    rows = dealt(linked.where("chunk_id is not null"), "chunk_id").sortWithinPartitions("chunk_id")
    best = scan.scan(parts, rows, schema % "chunk_id", scan.best_rows(kind, "query_id", "chunk_id", n, chunks, "chunk_id"))
    best = best_of(best, n, "query_id", "chunk_id").select("query_id", "chunk_id")
    members = scratch.save(best.join(linked.select("chunk_id", "ku_id", "entity_ids"), "chunk_id"))
    of_named = members.select("query_id", "ku_id", F.explode("entity_ids").alias("entity_id")).join(named, ["query_id", "entity_id"], "left_semi")
    listed = members.select("query_id", "ku_id").join(found, ["query_id", "ku_id"], "left_semi")
    return of_named.select("query_id", "ku_id").unionByName(listed).distinct()


def found_counts(linked: DataFrame, queries: DataFrame, found: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """(query_id, kus_retrieved, kus_scored) of the queries that have a scored unit."""
    kind = scan.arrow_kind(queries, "query_id")

    def counted(block: scan.Block, batches):
        both = np.zeros((2, len(block.ids)), np.int64)
        for tile in scan.tiles(block, batches, True):
            _, got, ok = _found_cells(tile, least)
            both[:, tile.lo : tile.hi] += got.sum(0), ok.sum(0)
        yield scan.pa.record_batch({"query_id": scan.pa.array(block.ids, kind), "kus_retrieved": both[0], "kus_scored": both[1]})

    parts = scan.blocks(_asked(queries, found, named), ("seen", "named"), zero=True)
    rows = scan.scan(parts, linked, f"query_id {dict(queries.dtypes)['query_id']}, kus_retrieved long, kus_scored long", counted)
    return rows.groupBy("query_id").agg(F.sum("kus_retrieved").alias("kus_retrieved"), F.sum("kus_scored").alias("kus_scored")).where("kus_scored > 0")


def score_units(graph: FactGraph, found: DataFrame, queries: DataFrame, least: float = 0.0) -> DataFrame:
    """Collected units with their cosine to the original query and entity names; without a vector, or under ``least``, out."""
    scored = found.join(graph.units.select("ku_id", "ku_ord", "content", "chunk_id", "embedding"), "ku_id").where(F.size("embedding") > 0)
    scored = scored.join(queries.select("query_id", "query_vector"), "query_id").withColumn("score", cosine(F.col("query_vector"), F.col("embedding"))).where(F.col("score") >= least)
    named = graph.edges.join(graph.entities.select("entity_id", "name"), "entity_id").join(found.select("ku_id").distinct(), "ku_id", "left_semi")
    names = named.groupBy("ku_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("entity_names"))
    scored = scored.join(names, "ku_id", "left").withColumn("entity_names", F.coalesce("entity_names", F.array().cast("array<string>")))
    return scored.select("query_id", "ku_id", "ku_ord", "content", "chunk_id", "score", "entity_names")


def _top(items: DataFrame, n: int, tie: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), tie)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rank_units(scored: DataFrame, n: int) -> DataFrame:
    """Items of one unit each."""
    items = _top(scored, n, "ku_id")
    return items.select("query_id", "rank", "content", "score", F.col("chunk_id").alias("source_chunk_id"), F.array("ku_id").alias("knowledge_unit_ids"), "entity_names")


def rank_chunks(graph: FactGraph, scored: DataFrame, n: int, how: str = "mean") -> DataFrame:
    """Items of one chunk each: mean, max or sum of the scores (anything else is mean), the units' ids in order and the
    distinct entity names; the chunk's text, or the units' contents where the chunk is missing."""
    value = {"max": F.max, "sum": F.sum}.get(how, F.avg)("score").alias("score")
    members = F.array_sort(F.collect_list(F.struct("ku_ord", "ku_id", "content")))  # bounded by what one query collected
    groups = scored.groupBy("query_id", "chunk_id").agg(value, members.alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entity_names")))).alias("entity_names"))
    items = _top(groups, n, "chunk_id").join(graph.chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id", "left")
    return items.select("query_id", "rank", F.coalesce("text", F.array_join(F.transform("m", lambda s: s["content"]), "\n")).alias("content"), "score", F.col("chunk_id").alias("source_chunk_id"), F.transform("m", lambda s: s["ku_id"]).alias("knowledge_unit_ids"), "entity_names")


def retrieval_stats(found: DataFrame, scored: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, kus_retrieved, kus_scored, items_returned) of the queries that have a scored unit."""
    def count(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("query_id").agg(F.count("*").alias(name))

    return count(scored, "kus_scored").join(count(found, "kus_retrieved"), "query_id").join(count(items, "items_returned"), "query_id")
