"""The library's own queries over the driver's tables.

Text operators run over ``documents`` and ``conversations``.  For the graph operators the rows of ``embeddings`` are the units: each
has an entity by label and one by number, five make a chunk, and every twentieth is also a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sql
from .config import LoomConfig
from .functions.text import capitalised_phrases, sentences
from .functions.vectors import top_k_scan
from .models import HashEmbedding, RuleModel
from .operators import graph as G
from .operators import linking, retrieval, vocabulary
from .operators.chunking import chunk_documents, overlap_rows
from .operators.extraction import ask, entities_from_units, parse_replies
from .plans.index import IndexPipeline
from .plans.retrieve import RetrievePipeline
from .prompts import FACTS
from .sources.documents import from_table, from_turns
from .sources.scratch import Scratch, spread
from .sources.storage import new_rows

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "search_end_to_end"
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return from_table(_table(spark, d, "documents"))


def _as_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks."""
    return _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("doc_ord").alias("chunk_ord"), F.col("text").alias("content"))


def _chunks(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    made = chunk_documents(_docs(spark, d), LoomConfig(chunk_strategy=strategy))
    return made.select("doc_id", F.col("index").alias("chunk_index"), F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "fixed")


@query
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "sentence")


@query
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "recursive")


@query
def overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    pieces = _docs(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "content"))
    return overlap_rows(pieces, 200).select("doc_id", "pos", F.md5("content").alias("content_md5"))


@query
def documents_from_turns(spark: SparkSession, d: str) -> DataFrame:
    return from_turns(_table(spark, d, "conversations")).select("doc_ord", "doc_id", "text")


@query
def ku_sentences(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.sentence_units(_as_chunks(spark, d)).select("ku_id", "chunk_id", "content")


@query
def vocab_caps(spark: SparkSession, d: str) -> DataFrame:
    return _as_chunks(spark, d).select(F.explode(capitalised_phrases(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


@query
def vocab_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.term_counts(_as_chunks(spark, d))


@query
def vocab_terms(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.vocabulary_terms(_as_chunks(spark, d)).select("term", "freq")


@query
def entity_case_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.name_index(vocabulary.terms_as_entities(vocabulary.vocabulary_terms(_as_chunks(spark, d)))).select("name_key", "name")


def _names(chunks: DataFrame, lean: bool = False) -> DataFrame:
    """All terms that occur twice, as names."""
    return vocabulary.name_index(vocabulary.terms_as_entities(vocabulary.vocabulary_terms(chunks, lean=lean)))


@query
def entity_link_regex(spark: SparkSession, d: str) -> DataFrame:
    """One regular expression holds one block of names; here the first one, of the 2,000 longest names."""
    chunks = _as_chunks(spark, d)
    names = linking.longest_names(_names(chunks))
    return linking.link_regex(vocabulary.sentence_units(chunks), names).join(F.broadcast(names.select("entity_id", "name")), "entity_id").select("ku_id", "pos", "name")


@query
def entity_link_span(spark: SparkSession, d: str) -> DataFrame:
    chunks, scratch = _as_chunks(spark, d), Scratch(spark)
    return linking.link_spans(scratch, vocabulary.sentence_units(chunks), linking.ranked_names(scratch, _names(chunks, True).drop("entity_id")), "name")


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """The whole index pipeline without a language model, on windows of 1,000 characters."""
    config = LoomConfig(ku_extraction_method="sentence", chunk_strategy="fixed")
    return G.graph_stats(IndexPipeline(spark, None, HashEmbedding(), config).run(_docs(spark, d)))


@query
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = G.embed(_docs(spark, d), "text", HashEmbedding())
    return rows.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0").select("doc_id", "bucket", F.round("x", 9).alias("x"))


@query
def llm_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Rule-made replies to the fact prompt for all documents, parsed."""
    scratch = Scratch(spark)
    replies = scratch.save(ask(_docs(spark, d), "doc_id", "text", RuleModel(), FACTS, "text_chunk", spark.sparkContext.defaultParallelism))
    return parse_replies(replies, "doc_id", "reply").select("doc_id", "pos", "content", F.size("raw_entities").alias("n_entities"))


@query
def entities_from_facts(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the model path: every sentence's capitalised phrases, merged ignoring case, with their edges' number."""
    chunks = _as_chunks(spark, d)
    units = vocabulary.sentence_units(chunks).withColumn("raw_entities", capitalised_phrases(F.col("content")))
    entities, edges = entities_from_units(units)
    return entities.join(edges.groupBy("entity_id").agg(F.count("*").alias("n_edges")), "entity_id").select("name_key", "name", "n_edges")


def toy_graph(spark: SparkSession, d: str) -> G.FactGraph:
    v = _table(spark, d, "embeddings")
    units = v.select(
        F.col("vec_id").cast("string").alias("ku_id"),
        F.col("vec_id").alias("ku_ord"),
        F.concat(F.lit("C"), F.expr("vec_id div 5")).alias("chunk_id"),
        F.concat(F.lit("fact "), F.col("vec_id")).alias("content"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.array(F.concat(F.lit("L"), F.col("label")), F.concat(F.lit("G"), F.expr("vec_id % 13"))).alias("entity_ids"),
    )
    edges = units.select("ku_id", F.posexplode("entity_ids").alias("pos", "entity_id"))
    place = F.expr("2 * cast(substring(entity_id, 2) as bigint) + if(entity_id like 'G%', 1, 0)")
    entities = edges.select("entity_id").distinct().select("entity_id", place.alias("entity_ord"), F.col("entity_id").alias("name"), F.lower("entity_id").alias("name_key"), F.lit("UNKNOWN").alias("entity_type"))
    chunks = units.groupBy("chunk_id").agg(F.min("ku_ord").alias("chunk_ord")).select("chunk_id", "chunk_ord", F.col("chunk_id").alias("doc_id"), F.lit(0).alias("index"), F.concat(F.lit("text of "), F.col("chunk_id")).alias("content"))
    return G.FactGraph(chunks, units, entities, edges)


def toy_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth vector as a query that mentions its label."""
    q = _table(spark, d, "embeddings").where("vec_id % 20 = 0")
    vectors = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    return vectors, q.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("l"), F.col("label")).alias("name"))


def variant_graph(spark: SparkSession, d: str) -> G.FactGraph:
    """Two entities for each label, whose names differ in case only: A before B in the list for even labels, after it for odd
    ones.  Units of even numbers mention A, others B."""
    g = toy_graph(spark, d)
    v = _table(spark, d, "embeddings")
    labels = v.select(F.col("label").cast("long").alias("label")).distinct()
    made = labels.select("label", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("x"))
    name = F.concat(F.when(F.col("x") == "A", "L").otherwise("l"), F.col("label"))
    later = F.when(F.col("x") == "A", F.col("label") % 2).otherwise(1 - F.col("label") % 2)
    entities = made.select(F.concat("x", "label").alias("entity_id"), (2 * F.col("label") + later).alias("entity_ord"), name.alias("name"), F.lower(name).alias("name_key"), F.lit("UNKNOWN").alias("entity_type"))
    edges = v.select(F.col("vec_id").cast("string").alias("ku_id"), F.lit(0).alias("pos"), F.concat(F.expr("if(vec_id % 2 = 0, 'A', 'B')"), F.col("label")).alias("entity_id"))
    return G.FactGraph(g.chunks, g.units, entities, edges)


@query
def edges_build(spark: SparkSession, d: str) -> DataFrame:
    return toy_graph(spark, d).edges


@query
def rare_entity_filter(spark: SparkSession, d: str) -> DataFrame:
    g = toy_graph(spark, d)
    entities, edges = G.filter_rare(g.entities, g.edges, 40)
    return edges.join(entities.select("entity_id", "name"), "entity_id").select("ku_id", "pos", "name")


@query
def ku_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    g = toy_graph(spark, d)
    return G.unit_entity_lists(g.units.drop("entity_ids"), g.edges).select("ku_id", F.array_join("entity_ids", ",").alias("entity_ids"))


@query
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(toy_graph(spark, d))


@query
def lookup_entity_by_name(spark: SparkSession, d: str) -> DataFrame:
    _, mentions = toy_queries(spark, d)
    return G.entities_by_name(variant_graph(spark, d).entities, mentions).select("query_id", "entity_id")


@query
def kus_for_entity(spark: SparkSession, d: str) -> DataFrame:
    g, (_, mentions) = toy_graph(spark, d), toy_queries(spark, d)
    asked = G.entities_by_name(g.entities, mentions).select("entity_id").distinct()
    return g.edges.join(asked, "entity_id").select("entity_id", "ku_id")


@query
def entities_for_ku(spark: SparkSession, d: str) -> DataFrame:
    g, (q, _) = toy_graph(spark, d), toy_queries(spark, d)
    return g.edges.join(q.select(F.col("query_id").cast("string").alias("ku_id")), "ku_id").select("ku_id", "pos", "entity_id")


def _scan(spark: SparkSession, d: str, k: int | None, only: str = "true") -> DataFrame:
    q, _ = toy_queries(spark, d)
    return top_k_scan(q.where(only), toy_graph(spark, d).units, k)


@query
def cosine_score(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, None).select("query_id", "ku_id", F.round("score", 9).alias("score"))


@query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, 10, "query_id = 0").select("rank", "ku_id", F.round("score", 9).alias("score"))


@query
def cosine_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, 10).select("query_id", "rank", "ku_id", F.round("score", 9).alias("score"))


@query
def entity_anchor(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.entity_anchors(variant_graph(spark, d), toy_queries(spark, d)[1]).select("query_id", "entity_id", "ku_id")


@query
def semantic_anchor(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.semantic_anchors(toy_graph(spark, d), toy_queries(spark, d)[0], 5).select("query_id", "ku_id", F.round("score", 9).alias("score"))


def _seeds(spark: SparkSession, d: str, scratch: Scratch) -> tuple[G.FactGraph, DataFrame, DataFrame]:
    g, (q, _) = toy_graph(spark, d), toy_queries(spark, d)
    return g, q, scratch.save(retrieval.semantic_anchors(g, q, 10).select("query_id", "ku_id"))


@query
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    g, (q, m) = toy_graph(spark, d), toy_queries(spark, d)
    return retrieval.all_seeds(Scratch(spark), g, m, retrieval.semantic_anchors(g, q, 10))


@query
def expand_hop(spark: SparkSession, d: str) -> DataFrame:
    g, _, seeds = _seeds(spark, d, Scratch(spark))
    return retrieval.expand(seeds, g.edges, seeds)


@query
def vector_query_update(spark: SparkSession, d: str) -> DataFrame:
    g, q, seeds = _seeds(spark, d, Scratch(spark))
    moved = retrieval.update_queries(q, seeds, g.units, 1.0)
    return moved.select("query_id", F.posexplode("query_vector").alias("place", "x")).select("query_id", "place", F.round("x", 9).alias("x"))


@query
def traverse_qiter(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    g, q, seeds = _seeds(spark, d, scratch)
    return retrieval.traverse(scratch, g, q, seeds)


def _scored(spark: SparkSession, d: str) -> tuple[G.FactGraph, DataFrame, DataFrame]:
    scratch = Scratch(spark)
    g, q, seeds = _seeds(spark, d, scratch)
    found = scratch.save(retrieval.traverse(scratch, g, q, seeds))
    return g, found, scratch.save(retrieval.score_units(g, found, q))


def _items(items: DataFrame) -> DataFrame:
    return items.select("query_id", "rank", F.round("score", 9).alias("score"), "source_chunk_id", "content", F.array_join("knowledge_unit_ids", ",").alias("kus"), F.array_join("entity_names", ",").alias("names"))


@query
def rank_kus(spark: SparkSession, d: str) -> DataFrame:
    return _items(retrieval.rank_units(_scored(spark, d)[2], 6))


def _ranked(spark: SparkSession, d: str, how: str) -> DataFrame:
    g, _, scored = _scored(spark, d)
    return _items(retrieval.rank_chunks(g, scored, 6, how))


@query
def rank_chunks_mean(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "mean")


@query
def rank_chunks_max(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "max")


@query
def rank_chunks_sum(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "sum")


@query
def rank_content_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Half of the chunks are missing: their items hold the units' contents."""
    g, _, scored = _scored(spark, d)
    part = G.FactGraph(g.chunks.where("chunk_ord % 2 = 0"), g.units, g.entities, g.edges)
    return _items(retrieval.rank_chunks(part, scored, 6))


@query
def result_stats(spark: SparkSession, d: str) -> DataFrame:
    g, found, scored = _scored(spark, d)
    return retrieval.retrieval_stats(found, scored, retrieval.rank_chunks(g, scored, 6))


@query
def storage_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Edges saved twice: first those of every third unit, then all, twice over."""
    edges = toy_graph(spark, d).edges
    stored = edges.where("cast(ku_id as bigint) % 3 = 0")
    added = new_rows(stored, edges.unionByName(edges), ["ku_id", "entity_id"])
    return stored.withColumn("run", F.lit(1)).unionByName(added.withColumn("run", F.lit(2))).select("ku_id", "entity_id", "run")


@query
def search_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Anchors by name and vector, two hops, and the best chunks, for all queries in one plan."""
    vectors, mentions = toy_queries(spark, d)
    items, _ = RetrievePipeline(spark, toy_graph(spark, d), None, None).search_vectors(Scratch(spark), vectors, mentions)
    return _items(items)


ORACLES: dict[str, str] = catalog_sql.oracles()
