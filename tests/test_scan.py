"""Scans of all rows by blocks of queries: equal to brute force however they are cut, in bounded memory, without lists of all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from factloom import LoomConfig, RetrievePipeline
from factloom.functions import scan
from factloom.operators import graph as G
from factloom.operators import retrieval
from factloom.sources.scratch import Scratch


def batches(ids, vectors, entities=None, size=50):
    for b in range(0, len(ids), size):
        columns = {"ku_id": pa.array(ids[b : b + size]), "embedding": pa.array([list(v) for v in vectors[b : b + size]], pa.list_(pa.float64()))}
        if entities is not None:
            columns["entity_ids"] = pa.array(entities[b : b + size], pa.list_(pa.string()))
        yield pa.record_batch(columns)


@pytest.mark.parametrize("rows,cells", [(4096, 1 << 20), (7, 30), (50, 120)])
def test_tiles_equal_brute_force(rows, cells, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", rows)
    monkeypatch.setattr(scan, "CELLS", cells)
    rng = np.random.default_rng(1)
    x, q = np.round(rng.normal(size=(230, 3)), 1), np.round(rng.normal(size=(17, 3)), 1)
    x[5] = 0
    x[100:130] = x[:30]  # ties
    ids = [f"u{i}" for i in rng.permutation(230)]
    entities = [[f"e{j}" for j in rng.choice(9, rng.integers(0, 4), replace=False)] for _ in ids]
    reach = [[f"e{j}" for j in rng.choice(12, rng.integers(0, 4), replace=False)] for _ in q]
    seen = [[ids[j] for j in rng.choice(230, 6, replace=False)] + ["none"] for _ in q]
    block = scan.Block(list(range(17)), q.tolist(), {"reach": reach, "seen": seen})

    def cells_of(tile):
        return tile.scores(), tile.mark(tile.sharing("reach"), "seen", False), tile.ids

    size = np.sqrt((x * x).sum(1))
    score = x / np.where(size > 0, size, 1)[:, None] @ (q / np.sqrt((q * q).sum(1))[:, None]).T
    want, all_pairs = [], set()
    for c in range(17):
        ok = [r for r in range(230) if set(entities[r]) & set(reach[c]) and ids[r] not in seen[c]]
        all_pairs |= {(c, ids[r]) for r in ok}
        want += [(c, ids[r]) for r in sorted(ok, key=lambda r: (-round(score[r, c], 12), ids[r]))[:5]]
    work = scan.best_rows(pa.int64(), "query_id", "ku_id", 5, cells_of)
    got = [(r["query_id"], r["ku_id"]) for b in work(block, batches(ids, x, entities)) for r in b.to_pylist()]
    assert got == want
    some = scan.pairs(pa.int64(), "query_id", "ku_id", lambda t: t.mark(t.sharing("reach"), "seen", False))
    listed = [(r["query_id"], r["ku_id"]) for b in some(block, batches(ids, x, entities)) for r in b.to_pylist()]
    assert len(listed) == len(all_pairs) and set(listed) == all_pairs


def test_memory_does_not_grow_with_queries():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(10_000, 8)), rng.normal(size=(4_000, 8))
    block = scan.Block(list(range(len(q))), q.tolist(), {})
    given = list(batches([str(i) for i in range(len(x))], x, size=10_000))
    for work in (scan.best_rows(pa.int64(), "query_id", "ku_id", 10, lambda t: (t.scores(), t.every(), t.ids)), scan.all_scores(pa.int64(), "query_id", "ku_id")):
        tracemalloc.start()
        n = sum(b.num_rows for b in work(block, given))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n in (40_000, 40_000_000) and peak < 100e6  # all scores at once take 320 MB


def test_groups_are_not_cut(monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 4)
    key = [0] * 3 + [1] * 9 + [2] + [3] * 5
    given = [pa.record_batch({"k": pa.array(key[b : b + 6])}) for b in range(0, len(key), 6)]
    out = [b["k"].to_pylist() for b in scan.whole_groups(iter(given), "k")]
    assert sum(out, []) == key and all(not set(a) & set(b) for a, b in zip(out, out[1:]))


@pytest.fixture(scope="module")
def hot(spark):
    """Two entities that nearly all units have, units without any, and chunks of three units."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 4)), 2)
    units = [(f"u{i}", i, f"c{i // 3}", f"fact {i}", x[i].tolist()) for i in range(150)]
    edges = [(f"u{i}", 0, f"e{i % 2}") for i in range(140)] + [(f"u{i}", 1, f"r{i % 11}") for i in range(0, 150, 4)]
    names = sorted({e for *_, e in edges})
    graph = G.FactGraph(
        spark.createDataFrame([(f"c{i}", i, "d", 0, f"text {i}") for i in range(40)], "chunk_id string, chunk_ord long, doc_id string, index int, content string"),
        spark.createDataFrame(units, "ku_id string, ku_ord long, chunk_id string, content string, embedding array<double>"),
        spark.createDataFrame([(e, i, e.upper(), e, "UNKNOWN") for i, e in enumerate(names)], "entity_id string, entity_ord long, name string, name_key string, entity_type string"),
        spark.createDataFrame(edges, "ku_id string, pos int, entity_id string"),
    )
    queries = spark.createDataFrame([(i, v) for i, v in enumerate([*np.round(rng.normal(size=(6, 4)), 2).tolist(), [0.0] * 4])], "query_id int, query_vector array<double>")
    mentions = spark.createDataFrame([(0, "e0"), (1, "E1"), (1, "r3"), (2, "r5"), (6, "r1"), (3, "nobody")], "query_id int, name string")
    return graph, queries, mentions


@pytest.mark.parametrize("config,block_bytes", [({}, 400), ({"score_aggregation": "sum", "min_score_threshold": 0.2}, 16_000_000), ({"group_by_chunk": False, "traversal_depth": 1}, 16_000_000)])
def test_search_equals_listed_units(spark, hot, config, block_bytes, monkeypatch):
    """The scan's items and counts are those of the method applied to lists of all seeds and all collected units."""
    graph, queries, mentions = hot
    config = LoomConfig(anchor_top_k=3, beam_size=4, result_top_n=3, **config)
    scratch = Scratch(spark)
    seeds = scratch.save(retrieval.seed_union(retrieval.entity_anchors(graph, mentions), retrieval.semantic_anchors(graph, queries, 3)))
    found = scratch.save(retrieval.traverse(scratch, graph, queries, seeds, config))
    scored = scratch.save(retrieval.score_units(graph, found, queries, config.min_score_threshold))
    want = retrieval.rank_chunks(graph, scored, 3, config.score_aggregation) if config.group_by_chunk else retrieval.rank_units(scored, 3)
    counts = retrieval.retrieval_stats(found, scored, want)
    monkeypatch.setattr(scan, "QUERY_BYTES", block_bytes)
    items, stats = RetrievePipeline(spark, graph, None, None, config).search_vectors(Scratch(spark), queries, mentions)

    def rows(t):
        return sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in t.collect())

    assert rows(items) == rows(want) and rows(stats) == rows(counts) and len(rows(stats)) == 7 - (config.min_score_threshold > 0)


def test_seeds_are_the_union(spark, hot):
    graph, queries, mentions = hot
    near = retrieval.semantic_anchors(graph, queries, 3)
    want = sorted(map(tuple, retrieval.seed_union(retrieval.entity_anchors(graph, mentions), near).collect()))
    assert sorted(map(tuple, retrieval.all_seeds(Scratch(spark), graph, mentions, near).collect())) == want


def test_what_a_hop_reaches_is_not_shuffled(spark, hot):
    """The pairs of query and unit, whose number grows with the square of the table, leave the tasks that make them as the result."""
    graph, queries, _ = hot
    seeds = Scratch(spark).save(retrieval.semantic_anchors(graph, queries, 3).select("query_id", "ku_id"))
    hop = retrieval.expand(seeds, graph.edges, seeds)
    plan = hop._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    pairs = graph.edges.select("ku_id", "entity_id").distinct()
    want = seeds.join(pairs, "ku_id").select("query_id", "entity_id").join(pairs, "entity_id").select("query_id", "ku_id").distinct().join(seeds, ["query_id", "ku_id"], "left_anti")
    assert sorted(map(tuple, hop.collect())) == sorted(map(tuple, want.collect())) and hop.count() == hop.distinct().count() > 100
