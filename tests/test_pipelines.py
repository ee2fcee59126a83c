"""Both pipelines end to end with offline models, storage, settings, streaming, and the queries against DuckDB."""

import importlib
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom import IndexPipeline, LoomConfig, RetrievePipeline, SearchResult, catalog
from factloom.models import HashEmbedding, RuleModel
from factloom.operators.retrieval import entity_anchors
from factloom.sources.documents import from_table
from factloom.sources.storage import JdbcStorage, JsonStorage, TableStorage, from_dict, to_dict
from factloom.streaming.incremental import index_stream

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations".split()
DOCS = [
    {"doc_id": "lamp", "text": "Aurora Lamp\n\nThe Aurora Lamp is made by Nordlys Works. It costs 40 crowns and runs on the Heliox Cell.\nNordlys Works tests each Aurora Lamp for a week. The Heliox Cell lasts nine years."},
    {"doc_id": "kettle", "text": "Borealis Kettle\n\nThe Borealis Kettle is made by Nordlys Works too. It costs 60 crowns.\nThe Borealis Kettle has the Arctic Seal of the Polar Board. The Polar Board checks kettles each spring."},
    {"doc_id": "boat", "text": "Cirrus Boat\n\nThe Cirrus Boat is built by Fjord Yard. It uses the Heliox Cell for its light.\nFjord Yard holds the Arctic Seal as well. The Cirrus Boat carries six persons."},
]
QUESTIONS = ["What does the Aurora Lamp run on?", "How do the prices of the Aurora Lamp and the Borealis Kettle compare?", "Which products have the Arctic Seal?"]


def build(spark, method, **config):
    return IndexPipeline(spark, RuleModel(), HashEmbedding(), LoomConfig(ku_extraction_method=method, chunk_size=120, chunk_overlap=20, vocab_min_term_freq=2, **config)).run(DOCS)


@pytest.mark.parametrize("method", ["sentence", "vocabulary", "llm"])
def test_index_and_search(spark, method, tmp_path):
    graph = build(spark, method, result_top_n=3)
    stats = graph.stats()
    assert stats["chunks"] >= 3 and stats["knowledge_units"] >= 5 and stats["entities"] >= 3 and stats["edges"] >= 5
    assert all(len(r["embedding"]) == 64 for r in graph.units.collect())
    edges = {(r["ku_id"], r["entity_id"]) for r in graph.edges.collect()}
    assert {k for k, _ in edges} <= {r["ku_id"] for r in graph.units.collect()} and {e for _, e in edges} <= {r["entity_id"] for r in graph.entities.collect()}
    for question in QUESTIONS:
        result = RetrievePipeline(spark, graph, RuleModel(), HashEmbedding(), LoomConfig(result_top_n=3)).search(question)
        assert 1 <= len(result.items) <= 3 and result.items[0].score > 0 and result.graph_stats["items_returned"] == len(result.items)
        scores = [i.score for i in result.items]
        assert scores == sorted(scores, reverse=True)
        path = tmp_path / "r.json"
        data = json.loads(result.to_json(path))
        assert list(data) == ["query", "entities_extracted", "graph_stats", "items"] and SearchResult.from_dict(json.loads(path.read_text())) == result


def test_search_without_anchor(spark):
    empty = IndexPipeline(spark, None, HashEmbedding(), LoomConfig(ku_extraction_method="sentence")).run(["  ", ""])
    result = RetrievePipeline(spark, empty, RuleModel(), HashEmbedding()).search("Aurora Lamp?")
    assert result.items == [] and result.graph_stats == {} and result.entities_extracted == ["Aurora Lamp"]


def test_ids_do_not_change(spark):
    one, two = build(spark, "sentence"), build(spark, "sentence")
    for name in ("chunks", "units", "entities", "edges"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(two, name).collect()))


def test_storage_round_trip(spark, tmp_path):
    graph = build(spark, "sentence")
    tables, single = TableStorage(spark, str(tmp_path / "t")), JsonStorage(spark, tmp_path / "deep" / "g.json")
    assert not tables.exists() and not single.exists()
    tables.save(graph)
    tables.save(graph)  # nothing is new
    single.save(graph)
    assert tables.exists() and single.exists()
    distinct = {**graph.stats(), "edges": graph.edges.select("ku_id", "entity_id").distinct().count()}
    assert tables.load().stats() == distinct and single.load().stats() == graph.stats()
    assert sorted(map(str, single.load().units.collect())) == sorted(map(str, tables.load().units.collect()))
    again = from_dict(spark, json.loads(json.dumps(to_dict(graph))))
    for name in ("chunks", "units", "entities", "edges"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(single.load(), name).collect()))
    notes = [r["metadata"] for r in graph.units.collect()]
    assert all(n["extraction_method"] == "regex_split" for n in notes) and sum(int(n["matched_entities"]) for n in notes) == distinct["edges"]


def test_postgresql_statements(spark):
    said, written = [], {}

    class Faked(JdbcStorage):
        def execute(self, statements):
            said.extend(statements)

        def write(self, table, name, mode):
            written[name] = table.columns, table.count(), dict(table.dtypes)

    graph = build(spark, "sentence")
    Faked(spark, "jdbc:postgresql://host/base", "facts").save(graph)
    assert said[0] == "CREATE SCHEMA IF NOT EXISTS facts"
    assert any('"embedding" FLOAT8[]' in x and 'PRIMARY KEY ("ku_id")' in x for x in said) and any('PRIMARY KEY ("ku_id", "entity_id")' in x for x in said)
    names = {n.rsplit("_", 1)[0]: n for n in written}
    assert set(names) == {"chunks", "units", "entities", "edges"} and written[names["units"]][2]["metadata"] == "string"
    for short, long in names.items():
        insert = next(x for x in said if x.startswith(f"INSERT INTO facts.{short} "))
        assert insert.endswith(f"FROM facts.{long} ON CONFLICT DO NOTHING") and f"DROP TABLE facts.{long}" in said
    assert written[names["chunks"]][1] == graph.stats()["chunks"]


def test_every_linked_name_anchors_to_its_units(spark):
    """Words in both spellings: whichever is rarer, a look-up by name leads to the entity that got the units."""
    words = [f"Quill{c}" for c in "abcdefghij"]
    # no other word comes twice, so no longer term takes a name's place
    forms = [(w, 2 + i % 3) for i, w in enumerate(words)] + [(w.lower(), 2 + (i + 1) % 3) for i, w in enumerate(words)]
    text = " ".join(f"ab{w}{k}c {w} de{w}{k}f." for w, n in forms for k in range(n))
    graph = IndexPipeline(spark, RuleModel(), HashEmbedding(), LoomConfig(ku_extraction_method="sentence", chunk_size=100_000)).run([text])
    found = entity_anchors(graph, spark.createDataFrame([(i, w.upper()) for i, w in enumerate(words)], "query_id int, name string"))
    units = {r["query_id"]: r["n"] for r in found.where("ku_id is not null").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert all(units.get(i, 0) >= (2 + i % 3) + (2 + (i + 1) % 3) for i in range(10)), units


@pytest.mark.parametrize("key", ["string", "bigint"])
def test_documents_of_any_key(spark, key):
    ids = ["x-1", "x-2"] if key == "string" else [2**62, -(2**62)]
    table = spark.createDataFrame([(i, DOCS[k]["text"], {"page": str(k)}) for k, i in enumerate(ids)], f"doc_id {key}, text string, metadata map<string,string>")
    graph = IndexPipeline(spark, None, HashEmbedding(), LoomConfig(ku_extraction_method="sentence")).run(from_table(table))
    rows = graph.chunks.collect()
    assert {r["doc_id"] for r in rows} == set(map(str, ids)) and {r["metadata"]["page"] for r in rows} == {"0", "1"} and graph.stats()["edges"] > 0


def test_settings(tmp_path, monkeypatch):
    config = LoomConfig(chunk_size=7, on_progress=print)
    assert "on_progress" not in config.to_dict() and len(config.to_dict()) == 32
    config.to_json(tmp_path / "c.json")
    assert LoomConfig.from_json(tmp_path / "c.json").chunk_size == 7
    (tmp_path / "c.yaml").write_text("beam_size: 3\nunknown: 1\n")
    assert LoomConfig.from_yaml(tmp_path / "c.yaml").beam_size == 3
    for name, value in {"BEAM_SIZE": "5", "GROUP_BY_CHUNK": "no", "QUERY_UPDATE_WEIGHT": "0.5", "SCORE_AGGREGATION": "max", "KU_EXTRACTION_PROMPT": "x"}.items():
        monkeypatch.setenv(f"FACTLOOM_{name}", value)
    got = LoomConfig.from_env()
    assert (got.beam_size, got.group_by_chunk, got.query_update_weight, got.score_aggregation, got.ku_extraction_prompt) == (5, False, 0.5, "max", None)


def test_faulty_settings(spark):
    with pytest.raises(ValueError):
        IndexPipeline(spark, config=LoomConfig(ku_extraction_method="magic"))
    with pytest.raises(ValueError):
        IndexPipeline(spark, config=LoomConfig(entity_extraction_method="magic"))
    with pytest.raises((KeyError, ValueError, IndexError)):
        RetrievePipeline(spark, None, None, None, LoomConfig(query_entity_prompt="{query} {"))


def test_progress_is_reported(spark):
    told = []
    build(spark, "sentence", on_progress=lambda now, total, stage: told.append((stage, now)))
    assert [s for s, _ in told] == ["chunks", "knowledge units", "entities"] and all(n for _, n in told)


def test_streamed_documents_are_added_once(spark, tmp_path):
    source, storage = tmp_path / "in", TableStorage(spark, str(tmp_path / "g"))
    config = LoomConfig(ku_extraction_method="sentence")

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        index_stream(spark, stream, storage, None, HashEmbedding(), config, str(tmp_path / "ck")).awaitTermination()
        return storage.load().stats()

    spark.createDataFrame([(1, DOCS[0]["text"])], "doc_id long, text string").write.mode("append").parquet(str(source))
    first = run()
    assert first["chunks"] >= 1 and run() == first
    spark.createDataFrame([(2, DOCS[1]["text"])], "doc_id long, text string").write.mode("append").parquet(str(source))
    assert run()["chunks"] > first["chunks"]


def _rows(frame):
    def plain(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in frame), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, DATA).collect()]
    assert got
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        found = con.execute(catalog.ORACLES[name])
        names = [c[0] for c in found.description]
        assert _rows(got) == _rows([dict(zip(names, r)) for r in found.fetchall()])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("factloom/llm", "tests/llm"), ("factloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_of_a_copy_without_the_corpus_operators(tmp_path, gone):
    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        at = tmp_path / "copy" / x
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True)
    names, sql = said.stdout.strip().split("\n")
    assert set(names.split()) == set(catalog.QUERIES) and set(sql.split()) == set(catalog.ORACLES)


def test_entry_without_the_optional_modules(monkeypatch):
    for gone in ("factloom.llm", "factloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    fresh = importlib.util.module_from_spec(importlib.util.find_spec("__spark_entry__"))
    fresh.__spec__.loader.exec_module(fresh)
    assert set(fresh.queries()) == set(catalog.QUERIES) and set(fresh.oracle_sql()) == set(catalog.ORACLES)
