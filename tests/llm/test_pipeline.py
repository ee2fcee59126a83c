"""The pipeline's stages, each against what it should keep, and the registered queries' shapes."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
import __spark_entry__
from factloom.llm.queries import ORACLES, QUERIES

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_similar int, kept string"


def rows():
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    out = [(i, fresh(rng.randrange(30, 90))) for i in range(120)]
    base = fresh(80).split()
    near = [(200 + k, " ".join(base[:-1] + [f"end{k}"])) for k in range(6)]
    same = fresh(50)
    return out + near + [(300 + k, same) for k in range(5)] + [(400, None), (401, ""), (402, "12 34 !!"), (403, fresh(3000)), (304, same), (None, fresh(40))]


def stages(spark, tmp_path, data):
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else "fr", f"s{k % 4}" if k % 9 else None, 1, 2, "z") for k, (i, t) in enumerate(data)], KIND)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / str(k)))
        docs = stage(spark, spark.read.parquet(str(tmp_path / str(k))), str(tmp_path))
        yield name, docs


def test_stages_keep_what_they_should(spark, tmp_path):
    data = rows()
    seen = {}
    for name, docs in stages(spark, tmp_path, data):
        got = docs.collect()
        seen[name] = [r["doc_id"] for r in got]
        if name != "sentencepiece":
            assert docs.columns == [c.split()[0] for c in KIND.split(", ")]
            texts = {i: t for i, t in data}
            assert all(r["text"] == texts[r["doc_id"]] for r in got)
    ids = [i for i, _ in data]
    one = [i for i in ids if i not in (400, 401, 402)]
    assert sorted(seen["language_id"], key=repr) == sorted(one, key=repr)
    two = [i for i in one if i not in (300, 301, 302, 303)]
    two.remove(304)  # one of the two equal rows
    assert sorted(seen["exact_dedup"], key=repr) == sorted(two, key=repr)
    three = [i for i in two if i not in range(201, 206)]
    assert sorted(seen["near_dedup"], key=repr) == sorted(three, key=repr)
    four = seen["mixing"]
    assert set(four) <= set(three) and max(four.count(i) for i in four) <= 2 and len(four) > len(three)
    assert sorted(seen["sentencepiece"], key=repr) == sorted(four, key=repr)


def test_mixing_keeps_long_documents_to_their_sources_targets(spark):
    text = " ".join(["word"] * 1000)
    docs = spark.createDataFrame([(i, text, "en", f"s{i % 3}", 1, 2, "z") for i in range(900)], KIND)
    got = corpus_pipeline.mixing(spark, docs, "").groupBy("source").count().collect()
    # 1.5 times all words in the proportion 3 : 1 : 2, of which the first source may give 2 times its own
    for r in got:
        assert abs(r["count"] / 300 - {"s0": 2, "s1": 2.5 / 3, "s2": 5 / 3}[r["source"]]) < 0.08, got
    assert len(got) == 3


def test_pipeline_of_nothing(spark, tmp_path):
    assert all(docs.collect() == [] for _, docs in stages(spark, tmp_path, []))


def test_run_applies_all_stages(spark, tmp_path):
    data = spark.createDataFrame([(i, t, "en", "s", 1, 2, "z") for i, t in rows()[:40]], KIND)
    data.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("round_trip").count() == out.count() > 40


def test_registered_names():
    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want and want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_whole_table(spark, name):
    table = "embeddings" if name.startswith("op3") else "documents"
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    out = QUERIES[name](spark, DATA)
    key = out.columns[0]
    if name.startswith("op4"):  # passages, of documents of the table
        assert out.join(rows, key, "left_anti").isEmpty() and not out.isEmpty()
    else:
        assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_each_stage_begins_with_a_collected_heap(spark, tmp_path):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() > before
