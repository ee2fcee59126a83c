"""The graph engine's operators on hand-made rows, with the method's special cases."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom import LoomConfig
from factloom.functions.text import CAPITALISED, STOPWORDS, WORD, py_strip
from factloom.functions.vectors import cosine, subtract_scaled, top_k_scan
from factloom.models import HashEmbedding, HuggingFaceEmbedding, OpenAILLM, RuleModel, TextModel, VectorModel
from factloom.operators import graph as G
from factloom.operators import linking, ner, retrieval, vocabulary
from factloom.operators.chunking import chunk_documents, pack_sentences, split_recursively, with_overlap
from factloom.operators.extraction import entities_from_units, filter_terms, parse_entities, parse_facts, parse_query, parse_replies
from factloom.sources.documents import from_list, from_turns
from factloom.sources.scratch import Scratch


def chunks_of(spark, texts, **config):
    rows = chunk_documents(from_list(spark, texts), LoomConfig(**config)).orderBy("chunk_ord").collect()
    return [(r["doc_id"], r["index"], r["content"]) for r in rows]


def test_document_forms(spark):
    rows = from_list(spark, ["a", {"text": "b", "doc_id": "x", "metadata": {}}, {"doc_id": "y"}, {"text": "c"}, 5]).orderBy("doc_ord").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [("doc-0", "a"), ("x", "b"), ("y", ""), ("doc-3", "c"), ("doc-4", "5")]


def test_turns_become_documents(spark):
    t = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "conv_id long, turn long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in from_turns(t).collect()) == [("1", "a\nb"), ("2", "c")]


@pytest.mark.parametrize("size,overlap", [(4, 1), (3, 0), (2, 5), (10, 9)])
def test_fixed_windows_are_slices(spark, size, overlap):
    text, step = "abc  defgh", max(1, size - overlap)
    want = [("doc-0", i, text[s : s + size]) for i, s in enumerate(range(0, len(text), step)) if text[s : s + size].strip()]
    assert chunks_of(spark, [text, "", "  \n"], chunk_strategy="fixed", chunk_size=size, chunk_overlap=overlap) == want


def test_blank_pieces_leave_gaps(spark):
    got = chunks_of(spark, ["aaaa    bbbb"], chunk_strategy="fixed", chunk_size=4, chunk_overlap=0)
    assert got == [("doc-0", 0, "aaaa"), ("doc-0", 2, "bbbb")]


def test_sentences_are_packed():
    assert pack_sentences("One. Two! Three? Four.", 10, 0) == ["One. Two!", "Three?", "Four."]
    assert pack_sentences("A long sentence stays. B.", 5, 3) == ["A long sentence stays.", "ys.B."]
    assert with_overlap(["abc", "de", "f"], 2) == ["abc", "bcde", "def"] and with_overlap(["abc", "d"], 0) == ["abc", "d"]


def test_recursive_split_loses_separators_and_repeats_overlaps():
    assert split_recursively("", 5, 1) == []
    assert split_recursively("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert split_recursively("abcdefgh", 3, 0) == ["abc", "def", "gh"]
    # the last piece gets an overlap at ". ", again at the newline level and again at the paragraph level
    assert split_recursively("x\n\naaaa. bbbb", 5, 1) == ["x", "xaaaa", "aaabbbb"]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunk_documents(from_list(spark, ["a"]), LoomConfig(chunk_strategy="custom"))


def test_strip_is_python_strip(spark):
    texts = ["  a\n", " b ", "c d", "", "\t"]
    got = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", py_strip(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [t.strip() for t in texts]


TEXTS = ["The Red Hat Linux team and the Red Hat group. A new api-v2.1 of red hat.", "Iechä Übel Foo\nBar foo bar Foo Bar. I am", "alpha beta. Alpha BETA alpha beta gamma"]


def expected_counts(texts):
    counts, order = {}, []
    for t in texts:
        caps = [p for p in re.findall(CAPITALISED.replace("(?U)", ""), t) if p.lower() not in STOPWORDS and len(p) > 1]
        words = [w for w in re.findall(WORD.replace("(?U)", ""), t) if w.lower() not in STOPWORDS and len(w) > 1]
        grams = [" ".join(words[j : j + n]) for n in (1, 2, 3) for j in range(len(words) - n + 1)]
        for x in caps + [g for g in grams if len(g) > 2]:
            if x not in counts:
                order.append(x)
            counts[x] = counts.get(x, 0) + 1
    return sorted((x for x in order if counts[x] >= 2), key=lambda x: -counts[x]), counts


def test_vocabulary_counts_and_order(spark):
    assert len(STOPWORDS) == 113
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "chunk_id string, chunk_ord long, content string")
    got = vocabulary.vocabulary_terms(chunks).orderBy(F.desc("freq"), "first_at").collect()
    order, counts = expected_counts(TEXTS)
    assert [(r["term"], r["freq"]) for r in got] == [(x, counts[x]) for x in order]
    index = {r["name_key"]: r["name"] for r in vocabulary.name_index(vocabulary.terms_as_entities(vocabulary.vocabulary_terms(chunks))).collect()}
    assert index == {x.lower(): x for x in order}  # the last spelling in order


def test_sentence_units(spark):
    chunks = spark.createDataFrame([("c", 1, " A first sentence here.\nShort. And the third one!  x")], "chunk_id string, chunk_ord long, content string")
    assert [r["content"] for r in vocabulary.sentence_units(chunks).orderBy("ku_ord").collect()] == ["A first sentence here.", "And the third one!"]


def expected_links(texts, names, per_block):
    ordered = sorted(names, key=len, reverse=True)
    out = []
    for t in texts:
        seen = {}
        for b in range(0, len(ordered), per_block):
            block = ordered[b : b + per_block]
            for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, block)) + r")\b", t, re.IGNORECASE):
                seen.setdefault(m.group().lower())
        out.append(list(seen))
    return out


@pytest.mark.parametrize("per_block", [2, 3, 2000])
def test_links_equal_a_regex_scan(spark, per_block, monkeypatch):
    monkeypatch.setattr(linking, "PER_BLOCK", per_block)
    names = ["red hat", "red hat linux", "hat", "linux team of the north", "foo bar", "foo", "api-v2.1", "bar foo bar", "iech", "a.b.c", "one two three four five", "two three"]
    rng = random.Random(1)
    parts = names + ["Red", "HAT", "linux", "Iechä", ",", "fooß", "x", "One Two Three Four Five", "north"]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(12)) for _ in range(60)]
    units = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ku_id string, content string")
    table = spark.createDataFrame([(n, n, 1, i) for i, n in enumerate(names)], "name_key string, entity_id string, freq long, first_at long")
    ranked = linking.ranked_names(Scratch(spark), table)
    assert [r["name_key"] for r in ranked.orderBy("rank").collect()] == sorted(names, key=len, reverse=True)
    want = expected_links(texts, names, per_block)

    def lists(edges):
        out = [[] for _ in texts]
        for r in edges.orderBy("pos").collect():
            out[int(r["ku_id"])].append(r["entity_id"])
        return out

    assert lists(linking.link_spans(Scratch(spark), units, ranked)) == want
    if per_block == 2000:
        assert lists(linking.link_regex(units, ranked)) == want
    else:
        with pytest.raises(ValueError):
            linking.link_regex(units, ranked, per_block)


def test_linking_takes_time_in_proportion_to_a_sentence(spark):
    names = spark.createDataFrame([(w, w, 2, i) for i, w in enumerate(f"w{k} v{k}" for k in range(50))], "name_key string, entity_id string, freq long, first_at long")
    ranked = linking.ranked_names(Scratch(spark), names)

    def took(n):
        text = " ".join(f"w{k % 50} v{k % 50}" for k in range(n // 2))
        edges = linking.link_spans(Scratch(spark), spark.createDataFrame([("u", text)], "ku_id string, content string"), ranked)
        begun = time.time()
        assert edges.count() == 50
        return time.time() - begun

    took(2_000)
    assert took(80_000) < 12 * max(took(8_000), 0.5)


def test_candidates_of_a_parsed_text():
    from types import SimpleNamespace as Of

    doc = Of(ents=[Of(text=" Nordlys "), Of(text="7"), Of(text="x")], noun_chunks=[Of(text="the Aurora Lamp"), Of(text="An ox"), Of(text="12345"), Of(text="those kettles")])
    assert ner.candidate_names(doc) == ["Nordlys", "Aurora Lamp", "kettles"]


def test_given_sentences_are_taken(spark):
    chunks = spark.createDataFrame([("c", 1, "x", ["  a given sentence ", "short"])], "chunk_id string, chunk_ord long, content string, sentences array<string>")
    got = vocabulary.sentence_units(chunks).collect()
    assert [(r["content"], r["extraction_method"]) for r in got] == [("a given sentence", "sentence_split")]


def test_reply_parsers():
    good = {"knowledge_units": [{"content": "A", "entities": ["x", 1]}, {"entities": []}, "no", {"content": None}]}
    want = [{"content": "A", "entities": ["x", "1"]}, {"content": "None", "entities": []}]
    for reply in (json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "Sure: " + json.dumps(good) + " done"):
        assert parse_facts(reply) == want
    assert parse_facts("nothing") == [] and parse_facts("{bad}") == [] and parse_facts('{"knowledge_units": 5}') == []
    assert parse_facts('{"knowledge_units": [{"content": "x", "entities": "ab"}]}') == [{"content": "x", "entities": ["a", "b"]}]
    with pytest.raises(AttributeError):
        parse_facts("[1]")
    with pytest.raises(TypeError):
        parse_facts('{"knowledge_units": [{"content": "x", "entities": null}]}')
    assert parse_entities('{"entities": [{"name": " A "}, {"type": "X"}, {"name": "b", "type": "ORG"}]}') == [{"name": "A", "type": "UNKNOWN"}, {"name": "b", "type": "ORG"}]
    assert parse_query('so {"entities": ["a", "", null, 3]} ok') == ["a", "3"] and parse_query("[]") == [] and parse_query('{"entities": null}') == []


def test_faulty_replies_have_no_facts(spark):
    rows = [("a", '{"knowledge_units": [{"content": "one"}, {"content": "two"}]}'), ("b", "[1]"), ("c", None), ("d", '{"knowledge_units": [{"content": "x", "entities": null}]}')]
    got = parse_replies(spark.createDataFrame(rows, "k string, r string"), "k", "r", 1).collect()
    assert [(r["k"], r["content"]) for r in got] == [("a", "one")]


def test_entities_keep_the_first_spelling(spark):
    units = spark.createDataFrame([("u1", 1, [" Foo ", "", None, "foo"]), ("u2", 2, ["FOO", "Bar"])], "ku_id string, ku_ord long, raw_entities array<string>")
    entities, edges = entities_from_units(units)
    assert {(r["name_key"], r["name"]) for r in entities.collect()} == {("foo", "Foo"), ("bar", "Bar")}
    assert edges.count() == 4 and entities_from_units(units, merge=False)[0].count() == 4


def test_term_filter_keeps_first_spellings(spark):
    terms = spark.createDataFrame([("Foo", 9, 1), ("foo", 8, 2), ("Bar", 7, 3), ("baz", 7, 4), ("", 1, 5)], "term string, freq long, first_at long")
    got = filter_terms(Scratch(spark), terms, RuleModel(), LoomConfig(vocab_max_terms_per_llm_call=2)).collect()
    assert {(r["name"], r["entity_type"]) for r in got} == {("Foo", "CONCEPT"), ("Bar", "CONCEPT"), ("baz", "CONCEPT")}


@pytest.fixture(scope="module")
def graph(spark):
    """A unit without entity, an entity without unit, a repeated edge, equal names, an empty and a zero vector, a negative
    cosine, a tie, a missing chunk, and an island."""
    units = [("u1", 1, "c1", "one", [1.0, 0.0]), ("u2", 2, "c1", "two", [0.8, 0.6]), ("u3", 3, "c2", "three", [-1.0, 0.0]), ("u4", 4, "c2", "four", [0.8, 0.6]), ("u5", 5, "cX", "five", [0.6, 0.8]), ("u6", 6, "c3", "six", []), ("u7", 7, "c3", "seven", [0.0, 0.0]), ("u8", 8, "c3", "alone", [0.0, 1.0])]
    entities = [("e1", "Red", "red"), ("e2", "Blue", "blue"), ("e3", "BLUE", "blue"), ("e4", "Nothing", "nothing")]
    edges = [("u1", 0, "e1"), ("u2", 0, "e1"), ("u3", 0, "e1"), ("u2", 1, "e2"), ("u4", 0, "e2"), ("u5", 0, "e2"), ("u5", 1, "e2"), ("u6", 0, "e2"), ("u7", 0, "e1"), ("u4", 1, "e3")]
    return G.FactGraph(
        spark.createDataFrame([(c, i, "d", 0, f"text {c}") for i, c in enumerate(["c1", "c2", "c3"])], "chunk_id string, chunk_ord long, doc_id string, index int, content string"),
        spark.createDataFrame(units, "ku_id string, ku_ord long, chunk_id string, content string, embedding array<double>"),
        spark.createDataFrame([(*e, "UNKNOWN", [0.0], {"e2": 9, "e3": 4}.get(e[0], 1)) for e in entities], "entity_id string, name string, name_key string, entity_type string, embedding array<double>, entity_ord long"),
        spark.createDataFrame(edges, "ku_id string, pos int, entity_id string"),
    )


def test_lookups_and_stats(graph):
    assert graph.stats() == {"chunks": 3, "knowledge_units": 8, "entities": 4, "edges": 10}
    assert [r["entity_id"] for r in graph.entity_by_name("bLuE").collect()] == ["e2"] and graph.entity_by_name(" blue").isEmpty()
    assert sorted(r["ku_id"] for r in graph.units_of("e2").collect()) == ["u2", "u4", "u5", "u5", "u6"]
    assert graph.units_of("zz").isEmpty() and graph.entities_of("u8").isEmpty() and graph.unit("u1").count() == graph.chunk("c1").count() == graph.entity("e1").count() == 1


def test_rare_entities_count_repeated_edges(graph):
    entities, edges = G.filter_rare(graph.entities, graph.edges, 4)
    assert {r["entity_id"] for r in entities.collect()} == {"e1", "e2"} and edges.count() == 9
    lists = {r["ku_id"]: r["entity_ids"] for r in G.unit_entity_lists(graph.units, graph.edges).collect()}
    assert lists["u5"] == ["e2", "e2"] and lists["u4"] == ["e2", "e3"] and lists["u8"] == []


def test_vector_expressions(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = rows.select(cosine(F.col("a"), F.col("b")).alias("c"), subtract_scaled(F.col("a"), F.col("b"), 1.0).alias("m")).collect()
    assert got[0]["c"] == pytest.approx(0.8) and got[1]["c"] == 0
    assert got[0]["m"] == pytest.approx([-(0.5**0.5), 0.5**0.5])
    same = spark.createDataFrame([([3.0, 3.0], [3.0, 3.0])], "a array<double>, b array<double>")
    assert same.select(subtract_scaled(F.col("a"), F.col("b"), 1.0).alias("m")).first()["m"] == [0.0, 0.0]


def ask(spark, *vectors):
    return spark.createDataFrame([(i, list(v)) for i, v in enumerate(vectors)], "query_id int, query_vector array<double>")


def test_top_k_breaks_ties_by_id(spark, graph):
    got = top_k_scan(ask(spark, (1.0, 0.0), (0.0, 0.0)), graph.units, 4).orderBy("rank").collect()
    assert [r["ku_id"] for r in got] == ["u1", "u2", "u4", "u5"] and {r["query_id"] for r in got} == {0}
    assert top_k_scan(ask(spark), graph.units, 4).isEmpty()


def walk(spark, graph, seeds, vector=(1.0, 0.0), **config):
    s = spark.createDataFrame([(0, k) for k in seeds], "query_id int, ku_id string")
    return sorted(r["ku_id"] for r in retrieval.traverse(Scratch(spark), graph, ask(spark, vector), s, LoomConfig(**config)).collect())


def test_traversal(spark, graph):
    assert walk(spark, graph, ["u8"]) == ["u8"]  # an island stops at once
    assert walk(spark, graph, ["u1"], traversal_depth=1, beam_size=1) == ["u1", "u2"]
    assert walk(spark, graph, ["u1"], traversal_depth=1) == ["u1", "u2", "u3", "u7"]
    assert walk(spark, graph, ["u1"], traversal_depth=2) == ["u1", "u2", "u3", "u4", "u5", "u6", "u7"]
    assert walk(spark, graph, ["u2"], traversal_depth=1, beam_size=2) == ["u1", "u2", "u4"]
    assert walk(spark, graph, ["u2"], traversal_depth=1, beam_size=3, max_kus_per_depth=0) == ["u1", "u2"]  # one at least
    # the updated vector is zero: the second depth finds nothing
    assert walk(spark, graph, ["u1"], vector=(0.8, 0.6), traversal_depth=2, beam_size=1) == ["u1", "u2"]


def test_ranking(spark, graph):
    found = spark.createDataFrame([(0, f"u{i}") for i in range(1, 9)] + [(0, "gone")], "query_id int, ku_id string")
    scored = retrieval.score_units(graph, found, ask(spark, (1.0, 0.0)))
    assert {r["ku_id"]: round(r["score"], 6) for r in scored.collect()} == {"u1": 1, "u2": 0.8, "u4": 0.8, "u5": 0.6, "u7": 0, "u8": 0}
    best = retrieval.rank_units(scored, 3).orderBy("rank").collect()
    assert [(r["knowledge_unit_ids"], r["entity_names"]) for r in best] == [(["u1"], ["Red"]), (["u2"], ["Red", "Blue"]), (["u4"], ["Blue", "BLUE"])]

    def top(how):
        return [(r["source_chunk_id"], round(r["score"], 6), r["content"], r["knowledge_unit_ids"]) for r in retrieval.rank_chunks(graph, scored, 3, how).orderBy("rank").collect()]

    assert top("mean") == [("c1", 0.9, "text c1", ["u1", "u2"]), ("c2", 0.8, "text c2", ["u4"]), ("cX", 0.6, "five", ["u5"])]
    assert top("sum")[0][1] == 1.8 and top("max")[0][1] == 1 and top("median") == top("mean")
    stats = retrieval.retrieval_stats(found, scored, retrieval.rank_chunks(graph, scored, 3)).first()
    assert (stats["kus_retrieved"], stats["kus_scored"], stats["items_returned"]) == (9, 6, 3)
    assert retrieval.score_units(graph, found, ask(spark, (1.0, 0.0)), least=0.7).count() == 3


def test_anchors(spark, graph):
    mentions = spark.createDataFrame([(0, "RED"), (0, "red"), (0, "nothing"), (0, "none")], "query_id int, name string")
    by_name = retrieval.entity_anchors(graph, mentions)
    assert sorted(((r["entity_id"], r["ku_id"]) for r in by_name.collect()), key=repr) == sorted([("e1", "u1"), ("e1", "u2"), ("e1", "u3"), ("e1", "u7"), ("e4", None)], key=repr)
    near = retrieval.semantic_anchors(graph, ask(spark, (0.0, 1.0)), 2)
    assert sorted(r["ku_id"] for r in retrieval.seed_union(by_name, near).collect()) == ["u1", "u2", "u3", "u5", "u7", "u8"]


def test_models():
    e = HashEmbedding(8)
    assert e.embed_batch([]) == [] and e.embed_text("") == [0.0] * 8 and sum(x * x for x in e.embed_text("a b c")) == pytest.approx(1)
    assert isinstance(e, VectorModel) and isinstance(RuleModel(), TextModel)
    assert HuggingFaceEmbedding().embed_batch([]) == []
    with pytest.raises(ImportError):
        OpenAILLM(api_key="k").generate("x")
