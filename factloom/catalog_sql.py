"""The catalog's queries in DuckDB's SQL, put together from common table expressions."""

from __future__ import annotations

from .functions.text import CAPITALISED, STOPWORDS, WORD

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"
# word boundaries are ASCII here: other letters and digits become _, everything else that is not ASCII a space
_ASCII = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_CAPS, _WORD = (x.replace("(?U)", "") for x in (CAPITALISED, WORD))
_KEEP = f"lambda x: length(x) > 1 AND NOT list_contains({_STOP}, lower(x))"


def _sentences(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


#: chunks c (chunk_id, ord, content): whole documents, or windows of them.
WHOLE = "c AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id::HUGEINT AS ord, coalesce(text, '') AS content FROM documents)"
WINDOWS = f"""c AS (SELECT sha256(doc_id::VARCHAR || chr(1) || (s // 800)::VARCHAR) AS chunk_id, doc_id::HUGEINT * 16777216 + s // 800 AS ord, substr(text, s + 1, 1000) AS content
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents) WHERE {_strip('substr(text, s + 1, 1000)')} <> '')"""

#: occurrences occ (term, k, at) in c
OCCURRENCES = f"""
t AS (SELECT ord, list_filter(regexp_extract_all(a, '{_CAPS}'), {_KEEP}) AS caps, list_filter(regexp_extract_all(a, '{_WORD}'), {_KEEP}) AS words
      FROM (SELECT ord, {_ASCII.format('content')} AS a FROM c)),
occ AS (SELECT term, 0 AS k, ord * 67108864 + p AS spot FROM (SELECT ord, unnest(caps) AS term, generate_subscripts(caps, 1) AS p FROM t)
  UNION ALL SELECT term, n, ord * 67108864 + n * 16777216 + p FROM (
    SELECT ord, n, p, array_to_string(words[p : p + n - 1], ' ') AS term FROM (SELECT ord, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM t, (VALUES (1), (2), (3)) AS sizes(n)))
  WHERE length(term) > 2)"""


def _terms(least: str) -> str:
    return f"terms AS (SELECT term, count(*) AS freq, min(spot) AS first_at FROM occ GROUP BY term HAVING count(*) >= {least} AND length(term) > 1)"


#: sentence units ku (ku_id, chunk_id, content)
UNITS = f"""
ku AS (SELECT sha256(chunk_id || chr(1) || (p - 1)::VARCHAR) AS ku_id, chunk_id, content
  FROM (SELECT chunk_id, p, {_strip('s')} AS content FROM (SELECT chunk_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT chunk_id, {_sentences('content')} AS x FROM c)))
  WHERE length(content) > 10)"""

#: the longest, leftmost matches of names in ku by blocks of 2,000 names, and each unit's entities in order: link (ku_id, pos, name)
LINKS = r"""
names AS (SELECT lower(term) AS name_key, arg_max(term, {'a': -freq, 'b': first_at}) AS name, min({'a': -freq, 'b': first_at}) AS o FROM terms GROUP BY 1),
ranked AS (SELECT name_key, name, (row_number() OVER (ORDER BY length(name_key) DESC, o) - 1) // 2000 AS block, len(regexp_extract_all(name_key, '\w+|\W+')) AS n FROM names),
seg AS (SELECT ku_id, regexp_extract_all(""" + _ASCII.format("content") + r""", '\w+|\W+') AS s FROM ku),
word AS (SELECT ku_id, s, unnest(range(1, len(s) + 1)) AS i FROM seg),
begin_at AS (SELECT ku_id, s, i FROM word WHERE regexp_matches(s[i], '^\w')),
span AS (SELECT ku_id, i AS start, n AS z, lower(array_to_string(s[i : i + n - 1], '')) AS span FROM begin_at, (SELECT DISTINCT n FROM ranked) AS l WHERE i + n - 1 <= len(s)),
hit AS (SELECT ku_id, block, start, z, name FROM span JOIN ranked ON span = name_key),
listed AS (SELECT ku_id, block, list({'e': start + z, 'o': [{'s': start, 'name': name}]} ORDER BY start, z DESC) AS m FROM hit GROUP BY 1, 2),
kept AS (SELECT ku_id, block, unnest(list_reduce(m, lambda a, x: CASE WHEN x.o[1].s >= a.e THEN {'e': x.e, 'o': list_concat(a.o, x.o)} ELSE a END).o) AS x FROM listed),
once AS (SELECT ku_id, x.name AS name, min({'a': block, 'b': x.s}) AS spot FROM kept GROUP BY 1, 2),
link AS (SELECT ku_id, (row_number() OVER (PARTITION BY ku_id ORDER BY spot) - 1)::INT AS pos, name FROM once)"""

#: the graph over embeddings: v (units), edges, and q (every twentieth unit as a query)
GRAPH = """
v AS (SELECT vec_id::VARCHAR AS ku_id, vec_id, 'C' || (vec_id // 5) AS chunk_id, 'fact ' || vec_id AS content, embedding::DOUBLE[] AS e, label FROM embeddings),
edges AS (SELECT ku_id, 0 AS pos, 'L' || label AS entity_id FROM v UNION ALL SELECT ku_id, 1, 'G' || (vec_id % 13) FROM v),
q0 AS (SELECT vec_id AS query_id, e AS qe, label FROM v WHERE vec_id % 20 = 0),
scores AS (SELECT query_id, ku_id, list_cosine_similarity(qe, e) AS score FROM q0, v),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ku_id) AS rank FROM scores),
sem AS (SELECT query_id, ku_id FROM near WHERE rank <= 10),
named AS (SELECT DISTINCT q0.query_id, e.entity_id, e.ku_id FROM q0 JOIN edges e ON lower(e.entity_id) = 'l' || q0.label)"""

#: entities whose names differ in case only; the last in the list has the name
VARIANTS = """
variants AS (SELECT DISTINCT label, 'A' || label AS entity_id, 2 * label + label % 2 AS ord FROM v UNION ALL SELECT DISTINCT label, 'B' || label, 2 * label + 1 - label % 2 FROM v),
won AS (SELECT label, arg_max(entity_id, ord) AS entity_id FROM variants GROUP BY label)"""


def _hop(i: int) -> str:
    j = i - 1
    return f"""
c{i} AS (SELECT DISTINCT b.query_id, y.ku_id FROM b{j} b JOIN edges x ON x.ku_id = b.ku_id JOIN edges y ON y.entity_id = x.entity_id
         WHERE NOT EXISTS (SELECT 1 FROM a{j} a WHERE a.query_id = b.query_id AND a.ku_id = y.ku_id)),
b{i} AS (SELECT query_id, ku_id FROM (SELECT c.query_id, c.ku_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(list_cosine_similarity(q.qe, v.e), 12) DESC, c.ku_id) AS n
         FROM c{i} c JOIN q{j} q USING (query_id) JOIN v USING (ku_id)) WHERE n <= 10),
a{i} AS (SELECT * FROM a{j} UNION ALL SELECT * FROM b{i}),{_moved(f'b{i}', j, i)}"""


def _moved(kept: str, j: int, i: int) -> str:
    return f"""
m{i} AS (SELECT query_id, spot, avg(x) AS m FROM (SELECT b.query_id, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS spot FROM {kept} b JOIN v USING (ku_id)) GROUP BY 1, 2),
u{i} AS (SELECT query_id, spot, x - m AS x FROM (SELECT query_id, unnest(qe) AS x, generate_subscripts(qe, 1) AS spot FROM q{j}) JOIN m{i} USING (query_id, spot)),
q{i} AS (SELECT query_id, list(x / n ORDER BY spot) AS qe FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS n FROM u{i}) GROUP BY 1
         UNION ALL SELECT query_id, qe FROM q{j} WHERE query_id NOT IN (SELECT query_id FROM m{i}))"""


_SEEDED = "b0 AS (SELECT query_id, ku_id FROM sem), a0 AS (SELECT * FROM b0)"
_BOTH = "b0 AS (SELECT query_id, ku_id FROM sem UNION SELECT query_id, ku_id FROM named), a0 AS (SELECT * FROM b0)"
SCORED = """
scored AS (SELECT query_id, ku_id, vec_id, content, chunk_id, score, names FROM (
  SELECT a.query_id, v.ku_id, v.vec_id, v.content, v.chunk_id, list_cosine_similarity(q0.qe, v.e) AS score FROM a2 a JOIN v USING (ku_id) JOIN q0 USING (query_id)) WHERE_ JOIN
  (SELECT ku_id, list(entity_id ORDER BY pos) AS names FROM edges GROUP BY 1) USING (ku_id) WHERE score >= 0)""".replace("WHERE_ ", "")


def _walk(seeds: str) -> str:
    return f"WITH {GRAPH}, {seeds}, {_hop(1)}, {_hop(2)}, {SCORED}"


def _chunk_items(seeds: str, how: str, content: str = "'text of ' || chunk_id") -> str:
    return f"""{_walk(seeds)},
g AS (SELECT query_id, chunk_id, {how}(score) AS score, list(ku_id ORDER BY vec_id) AS kus, list(content ORDER BY vec_id) AS contents, list_sort(list_distinct(flatten(list(names)))) AS names FROM scored GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id))::INT AS rank FROM g)
SELECT query_id, rank, round(score, 9) AS score, chunk_id AS source_chunk_id, {content} AS content, array_to_string(kus, ',') AS kus, array_to_string(names, ',') AS names FROM r WHERE rank <= 6"""


def _text(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + " " + select


def oracles() -> dict[str, str]:
    packed = f"""list_reduce(list_transform({_sentences('text')}, lambda s: {{'d': []::VARCHAR[], 'c': s}}),
      lambda a, x: CASE WHEN a.c = '' THEN {{'d': a.d, 'c': x.c}} WHEN length(a.c) + 1 + length(x.c) <= 1000 THEN {{'d': a.d, 'c': a.c || ' ' || x.c}} ELSE {{'d': list_append(a.d, a.c), 'c': x.c}} END)"""
    merge = "CASE WHEN i = 1 THEN p[i] ELSE right(p[i - 1], 200) || p[i] END"
    linked = ("SELECT ku_id, pos, name FROM link", UNITS.strip())
    return {
        "chunk_fixed": f"""SELECT doc_id::VARCHAR AS doc_id, (s // 800)::INT AS chunk_index, length(content)::INT AS n_chars, md5(content) AS content_md5
            FROM (SELECT doc_id, s, substr(text, s + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents)) WHERE {_strip('content')} <> ''""",
        "chunk_sentence": f"""WITH f AS (SELECT doc_id, {packed} AS x FROM documents WHERE text IS NOT NULL AND text <> ''),
            p AS (SELECT doc_id, CASE WHEN x.c <> '' THEN list_append(x.d, x.c) ELSE x.d END AS p FROM f), i AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)
            SELECT doc_id::VARCHAR AS doc_id, (i - 1)::INT AS chunk_index, length({merge})::INT AS n_chars, md5({merge}) AS content_md5 FROM i WHERE {_strip(merge)} <> ''""",
        "overlap_merge": f"""WITH s AS (SELECT doc_id, unnest(x) AS c, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, {_sentences("coalesce(text, '')")} AS x FROM documents))
            SELECT doc_id::VARCHAR AS doc_id, (p - 1)::INT AS pos, md5(coalesce(right(lag(c) OVER (PARTITION BY doc_id ORDER BY p), 200), '') || c) AS content_md5 FROM s""",
        "documents_from_turns": "SELECT conv_id AS doc_ord, conv_id::VARCHAR AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "ku_sentences": _text("SELECT ku_id, chunk_id, content FROM ku", WHOLE, UNITS),
        "vocab_caps": _text("SELECT term, count(*) AS freq FROM occ WHERE k = 0 GROUP BY term", WHOLE, OCCURRENCES),
        "vocab_ngrams": _text("SELECT term, count(*) AS freq FROM occ WHERE k > 0 GROUP BY term", WHOLE, OCCURRENCES),
        "vocab_terms": _text("SELECT term, freq FROM terms", WHOLE, OCCURRENCES, _terms("2")),
        "entity_case_dedupe": _text("SELECT lower(term) AS name_key, arg_max(term, {'a': -freq, 'b': first_at}) AS name FROM terms GROUP BY 1", WHOLE, OCCURRENCES, _terms("2")),
        "entity_link_regex": _text(linked[0], WHOLE, OCCURRENCES, _terms("2"), linked[1], LINKS.replace("ON span = name_key", "ON span = name_key AND block = 0").replace("FROM ranked) AS l", "FROM ranked WHERE block = 0) AS l")),
        "entity_link_span": _text(linked[0], WHOLE, OCCURRENCES, _terms("2"), linked[1], LINKS),
        "index_stats": _text(
            "SELECT 'chunks' AS layer, count(*) AS n FROM c UNION ALL SELECT 'knowledge_units', count(*) FROM ku UNION ALL SELECT 'entities', count(*) FROM terms UNION ALL SELECT 'edges', count(*) FROM link",
            WINDOWS, OCCURRENCES, _terms("2"), UNITS, LINKS,
        ),
        "hash_embedding": r"""WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[^ ]+'))) AS h FROM documents),
            b AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY 1, 2)
            SELECT doc_id::VARCHAR AS doc_id, bucket::INT AS bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS x FROM b QUALIFY x <> 0""",
        "entities_from_facts": _text(
            "SELECT lower(term) AS name_key, arg_min(term, {'a': o, 'b': p}) AS name, count(*) AS n_edges FROM m GROUP BY 1",
            WHOLE,
            f"""s AS (SELECT ord * 16777216 + p AS o, {_strip('s')} AS content FROM (SELECT ord, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT ord, {_sentences('content')} AS x FROM c)) WHERE length({_strip('s')}) > 10),
            m AS (SELECT o, unnest(caps) AS term, generate_subscripts(caps, 1) AS p FROM (SELECT o, list_filter(regexp_extract_all({_ASCII.format('content')}, '{_CAPS}'), {_KEEP}) AS caps FROM s))""",
        ),
        "edges_build": f"WITH {GRAPH} SELECT ku_id, pos, entity_id FROM edges",
        "rare_entity_filter": f"WITH {GRAPH} SELECT ku_id, pos, entity_id AS name FROM edges WHERE entity_id IN (SELECT entity_id FROM edges GROUP BY 1 HAVING count(*) >= 40)",
        "ku_entity_ids": f"WITH {GRAPH} SELECT ku_id, string_agg(entity_id, ',' ORDER BY pos) AS entity_ids FROM edges GROUP BY ku_id",
        "graph_stats": f"""WITH {GRAPH} SELECT 'chunks' AS layer, count(DISTINCT chunk_id) AS n FROM v UNION ALL SELECT 'knowledge_units', count(*) FROM v
            UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM edges UNION ALL SELECT 'edges', count(*) FROM edges""",
        "lookup_entity_by_name": f"WITH {GRAPH}, {VARIANTS} SELECT query_id, entity_id FROM q0 JOIN won USING (label)",
        "kus_for_entity": f"WITH {GRAPH} SELECT entity_id, ku_id FROM edges WHERE entity_id IN (SELECT entity_id FROM named)",
        "entities_for_ku": f"WITH {GRAPH} SELECT ku_id, pos, entity_id FROM edges WHERE ku_id::BIGINT % 20 = 0",
        "cosine_score": f"WITH {GRAPH} SELECT query_id, ku_id, round(score, 9) AS score FROM scores",
        "cosine_topk": f"WITH {GRAPH} SELECT rank::INT AS rank, ku_id, round(score, 9) AS score FROM near WHERE query_id = 0 AND rank <= 10",
        "cosine_topk_batch": f"WITH {GRAPH} SELECT query_id, rank::INT AS rank, ku_id, round(score, 9) AS score FROM near WHERE rank <= 10",
        "entity_anchor": f"WITH {GRAPH}, {VARIANTS} SELECT query_id, entity_id, v.ku_id FROM q0 JOIN won USING (label) LEFT JOIN v ON v.label = won.label AND (entity_id[1] = 'A') = (v.vec_id % 2 = 0)",
        "semantic_anchor": f"WITH {GRAPH} SELECT query_id, ku_id, round(score, 9) AS score FROM near WHERE rank <= 5",
        "seed_union": f"WITH {GRAPH} SELECT query_id, ku_id FROM named UNION SELECT query_id, ku_id FROM sem",
        "expand_hop": f"WITH {GRAPH}, {_SEEDED}, {_hop(1)} SELECT query_id, ku_id FROM c1",
        "vector_query_update": f"WITH {GRAPH}, {_moved('sem', 0, 1)} SELECT query_id, (spot - 1)::INT AS place, round(x, 9) AS x FROM (SELECT query_id, unnest(qe) AS x, generate_subscripts(qe, 1) AS spot FROM q1)",
        "traverse_qiter": f"WITH {GRAPH}, {_SEEDED}, {_hop(1)}, {_hop(2)} SELECT query_id, ku_id FROM a2",
        "rank_kus": f"""{_walk(_SEEDED)}, r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ku_id))::INT AS rank FROM scored)
            SELECT query_id, rank, round(score, 9) AS score, chunk_id AS source_chunk_id, content, ku_id AS kus, array_to_string(names, ',') AS names FROM r WHERE rank <= 6""",
        "rank_chunks_mean": _chunk_items(_SEEDED, "avg"),
        "rank_chunks_max": _chunk_items(_SEEDED, "max"),
        "rank_chunks_sum": _chunk_items(_SEEDED, "sum"),
        "rank_content_fallback": _chunk_items(_SEEDED, "avg", "CASE WHEN chunk_id IN (SELECT chunk_id FROM v GROUP BY 1 HAVING min(vec_id) % 2 = 0) THEN 'text of ' || chunk_id ELSE array_to_string(contents, chr(10)) END"),
        "result_stats": f"""{_walk(_SEEDED)} SELECT query_id, n_scored AS kus_scored, n_found AS kus_retrieved, least(6, n_chunks) AS items_returned
            FROM (SELECT query_id, count(*) AS n_scored, count(DISTINCT chunk_id) AS n_chunks FROM scored GROUP BY 1) JOIN (SELECT query_id, count(*) AS n_found FROM a2 GROUP BY 1) USING (query_id)""",
        "storage_insert_if_absent": f"WITH {GRAPH} SELECT ku_id, entity_id, CASE WHEN ku_id::BIGINT % 3 = 0 THEN 1 ELSE 2 END AS run FROM edges",
        "search_end_to_end": _chunk_items(_BOTH, "avg"),
    }
