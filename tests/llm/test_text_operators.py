"""The operators on pairs and groups of texts, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import substring_dedup
from factloom.llm import textkernel as K
from factloom.llm.common import Scratch, components
from factloom.llm.exact_dedup import exact_groups, named_rows
from factloom.llm.jaccard_join import jaccard_components, link_matrix_parts
from factloom.llm.substring_dedup import WORDS, _signatures, _tokens, _verify, chain, compact_windows, interval_join, name_tokens, repeated_passages, run_hashes, shared_runs, sliding_min, window_pairs

DOCS = "doc_id long, text string, n_similar string, fp string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  \n ", "one", "one two three", "One TWO three", "x " * 4000, " ".join(words(rng, 6000))]
    for _ in range(12):
        base = words(rng, rng.randrange(40, 160))
        for edits in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 1))
            texts.append(" ".join(copy))
    hot = " ".join(words(rng, 60))
    texts += [hot] * 40 + [" ".join(words(rng, 100)) for _ in range(20)]
    shared = " ".join(words(rng, 70))
    texts += [" ".join(words(rng, 90)) + " " + shared + "\n" + " ".join(words(rng, 80)) for _ in range(25)]
    return list(enumerate(texts))


def frame(spark, rows):
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def split(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    ids = [i for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return sorted(((ids[k], len(sets[k]), links[k], least.get(find(k)) if sets[k] else ids[k]) for k in range(len(rows))), key=repr)


def test_word_kernel_equals_python():
    texts = ["a B\tc", "", None, "É ü\x0bz  q", "no-sep", " lead", "trail ", "\u00a0x y"]
    data, off = K.as_bytes(pa.array(texts))
    starts, ends, first = K.word_bounds(data, off)
    for i, t in enumerate(texts):
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert [w.lower() if w.isascii() else w for w in got] == [w.lower() if w.isascii() else w for w in split(t)]
    h = K.word_hashes(*K.as_bytes(pa.array(["abc"]))[:1], np.array([0]), np.array([3]), True)
    assert h == K.word_hashes(np.frombuffer(b"xxABC", np.uint8), np.array([2]), np.array([5]), True)


@pytest.mark.parametrize("leaf,block", [(256, 2048), (4, 8)])
def test_jaccard_join_equals_brute_force(spark, leaf, block):
    rows = corpus()
    rows += [rows[20], (None, rows[21][1]), (None, "only nobody else has these words here at all")]
    got = jaccard_components(spark, frame(spark, rows), leaf=leaf, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_jaccard(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(spark, frame(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_components(spark, frame(spark, [(7, None), (8, "")])).orderBy("doc_id").collect()] == [(7, 0, 0, 7), (8, 0, 0, 8)]


def test_voronoi_recursion_gives_each_pair_once():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))
        for _ in range(rng.integers(1, 12)):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 60, 2).astype(np.uint64)])))
    got = [(min(p), max(p)) for x, y in link_matrix_parts(sets, np.arange(len(sets)), 80, 100, 16) for p in zip(x.tolist(), y.tolist())]
    want = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            want.add((a, b))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids[:150], ids[1:151])] + [(190, 191), (5, 5)] * 1
    edges = [e for e in edges if e[0] not in (190, 191) or e == (190, 191)]
    out = {r["u"]: r["root"] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {i: i for i in range(200)}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(out.get(i, i) == root[i] for e in edges for i in e)


def brute_exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i is not None, i, k))
    out = []
    for t, g in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        top = max((x[0], x[1] if x[0] else 0) for x in g)
        keep = top[1] if top[0] else None
        out += [(i, keep, len(g), sha) for _, i, _ in g]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 3])
def test_exact_dedup_equals_brute_force(spark, block):
    rows = corpus() + [(900, "aaabbb"), (901, "aaabbb"), (902, "aaabbc"), (903, "aaa"), (904, "aaabbbaaa"), (905, "aaabbbaaa"), (906, "bbbaaa"), (901, "aaabbb"), (None, "aaa"), (None, "qq")]
    rows = [(i, t if block > 4 or t is None or len(t) < 200 else t[:90]) for i, t in rows]
    got = exact_groups(spark, frame(spark, rows), block=block).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_where_hashes_collide(spark):
    """With a hash that says nothing, blocks are named by their bytes."""
    rows = [(1, "aaabbb"), (2, "aaabbb"), (3, "aaabbc"), (4, "aaa"), (5, ""), (6, None), (7, "aaabbbaaa"), (8, "aaabbbaaa"), (9, "ccc")]
    scratch = Scratch(spark, "test")
    texts = spark.createDataFrame([(i, i, "", t or "") for i, t in rows], "row long, id long, sha string, text string")
    named = named_rows(scratch, texts, 3, lambda b: F.struct(F.lit(7).cast("long").alias("h"), F.length(b).cast("long").alias("g"))).collect()
    by = {r["row"]: (r["n"], r["name"]) for r in named}
    assert len(named) == len(rows)
    assert all((by[i] == by[j]) == ((s or "") == (t or "")) for i, s in rows for j, t in rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_groups(spark, frame(spark, [])).collect() == []


def test_sliding_min_and_compact_windows():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30 if k % 2 else 1 << 60, n).astype(np.uint64) for k, n in enumerate((7, 30, 80, 200, 8))]
    seed = np.uint64(99)
    owner, value, left, at, right, lo, hi = compact_windows(docs, 7, seed)
    for d, tokens in enumerate(docs):
        h = K.mix(tokens ^ seed)
        assert np.array_equal(sliding_min(h, 7), [h[i : i + 7].min() for i in range(len(h) - 6)])
        mine = owner == d
        assert set(value[mine].tolist()) == {int(h[i : i + 7].min()) for i in range(len(h) - 6)}
        for v, a, c, b, x, y in zip(value[mine], left[mine], at[mine], right[mine], lo[mine], hi[mine]):
            assert h[c] == v and a <= c <= b and b - a + 1 >= 7 and h[a : b + 1].min() == v
            assert all(h[i : i + 7].min() == v for i in range(x, y - 5))
            if len(set(h.tolist())) == len(h):  # without repeated tokens the window cannot be wider
                assert (a == 0 or h[a - 1] < v) and (b == len(h) - 1 or h[b + 1] < v)


def test_interval_join_needs_enough_functions():
    left, right, pivot = np.array([0, 5, 300]), np.array([40, 45, 340]), np.array([7, 8, 7])
    assert interval_join(left, right, np.array([0, 1, 0]), pivot, 2) == {7: [[0, 45]], 8: [[0, 45]]}
    assert interval_join(left, right, np.array([0, 0, 1]), pivot, 2) == {}


def test_pairs_of_windows_and_their_stretches_equal_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 1, 300):
        owner, key, which, pivot = rng.integers(0, 4, n), rng.integers(0, 9, n), rng.integers(0, 4, n).astype(np.int8), rng.integers(0, 3, n)
        left = rng.integers(0, 3000, n).astype(np.int32)
        right = left + rng.integers(0, 90, n).astype(np.int32)
        rows = list(zip(owner.tolist(), which.tolist(), key.tolist(), left.tolist(), right.tolist(), pivot.tolist()))
        want = sorted((a[0], a[1:3] + b[1:3], min(a[3], b[3]), max(a[4], b[4])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[5] != b[5] and a[3] <= b[4] and b[3] <= a[4])
        # the function is part of the key, as in a signature
        got = [x.tolist() for x in window_pairs(owner, key * 4 + which, left, right, which, pivot)]
        assert sorted(zip(got[0], got[2], got[3])) == sorted((o, a, b) for o, _, a, b in want)
        assert len(set(got[1])) == len({name for _, name, _, _ in want})
        stretches = []
        for o in range(4):
            for a, b, p in sorted((r[3], r[4], r[5]) for r in rows if r[0] == o):
                if stretches and stretches[-1][0] == o and a <= stretches[-1][2] + WORDS:
                    stretches[-1][2] = max(stretches[-1][2], b)
                    stretches[-1][3].add(p)
                else:
                    stretches.append([o, a, b, {p}])
        assert list(zip(*(x.tolist() for x in chain(owner, left, right, pivot)))) == sorted((o, p, a, b) for o, a, b, pivots in stretches for p in pivots)


def test_common_phrases_neither_make_candidates_nor_hide_passages(spark, monkeypatch):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    families = [fresh(70) for _ in range(6)]
    rows = []
    for k, passage in enumerate(families):
        other = list(passage)
        other[35] = "edited"  # no 50 equal words in a row
        rows += [(2 * k + i, " ".join(fresh(60) + p + fresh(60))) for i, p in enumerate((passage, other))]
    # every run of five words of theirs, and many others, are in several long documents that share no passage
    phrases = [p[j : j + 5] for p in families for j in range(66)] + [fresh(5) for _ in range(5000)]
    for i in range(300):
        rows.append((1000 + i, " ".join(w for x in rng.sample(phrases, 120) for w in x + fresh(10))))
    pairs = []
    save = substring_dedup.Scratch.save

    def watched(self, df):
        out = save(self, df)
        if out.columns == ["fp", "pivot", "lo", "hi"]:
            pairs.append(out.where("fp <> pivot").count())
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "save", watched)
    found = {}
    for r in repeated_passages(spark, frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert set(found) == set(range(12)) and all(any(a <= 65 and b >= 125 for a, b in x) for x in found.values()), found
    assert pairs[0] < 2 * len(rows), pairs


@pytest.mark.parametrize("block", [512, 2])
def test_repeated_passages_are_found_and_others_left(spark, block):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (51, 60, 90, 200)]
    rows, where = [], {}
    for i in range(60):
        p = passages[i % 4]
        before = fresh(rng.randrange(0, 150))
        rows.append((i, " ".join(before + p + fresh(rng.randrange(0, 150)))))
        where[i] = (len(before), len(before) + len(p))
    rows += [(100 + i, " ".join(fresh(rng.randrange(0, 400)))) for i in range(40)]
    near = list(passages[3])
    near[60] = near[130] = "edited"
    rows.append((200, " ".join(fresh(30) + near + fresh(30))))
    where[200] = (30, 230)
    rows += [(300, "short copy"), (301, "short copy"), (302, None), (303, ""), (304, " ".join(passages[2][:40])), (None, " ".join(fresh(20) + passages[1]))]
    same = " ".join(fresh(80))
    rows += [(400, same), (401, same), (400, same)]
    got = repeated_passages(spark, frame(spark, rows), block=block).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert set(found) == set(where) | {400, 401, None}
    for i, (a, b) in where.items():
        assert any(x <= a + 1 and y >= b - 1 and y - x <= b - a + 2 for x, y in found[i]), (i, a, b, found[i])
    assert all(r["whole"] == (r["doc_id"] in (400, 401)) for r in got) and len(found[400]) == 2


@pytest.mark.parametrize("length", [55, 60])
def test_overlapping_excerpts_are_found_whatever_their_pivots_hold(spark, length):
    rng = random.Random(length)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    source, rows, cuts = fresh(200), [], []
    for i in range(300):
        at = rng.randrange(0, 200 - length + 1)
        before = fresh(rng.randrange(20, 60))
        cuts.append((at, len(before)))
        rows.append((i, " ".join(before + source[at : at + length] + fresh(40))))
    found = {}
    for r in repeated_passages(spark, frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for i, (at, before) in enumerate(cuts):
        held = set()
        for j, (other, _) in enumerate(cuts):
            a, b = max(at, other), min(at, other) + length
            if i != j and b - a >= 50:
                held |= set(range(before + a - at, before + b - at))
        got = {w for a, b in found.get(i, []) for w in range(a, b)}
        assert held <= got and len(got) <= len(held) + 30, (i, held - got)


def test_documents_just_too_short_are_no_pivots(spark):
    import pyarrow as pa

    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def tokens(text):
        data = text.encode()
        return next(iter(_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 5)))

    for _ in range(20_000):  # an excerpt of 49 words that has the smallest name and all signatures of the passage
        p = fresh(51)
        texts = [" ".join(x) for x in (fresh(30) + p + fresh(30), fresh(30) + p + fresh(30), p[1:50])]
        found = [tokens(t) for t in texts]
        names = [name_tokens(t) for t in found]
        if names[2] == min(names):
            x, y, z = (set(_signatures([t], np.array([1]), 40).column("key").to_pylist()) for t in found)
            if x & y <= z:
                break
    else:
        raise AssertionError("no case")
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(spark, frame(spark, list(enumerate(texts)))).collect()}
    assert {i for i, _, _ in got} == {0, 1} and all(a <= 31 and b >= 80 for _, a, b in got)
    star = pa.table({"star": pa.array([1], pa.int64()), "fp": pa.array([2], pa.int64()), "base": pa.array([0], pa.int32()), "tokens": pa.array([[1, 2]], pa.list_(pa.int32()))})
    with pytest.raises(ValueError):
        list(_verify(star, 5, 50, 10, 0.8))


def test_run_hashes_and_shared_runs_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400).astype(np.uint32)
    h = run_hashes(x, 5)
    runs = [tuple(x[i : i + 5]) for i in range(396)]
    assert len(h) == 396 and len(set(h.tolist())) == len(set(runs)) == len(set(zip(h.tolist(), runs))) and not len(run_hashes(x[:4], 5))
    rows = sorted((int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 60, 200), rng.integers(0, 3, 200), rng.integers(-1, 50, 200)))
    want = sorted((b, c) for a, b, c in rows if c >= 0 and len({q for p, q, _ in rows if p == a}) > 1)
    for size in (1, 2, 7, 200):
        batches = [pa.record_batch({"h": pa.array([r[0] for r in part], pa.int64()), "fp": pa.array([r[1] for r in part], pa.int64()), "at": pa.array([r[2] for r in part], pa.int32())}) for part in (rows[i : i + size] for i in range(0, 200, size))]
        got = sorted((r["fp"], r["at"]) for b in shared_runs(iter(batches)) for r in b.to_pylist())
        assert got == want


def test_repeated_passages_of_nothing(spark):
    assert repeated_passages(spark, frame(spark, [])).collect() == []
