"""Vectors, urls and mixing, against brute force."""

from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import vector_dedup
from factloom.llm.common import Scratch
from factloom.llm.mixing import mix_taken, permute, plan_mix
from factloom.llm.url_filter import RULES, build_cascade, hashes, judge_urls
from factloom.llm.vector_dedup import choose_pivots, describe, vector_components


def clustered(seed=4, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for size in (1, 1, 2, 3, 5, 8, 40, 120):
        base = rng.normal(size=dims)
        out += [base + rng.normal(size=dims) * 0.12 * rng.random() for _ in range(size)]
    out += list(rng.normal(size=(150, dims)))
    return [v.astype(np.float32).tolist() for v in out]


def brute_vectors(rows, least=0.9):
    usable = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in usable], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, k in enumerate(usable):
        links[k] = int(hit[a].sum())
    for _ in range(len(rows)):
        changed = False
        for a, b in zip(*np.nonzero(hit)):
            i, j = usable[a], usable[b]
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
        if not changed:
            break
    return links, root


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links_recall_and_precision(spark, block):
    rows = list(enumerate(clustered()))
    n = len(rows)
    v = rows[0][1]
    bad = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] + v[1:]), (n + 4, v[:5]), (n + 5, [float("inf")] + v[1:]), (n + 6, [])]
    rows += bad + [(3, rows[3][1]), (n + 8, [2 * x for x in v])]
    got = vector_components(spark, spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<float>, links string"), block=block).collect()
    links, root = brute_vectors(rows)
    total = sum(r["n_links"] for r in got)
    assert total <= sum(links) and total >= 0.9 * sum(links)
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i, _ in bad)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    truth = {}
    for k, (i, _) in enumerate(rows):
        truth.setdefault(root[k], set()).add(i)
    for members in truth.values():  # no component reaches outside its true one
        assert {by[i]["component_id"] for i in members} <= members


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_components(spark, empty).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_components(spark, one).collect()), key=repr) == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=repr)


def test_pivots_are_apart_and_keys_are_pairs():
    x = np.eye(6)
    assert len(choose_pivots(np.concatenate([x, x + 1e-3]), 12)) == 6
    keys = describe(x, x)
    assert keys.shape == (6, 10) and (np.diff(keys, axis=1) > 0).all()


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "no-scheme/es/", "http://org/", "http://a.org", "https://X.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/x", "http://w.com/fr/a", "http://com/de/", "http://b.com/de", "http://c.net/fr/?x", "ftp://É.org/x", "http://a.org?x/es/", "http://a.org#/es/", "x://y://org/z", "http://org.evil.net/es/"]
    rows = [(i, u, "z") for i, u in enumerate(urls * 2)] + [(None, "http://a.org/x", "z")]
    got = judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_url(u)) for i, u, _ in rows), key=repr)
    assert judge_urls(spark, spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    from pyspark.sql import functions as F

    h1, h2 = hashes(F.col("id").cast("string"))
    universe = spark.range(20_000).select(h1.alias("h1"), h2.alias("h2"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = build_cascade(spark, universe, Scratch(spark, "t"))
    rows = universe.toPandas()
    assert len(cascade.levels) > 1
    assert (cascade.holds(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()


def water_fill(sizes, weights, share=Fraction(3, 2), cap=2):
    """Targets by the rule as it is told: share out, stop who is above the cap, share the excess anew."""
    left, target, open_ = share * sum(sizes), [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = Fraction(cap * sizes[i])
            left -= target[i]
            open_.remove(i)
    return [float(t) for t in target]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [0, 10], [10, 1000, 5, 70], [10, 65, 70, 640, 64, 1, 5000], [1] * 40 + [3000]])
def test_sources_come_within_a_block_of_their_targets(spark, sizes):
    rows, words = [], 0
    for k, n in enumerate(sizes):
        for lo in range(0, n, 5):
            rows.append((len(rows), "w " * min(5, n - lo), f"s{k:02}"))
        rows.append((len(rows), " ", f"s{k:02}"))
    got = mix_taken(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), group=3).collect()
    want = water_fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(sizes))])
    source = {i: int(s[1:]) for i, _, s in rows}
    taken = [0] * len(sizes)
    for r in got:
        k = source[r["doc_id"]]
        assert r["source_size"] == sizes[k] and r["target"] == want[k] and r["taken"] <= 2 * r["size"]
        taken[k] += r["taken"]
    for k, n in enumerate(sizes):
        # a draw is of whole blocks: within one block of the source, exact where whole passes are due
        assert abs(taken[k] - want[k]) <= min(64, n) and (want[k] < 2 * n or taken[k] == 2 * n)


def test_taken_words_equal_a_count_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 300)), ["a", "b", None, "c"][i % 4]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = plan_mix(spark, docs)
    times = {}
    for r in mix.slots.collect():
        times[r["sid"], r["block"]] = times.get((r["sid"], r["block"]), 0) + 1
    due = {r["sid"]: r["due"] for r in mix.sources.collect()}
    counts = {}
    for (sid, _), n in times.items():
        counts[sid] = counts.get(sid, 0) + n
    assert counts == {k: v for k, v in due.items() if v} and max(times.values()) <= 2
    want = []
    for r in mix.documents.collect():
        words = [(r["start"] + k) // 64 for k in range(r["size"])]
        want.append((r["id"], sum(times.get((r["sid"], b), 0) for b in words)))
    assert sorted(want) == sorted((r["doc_id"], r["taken"]) for r in mix_taken(spark, docs).collect())
    starts = {}
    for r in mix.documents.where("size > 0").collect():
        starts.setdefault(r["sid"], []).append((r["start"], r["start"] + r["size"]))
    assert all(a[1] == b[0] for spans in starts.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))


def test_permutations_are_permutations():
    for n in (1, 2, 3, 64, 1000, 4097):
        for key in (1, -5, 2**62):
            out = permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out.tolist()) == list(range(n))
    assert not np.array_equal(permute(np.arange(100), np.full(100, 100), np.full(100, 1)), permute(np.arange(100), np.full(100, 100), np.full(100, 2)))


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), ["a", "b", None, "c"][i % 4] if i % 3 else "a", 9) for i in range(1200)]
    rows += [(5000, None, "a", 9), (5001, "", None, 9), (5002, "w " * 30_000, "b", 9), (7, "w w", "b", 9), (7, "w w", "b", 9), (None, "w w w", "c", 9), (8000, "", "empty", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix_taken(spark, docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken.setdefault((r["source_size"], r["target"]), [0])[0] += r["taken"]
    for s in order:
        # half a block by rounding, and what a source's last block lacks
        assert abs(taken[sizes[s], want[s]][0] - want[s]) <= 32 + 64
    again = mix_taken(spark, docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    mix = plan_mix(spark, docs)
    draws = mix.slots.groupBy("sid", "block").count().agg({"count": "max"}).first()[0]
    assert draws <= 2


def test_mix_of_nothing(spark):
    assert mix_taken(spark, spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    only = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mix_taken(spark, only).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("pivots", [64, 152, 340, 1024])
@pytest.mark.parametrize("cosine", [0.9, 0.93])
def test_close_vectors_meet_in_a_list_at_any_number_of_pivots(pivots, cosine):
    rng = np.random.default_rng(pivots)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    made = vector_dedup.choose_pivots(unit(rng.normal(size=(3000, 64))), pivots)
    x = unit(rng.normal(size=(1000, 64)))
    r = rng.normal(size=x.shape)
    y = cosine * x + (1 - cosine**2) ** 0.5 * unit(r - (r * x).sum(1, keepdims=True) * x)
    a, b = (vector_dedup.list_keys(vector_dedup.nearest(v, made), len(made)) for v in (x, y))
    assert len(made) == pivots and (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.97


def test_recall_on_many_vectors():
    """All pairs of 100,000 vectors of cosine 0.9 or more, by brute force, and those that meet in a list."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(25_000, 32))
    x = np.repeat(centres, 4, axis=0) + rng.normal(size=(100_000, 32)) * np.repeat(rng.uniform(0.1, 0.5, 25_000), 4)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = vector_dedup.choose_pivots(x[rng.permutation(len(x))[:4000]], int(1.5 * len(x) ** 0.5))
    top = vector_dedup.nearest(x, pivots)
    found = total = 0
    small = x.astype(np.float32)
    for lo in range(0, len(x), 2000):
        i, j = np.nonzero(small[lo : lo + 2000] @ small[lo:].T >= 0.9)
        i, j = i[j > i] + lo, j[j > i] + lo
        total += len(i)
        found += int(((top[i][:, :, None] == top[j][:, None, :]).sum((1, 2)) >= 2).sum())
    assert total > 50_000 and found >= 0.9 * total, (found, total)


@pytest.mark.parametrize("lengths", [(3, 8)])
def test_vectors_of_several_lengths(spark, lengths):
    a, b = ([1.0] * n for n in lengths)
    rows = [(1, a), (2, a), (3, b), (4, [*b[:-1], 1.01]), (5, []), (6, None), (7, [0.0] * 8)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_components(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}
