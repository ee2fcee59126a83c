"""Exact Jaccard join of documents over their word shingles, as a metric-space join.

Jaccard distance is a metric.  At a threshold of 0.8 two linked documents lie within r = 0.2 of each other, but the
space of texts is nearly discrete: almost all pairs lie at distance 1, so pivots drawn at random would put all
documents on every border.  Pivots are therefore found where documents meet:

1. *Classes.*  Documents of equal shingle set are one point with a weight.
2. *Pivots.*  Of each class the lowest-hashing shingles are looked at: |X| - ceil(t|X|) + l of them, so that any two
   linked classes share at least l (the overlap form of d(x, y) <= r).  For each shingle that two or more classes
   show, the class of the smallest fingerprint is the pivot.  A class that shares too few shingles to be within r of
   anything leaves here.
3. *Voronoi regions and windows.*  A class belongs to the pivot it shares most shingles with and, as a boundary point, to
   each other pivot, until what it leaves out is under half of what a linked pair must share: then each linked pair
   still meets in some region.  This is the triangle inequality's window, written in shared shingles.
4. *Recursion.*  A region of more than ``leaf`` classes is divided by pivots of its own: nearest pivot plus the window
   d(x, p) - d(x, nearest) <= 2r, again and again, until regions are small or no longer shrink.
5. *Leaves* are joined exactly by products of incidence matrices.  A pair that several regions contain counts in one.

No step lists the pairs of a group: leaves return, for each class, the weight of its links and a local root.
Regions beyond ``block`` classes are dealt to pairs of blocks, so no task holds an unbounded group.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, components, lean, map_groups, maybe_broadcast, spread

SHINGLE = 5
NUM, DEN = 80, 100  # linked: DEN * intersection >= NUM * union
REMEMBERED = 20_000  # sets that a task remembers in order not to give a copy's shingles again
EXTRA = 0.12  # l as a share of the set: more pivots' evidence for a longer look


def _quota(n: np.ndarray | int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of size n: how many lowest shingles are looked at, and how many of them a linked pair surely shares."""
    n = np.asarray(n, np.int64)
    must = -(-n * num // den)
    extra = np.maximum(1, (EXTRA * n).astype(np.int64))
    least = -(-n * num // den)  # the smallest size of a partner
    sure = np.maximum(1, (EXTRA * least).astype(np.int64))
    return np.minimum(n, n - must + extra), np.minimum(sure, extra)


def fingerprint(grams: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    with np.errstate(over="ignore"):
        total = K.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(K.mix(np.array([total + np.uint64(len(grams)) * np.uint64(0xD1342543DE82EF95)], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, fp) of every row; n = 0 and fp = 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, _, data, off in K.slices(batch.column(1)):
                for i, grams in enumerate(K.row_shingles(data, off, size), row):
                    if len(grams):
                        n[i], fp[i] = len(grams), fingerprint(grams)
            yield pa.record_batch({"id": batch.column(0), "n": n, "fp": fp})

    return docs.mapInArrow(lean(run), f"id {docs.dtypes[0][1]}, n long, fp long")


def _lowest(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(key, fp) for the lowest shingles of every row; equal sets that follow each other in a task give them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            for _, _, data, off in K.slices(batch.column(0)):
                keys, names, sizes = [], [], []
                for grams in K.row_shingles(data, off, size):
                    if len(grams) and (fp := fingerprint(grams)) not in seen:
                        seen.add(fp)
                        look = int(_quota(len(grams), num, den)[0])
                        keys.append(grams[:look])
                        names.append(fp)
                        sizes.append(len(grams))
                if keys:
                    looks = [len(k) for k in keys]
                    yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "fp": np.repeat(np.array(names, np.int64), looks), "n": np.repeat(np.array(sizes, np.int32), looks)})

    return docs.mapInArrow(lean(run), "key long, fp long, n int")


def _regions(scratch: Scratch, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(fp, n, regions): for each class that may have a link, the pivots whose regions it is in, nearest first."""
    low = _lowest(docs, size, num, den)
    shared = scratch.save(low.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("other")).where("pivot <> other").select("key", "pivot"))
    met = low.join(shared, "key").groupBy("fp", "n", "pivot", "key").agg(F.lit(1).alias("one")).groupBy("fp", "n", "pivot").agg(F.count("*").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ns, kept = [], [], []
            for fp, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sure = int(_quota(n, num, den)[1])
                if sum(x["c"] for x in found) < sure:
                    continue
                found.sort(key=lambda x: (x["c"], -x["pivot"]))
                spare, k = (sure - 1) // 2, 0
                while found[k]["c"] <= spare:
                    spare -= found[k]["c"]
                    k += 1
                fps.append(fp)
                ns.append(n)
                kept.append([x["pivot"] for x in reversed(found[k:])])
            yield pa.record_batch({"fp": pa.array(fps, pa.int64()), "n": pa.array(ns, pa.int32()), "regions": pa.array(kept, pa.list_(pa.int64()))})

    # a class has at most as many pivots as looked-at shingles, so the list is bounded by its own text
    return scratch.save(met.groupBy("fp", "n").agg(F.collect_list(F.struct("pivot", "c")).alias("found")).mapInArrow(lean(run), "fp long, n int, regions array<long>"))


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection sizes of all sets in a with all in b, by incidence products over the keys that two or more sets hold."""
    rows = [*a.tolist(), *b.tolist()]
    own = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    keys, inverse, count = np.unique(np.concatenate([sets[r] for r in rows]) if rows else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = count >= 2
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    own, col = own[use], column[inverse][use]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    wide = min(max(256, 2_000_000 // max(1, len(rows))), max(1, int(shared.sum())))
    for first in range(0, int(shared.sum()), wide):
        lo, hi = np.searchsorted(col, [first, first + wide])
        hit = np.zeros((len(rows), wide), np.float32)
        hit[own[lo:hi], col[lo:hi] - first] = 1
        out += hit[: len(a)] @ hit[len(a) :].T
    return out


def _linked(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    inter = np.rint(_overlaps(sets, a, b)).astype(np.int64)
    return den * inter >= num * (size[a][:, None] + size[b][None, :] - inter)


def link_matrix_parts(sets: list[np.ndarray], members: np.ndarray, num: int, den: int, leaf: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of linked members, by recursion on Voronoi regions; each pair comes once.

    A pair is given by the region in which its smaller member is at home (nearest pivot); that the other member is
    there too is what the window is for.
    """
    size = np.array([len(s) for s in sets], np.int64)

    def go(home: np.ndarray, guests: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # pairs within home, and of home with guests
        every = np.concatenate([home, guests])
        if len(every) > leaf and len(home) > 8 and level < 6:
            k = min(16, len(home))
            pivots = home[np.linspace(0, len(home) - 1, k).astype(np.int64)]
            inter = _overlaps(sets, every, pivots)
            dist = 1 - inter / (size[every][:, None] + size[pivots][None, :] - inter)
            near = dist.argmin(1)
            best = dist[np.arange(len(every)), near]
            window = dist - best[:, None] <= 2 * (1 - num / den) + 1e-6
            inside = np.arange(len(every)) < len(home)
            parts = [(every[inside & (near == p)], every[window[:, p] & ~(inside & (near == p)) & (~inside | (near > p))]) for p in range(k)]
            if max(len(h) + len(g) for h, g in parts) < 0.7 * len(every):
                for h, g in parts:
                    if len(h):
                        yield from go(h, g, level + 1)
                return
        for i in range(0, len(home), leaf):
            a = home[i : i + leaf]
            for start, rest in ((i, home), (0, guests)):
                for j in range(start, len(rest), leaf):
                    b = rest[j : j + leaf]
                    x, y = np.nonzero(_linked(sets, size, a, b, num, den))
                    x, y = a[x], b[y]
                    if rest is home and j == i:
                        x, y = x[x < y], y[x < y]
                    yield x, y

    yield from go(members, np.zeros(0, np.int64), depth)


def _join_region(table: pa.Table, num: int, den: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """The links of one region, or of one pair of its blocks: (fp, links, root) for each class with a link here."""
    me = table.column("region")[0].as_py()
    one, two = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    fp = table.column("fp").to_numpy()
    _, first = np.unique(fp, return_index=True)
    table, fp = table.take(first), fp[first]
    weight, block = table.column("weight").to_numpy(), table.column("block").to_numpy()
    grams = table.column("grams").combine_chunks()
    at, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
    sets = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
    regions = table.column("regions").combine_chunks()
    rat, rflat = regions.offsets.to_numpy(), regions.values.to_numpy()
    before = [frozenset(x for x in rflat[i:j].tolist() if x < me) for i, j in zip(rat[:-1], rat[1:])]
    links, root = np.zeros(len(fp), np.int64), np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for x, y in link_matrix_parts(sets, np.arange(len(fp)), num, den, leaf):
        if one != two:  # a pair of blocks: only what crosses it
            cross = block[x] != block[y]
            x, y = x[cross], y[cross]
        if not len(x):
            continue
        again = np.fromiter((bool(before[i]) and bool(before[i] & before[j]) for i, j in zip(x.tolist(), y.tolist())), bool, len(x))
        x, y = x[~again], y[~again]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        for i, j in zip(x.tolist(), y.tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    has = np.flatnonzero(links)
    if len(has):
        top = np.array([find(i) for i in has.tolist()])
        yield pa.record_batch({"fp": fp[has], "links": links[has], "root": fp[top]})


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, leaf: int = 256, block: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, n_similar, component_id.

    Words are runs outside white space, A-Z lower-cased; the set is the distinct ``shingle``-word runs, or the whole
    sequence if it is shorter.  Linked: ``den`` * intersection >= ``num`` * union.  Null, empty and wordless texts have
    0 shingles, link with nothing and are their own component.  Rows of a repeated id are documents of their own that
    share its number.  A row whose id is null counts and is linked as any other, but gives no component its number;
    a component of such rows only has a null one.  Other columns are not read.
    """
    scratch = Scratch(spark, "jaccard")
    named = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    points = scratch.save(_sets(named, shingle))
    classes = scratch.save(points.where("n > 0").groupBy("fp").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("n").alias("n")))
    spots = _regions(scratch, named.select("text"), shingle, num, den)
    sizes = spots.select(F.explode("regions").alias("region")).groupBy("region").agg(F.count("*").alias("m")).where("m > 1")
    sizes = scratch.save(sizes.select("region", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    # each class with a region of its own, once
    rows = spots.join(classes.select("fp", "weight"), "fp").withColumn("region", F.explode("regions")).join(sizes, "region")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = scratch.save(rows.withColumn("block", mine))
    wanted = scratch.save(rows.select("fp").distinct())

    only = maybe_broadcast(wanted, 24)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in K.slices(batch.column(0)):
                found = [g for g in K.row_shingles(data, off, shingle) if len(g)]
                if found:
                    at = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
                    yield pa.record_batch({"fp": pa.array([fingerprint(g) for g in found], pa.int64()), "grams": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view(np.int64)))})

    # one document stands for its class: its text alone is turned into a set again
    stands = scratch.save(classes.join(only, "fp", "left_semi").select(F.col("least").alias("id"), "fp"))
    texts = named.join(maybe_broadcast(stands.select("id").distinct(), 24), "id", "left_semi") if dict(points.dtypes)["id"] != "void" else named
    unnamed = named.where("id is null")
    sets = texts.unionByName(unnamed).select("text").mapInArrow(lean(grams), "fp long, grams array<long>").dropDuplicates(["fp"])
    full = rows.join(sets, "fp")
    one = F.sequence(F.lit(0), F.col("blocks") - 1)
    full = full.withColumn("other", F.explode(one)).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")
    full = full.withColumn("task", F.xxhash64("region", "left", "right"))

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        return _join_region(table, num, den, leaf)

    found = scratch.save(map_groups(full, "task", join, "fp long, links long, root long"))
    scratch.drop(rows)
    roots = components(scratch, found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    near = classes.join(links, "fp", "left").join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    near = scratch.save(near.select("fp", "weight", "links", "root", "least"))
    named_roots = scratch.save(near.groupBy("root").agg(F.min("least").alias("component")))
    near = near.join(named_roots, "root").select("fp", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), "component")
    out = points.join(near, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
