"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are drawn from a bounded sample, no two of them close to each other, so a large group of
copies does not take the pivots for itself.  A vector is described by its nearest pivots, ``near_of`` many.  Inverted lists
are kept for pairs of pivots: two vectors meet in a list exactly if they share at least two of their nearest pivots, which is
the shared-pivot count that makes a pair worth verifying.  Every vector is indexed; lists of more than ``block`` vectors are
dealt to pairs of blocks.  A list is verified by matrix products in double precision and returns, for each vector, the
weight of its links and a local root, never its pairs; a pair that meets in several lists counts in the first.

The number of pivots grows with the root of the number of vectors, so lists stay short, as long as the pivots fit in
``PIVOT_BYTES``, which are shipped to every task (62,500 of 64 components: some 1.7 thousand million vectors); of more pivots a
vector has more near ones, since close vectors agree less on which of many are the nearest.
Recall is a matter of the shared pivots (the tests measure it against brute force); what is linked is always verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, lean, maybe_broadcast, spread

NEAR = 5
PIVOT_BYTES = 32_000_000
COSINE = 0.9
BLOCK = 2048


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one: not null, of ``width``, all finite, not zero."""
    out, ok = np.zeros((len(column), width)), np.zeros(len(column), bool)
    if not width:
        return out, ok
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    fits = (np.diff(at) == width) & ~np.array(column.is_null())
    rows = np.flatnonzero(fits)
    if len(rows):
        x = flat[at[rows][:, None] + np.arange(width)[None, :]]
        size = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (size > 0)
        x = x[good] / size[good][:, None]
        out[rows[good]] = x / np.sqrt((x * x).sum(1))[:, None]
        ok[rows[good]] = True
    return out, ok


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of ``sample``, in order, leaving out rows close to one chosen before."""
    chosen, n = np.zeros((min(most, len(sample)), sample.shape[1])), 0
    for lo in range(0, len(sample), 512):
        part = sample[lo : lo + 512]
        far = np.flatnonzero((part @ chosen[:n].T).max(1) < 0.8) if n else np.arange(len(part))
        begin = n
        for i in far:
            if n == begin or (chosen[begin:n] @ part[i]).max() < 0.8:
                chosen[n] = part[i]
                n += 1
                if n == most:
                    return chosen
    return chosen[:n]


def near_of(pivots: int) -> int:
    """How many of ``pivots`` describe a vector: the binary logarithm, ``NEAR`` at least."""
    return min(pivots, max(NEAR, round(np.log2(max(pivots, 1)))))


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, ascending."""
    near = near_of(len(pivots))
    out = np.empty((len(x), near), np.int64)
    step = max(1, 4_000_000 // max(1, len(pivots)))
    for lo in range(0, len(x), step):
        score = x[lo : lo + step] @ pivots.T
        out[lo : lo + step] = np.argpartition(-score, near - 1, axis=1)[:, :near] if near < len(pivots) else np.arange(near)
    return np.sort(out, axis=1)


def list_keys(top: np.ndarray, pivots: int) -> np.ndarray:
    """The list keys of each row: the pairs of its nearest pivots, ascending; of a single pivot, that one."""
    if top.shape[1] < 2:
        return top * (pivots + 1)
    i, j = np.triu_indices(top.shape[1], 1)
    return top[:, i] * pivots + top[:, j]


def describe(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The list keys of each row."""
    return list_keys(nearest(x, pivots), len(pivots))


def _pairs_of(task: np.ndarray, x: np.ndarray, top: np.ndarray, me: np.ndarray, pivots: int, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs of rows sorted by task, small tasks all at once and large ones by matrix products.

    ``me`` is the list a row stands in: a pair counts there if it has no common pivot (``top``) below the list's larger one
    besides the smaller one, so that it has no earlier list.  ``side`` is a row's block where a list is dealt to pairs of blocks, else -1.
    """
    below = (top < (me % pivots)[:, None]) & (top != (me // pivots)[:, None])
    cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
    size = np.diff(cuts)
    small = np.repeat(size <= 48, size)
    longest = int(size[size <= 48].max(initial=0))
    for d in range(1, longest):
        i = np.flatnonzero((task[:-d] == task[d:]) & small[:-d])
        for lo in range(0, len(i), 20_000):
            a = i[lo : lo + 20_000]
            ok = np.einsum("ij,ij->i", x[a], x[a + d]) >= least
            a = a[ok]
            if len(a):
                first = ~((top[a][:, :, None] == top[a + d][:, None, :]).any(2) & below[a]).any(1)
                first &= (side[a] != side[a + d]) | (side[a] < 0)
                yield a[first], a[first] + d
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo <= 48:
            continue
        before = np.unique(top[lo:hi][below[lo:hi]])
        column = np.searchsorted(before, top[lo:hi])
        has = np.zeros((hi - lo, len(before)), np.float32)
        r, c = np.nonzero(below[lo:hi])
        has[r, column[r, c]] = 1
        for a in range(lo, hi, 512):
            end = min(a + 512, hi)
            hit = x[a:end] @ x[a:hi].T >= least
            if len(before):
                hit &= has[a - lo : end - lo] @ has[a - lo :].T == 0
            i, j = np.nonzero(hit)
            ok = (j > i) & ((side[a + i] != side[a + j]) | (side[a + i] < 0))
            yield a + i[ok], a + j[ok]


def vector_components(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Linked pairs have cosine >= ``cosine``.  A vector that is null, empty, zero, or holds a null or non-finite component links
    with nothing; vectors of different lengths do not link with each other.  Equal
    vectors are one point with a weight (recognised by a 64-bit hash).  Rows of a repeated id are vectors of their own.  A null id
    gives no component its number; a component of such rows only has a null one, and keeps them.  Other columns are
    not read.  An empty table gives no rows; a very long vector is one like others.
    """
    named = spread(vectors).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    lengths = sorted(r["d"] for r in named.where("size(v) > 0").select(F.size("v").alias("d")).distinct().collect())
    out = named.where("v is null or size(v) = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for width in lengths:  # vectors of one length at a time: usually there is one
        of = named.where(F.size("v") == width) if len(lengths) > 1 else named.where("size(v) > 0")
        out = out.unionByName(_of_length(spark, of, width, cosine, block))
    return out.withColumnRenamed("id", id_col)


def _of_length(spark: SparkSession, named: DataFrame, width: int, cosine: float, block: int) -> DataFrame:
    """The same for ``named`` (id, v) of one length."""
    scratch = Scratch(spark, "vectors")
    kind = named.schema["v"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ok = _matrix(batch.column(2), width)
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(batch.column(1).to_numpy(), mask=~ok)})

    hashed = named.select("id", F.xxhash64("v").alias("fp"), "v")
    points = scratch.save(hashed.mapInArrow(lean(check), f"id {named.dtypes[0][1]}, fp long"))
    classes = scratch.save(points.where("fp is not null").groupBy("fp").agg(F.count("*").alias("weight"), F.min("id").alias("least")))
    n = classes.count()
    most = int(min(PIVOT_BYTES // (8 * width), max(64, 1.5 * n**0.5)))
    drawn = hashed.join(F.broadcast(classes.orderBy(F.xxhash64("fp"), "fp").limit(4 * most).select("fp")), "fp", "left_semi").dropDuplicates(["fp"]).orderBy(F.xxhash64("fp"), "fp").select("v").toArrow()
    column = drawn.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    sample, ok = _matrix(column, width)
    chosen = choose_pivots(sample[ok], most)
    n_pivots, shipped = len(chosen), spark.sparkContext.broadcast(chosen)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shipped.value
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, ok = _matrix(part.column(1), width)
                if ok.any():
                    top = nearest(x[ok], pivots)
                    lists = [(k, pa.array(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32))) for k in (top.astype(np.int32), list_keys(top, len(pivots)))]
                    yield pa.record_batch({"fp": part.column(0).filter(pa.array(ok)), "v": part.column(1).filter(pa.array(ok)), **{c: pa.ListArray.from_arrays(at, pa.array(k.reshape(-1))) for c, (k, at) in zip(("top", "keys"), lists)}})

    described = scratch.save(hashed.select("fp", "v").mapInArrow(lean(index), f"fp long, v {kind}, top array<int>, keys array<long>").dropDuplicates(["fp"]))
    lists = described.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = scratch.save(lists.select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    # a vector travels once for each of its lists that has another vector
    rows = described.select("fp", "top", F.explode("keys").alias("key")).join(maybe_broadcast(lists, 40), "key")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("fp", "top", "key", "blocks", "side", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("task"), F.when((F.col("blocks") > 1) & (F.col("side") != F.col("other")), F.col("side")).otherwise(-1).alias("cross"))
    crossed = rows.join(described.select("fp", "v"), "fp").join(classes.select("fp", "weight"), "fp")
    # in a task of two blocks all rows carry their side; in a task of one block all carry -1
    sorted_rows = crossed.select("task", "key", "fp", "weight", F.col("cross").alias("side"), "top", "v").repartition("task").sortWithinPartitions("task", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            task, me, fp, weight, side = (table.column(i).to_numpy() for i in range(5))
            top = table.column("top").chunk(0).flatten().to_numpy().reshape(len(task), -1)
            x, _ = _matrix(table.column("v").chunk(0), width)
            links, root = np.zeros(len(task), np.int64), np.arange(len(task))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for a, b in _pairs_of(task, x, top, me, n_pivots, side, cosine):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                for i, j in zip(a.tolist(), b.tolist()):
                    i, j = find(i), find(j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
            has = np.flatnonzero(links)
            if len(has):
                yield pa.record_batch({"fp": fp[has], "links": links[has], "root": fp[np.array([find(i) for i in has.tolist()])]})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            start = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if held and (start or held[-1].column(0)[-1].as_py() != task[0]):
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            elif start:
                yield from solve(pa.Table.from_batches([batch.slice(0, start)]))
            held.append(batch.slice(start))
        if held:
            yield from solve(pa.Table.from_batches(held))

    found = scratch.save(sorted_rows.mapInArrow(lean(verify), "fp long, links long, root long"))
    roots = components(scratch, found.select(F.col("fp").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "fp")
    near = classes.join(found.groupBy("fp").agg(F.sum("links").alias("links")), "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    near = scratch.save(near)
    named_roots = scratch.save(near.groupBy("root").agg(F.min("least").alias("component")))
    near = near.join(named_roots, "root").select("fp", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = points.join(near, "fp", "left").withColumn("component_id", F.when(F.col("fp").isNotNull(), F.col("component")).otherwise(F.col("id")))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
