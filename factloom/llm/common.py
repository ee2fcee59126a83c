"""Plumbing shared by the corpus operators: durable intermediate tables, checked broadcasts, grouped Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 32_000_000
#: Rows of text or of token lists are large: so many of them go to a Python worker at once.
ARROW_ROWS = "1000"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    A table goes when it is dropped; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have ended before: then the folder's owner clears it
            return

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        usual = self.spark.conf.get(_ARROW)
        self.spark.conf.set(_ARROW, usual if 0 < int(usual) < int(ARROW_ROWS) else ARROW_ROWS)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_ARROW, usual)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to as many tasks as the session has cores where it is stored in fewer pieces (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which a Python worker gives the memory that it no longer needs back: workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library: nothing to trim
                pass

    return run


def shrink_heaps(spark: SparkSession) -> None:
    """Has the executors collect their garbage and give the room back: a heap that one job widened stays wide in those after it.

    One task for each core, which a scheduler deals to all idle executors at once.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a saved table, so counting reads only footers) hinted for broadcast if it is small; else left to shuffle.

    ``row_bytes`` is what a row's values take; the hash table that is shipped needs about as much again and 64 bytes.
    """
    return F.broadcast(df) if df.count() * (2 * row_bytes + 64) <= BROADCAST_BYTES else df


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Runs ``fn`` on the rows of each value of the long column ``key``, groups of one partition one after another.

    Cheaper than a grouped map where groups are many and small.  Groups must be of bounded size: the caller splits
    large ones first.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), batch.num_rows]:
                if held and held_key != keys[begin]:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held_key = keys[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from fn(pa.Table.from_batches(held))

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(lean(run), schema)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (u, root), root the smallest node reached.

    The minima are saved before they are joined back, so that both sides of the join are plain exchanges and a hot node's
    rows can be split at run time.  Alternating star contraction: every round hangs each node's larger neighbours, then its smaller ones, on its
    smallest neighbour, until all edges are stars.  Only minima are aggregated, so a node with very many
    neighbours is combined before the shuffle and never gathered.  Null ends and loops are ignored.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = scratch.save(small)
        for done in (large, least, low, now):
            scratch.drop(done)
        now, seen = after, state(after)
        if seen == before:
            break
        before = seen
    return now.select("u", F.col("v").alias("root"))
