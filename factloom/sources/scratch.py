"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A side is broadcast only if its counted rows times what a row takes in a hash table stay under this many bytes.
BROADCAST_BYTES = 32_000_000


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """``table`` (a saved one, so that counting reads only footers) to be broadcast if it is small, else to be joined by shuffle:
    the other side is never broadcast on a guess of its size."""
    return F.broadcast(table) if table.count() * (2 * row_bytes + 64) <= BROADCAST_BYTES else table.hint("merge")


def spread(table: DataFrame) -> DataFrame:
    """``table``, dealt to as many tasks as the session has cores where it is stored in fewer pieces (one small file)."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.rdd().getNumPartitions() >= cores else table.repartition(cores)


def dealt(table: DataFrame, *by: str) -> DataFrame:
    """``table`` in twice as many pieces as the session has cores, however small it is: for steps that make much of few rows."""
    return table.repartition(2 * table.sparkSession.sparkContext.defaultParallelism, *by)


class Scratch:
    """Saved tables cut lineage, are computed once, and survive the loss of executors; they go when the driver ends."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="factloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.path, self.count = spark, f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def save(self, table: DataFrame) -> DataFrame:
        self.count += 1
        where = f"{self.path}/{self.count}"
        table.write.parquet(where)
        return self.spark.read.schema(table.schema).parquet(where)

    def clear(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: its owner clears the folder
            return
