"""Graphs in storage: one JSON file, Parquet tables that only take what is new, or a PostgreSQL schema by JDBC."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import FactGraph

SCHEMAS = {
    "chunks": "chunk_id string, chunk_ord decimal(38,0), doc_id string, index int, content string, metadata map<string,string>",
    "units": "ku_id string, ku_ord decimal(38,0), chunk_id string, content string, embedding array<double>, entity_ids array<string>, metadata map<string,string>",
    "entities": "entity_id string, entity_ord long, name string, name_key string, entity_type string, embedding array<double>, metadata map<string,string>",
    "edges": "ku_id string, pos int, entity_id string",
}
KEYS = {"chunks": ["chunk_id"], "units": ["ku_id"], "entities": ["entity_id"], "edges": ["ku_id", "entity_id"]}


def _conform(table: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, in order; a missing list or map is an empty one, another missing column is null."""
    spark = table.sparkSession
    out = []
    for f in spark.createDataFrame([], schema).schema:
        kind = f.dataType.simpleString()
        x = F.col(f.name).cast(kind) if f.name in table.columns else F.lit(None).cast(kind)
        if kind.startswith("array"):
            x = F.coalesce(x, F.array().cast(kind))
        elif kind.startswith("map"):
            x = F.coalesce(x, F.create_map().cast(kind))
        out.append(x.alias(f.name))
    return table.select(*out)


def new_rows(stored: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``offered`` whose key is not stored yet, one for each key."""
    return offered.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def _on_disk(spark: SparkSession, path: str) -> tuple:
    """Whether ``path`` exists, the path and its file system, as Hadoop has them: the same folder for all executors."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(p), p, files


def to_dict(graph: FactGraph) -> dict[str, list[dict]]:
    """All rows of the four tables as plain values, for a graph that fits in the driver."""
    return {name: [json.loads(row) for row in _conform(getattr(graph, name), schema).toJSON().toLocalIterator()] for name, schema in SCHEMAS.items()}


def from_dict(spark: SparkSession, data: dict[str, list[dict]]) -> FactGraph:
    """The graph of what ``to_dict`` gives; missing tables are empty, missing values null."""
    found = {}
    for name, schema in SCHEMAS.items():
        lines = spark.createDataFrame([(json.dumps(x),) for x in data.get(name, [])], "line string")
        found[name] = _conform(lines.select(F.from_json("line", schema).alias("x")).select("x.*"), schema)
    return FactGraph(**found)


class TableStorage:
    """A folder of Parquet tables; saving appends what is new and leaves what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create_tables(self) -> None:
        for name, schema in SCHEMAS.items():
            if not _on_disk(self.spark, f"{self.path}/{name}")[0]:
                self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        return all(_on_disk(self.spark, f"{self.path}/{name}")[0] for name in SCHEMAS)

    def save(self, graph: FactGraph) -> None:
        self.create_tables()
        for name, schema in SCHEMAS.items():
            stored = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            new_rows(stored, _conform(getattr(graph, name), schema), KEYS[name]).write.mode("append").parquet(f"{self.path}/{name}")

    def load(self) -> FactGraph:
        return FactGraph(**{name: _conform(self.spark.read.schema(schema).parquet(f"{self.path}/{name}"), schema) for name, schema in SCHEMAS.items()})


class JsonStorage:
    """One JSON object with four arrays, for a graph that fits in one file of a folder that all executors share; written by
    way of the driver, row by row."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, str(path)

    def exists(self) -> bool:
        return _on_disk(self.spark, self.path)[0]

    def save(self, graph: FactGraph) -> None:
        _, path, files = _on_disk(self.spark, self.path)
        out = files.create(path, True)
        held: list[str] = []

        def put(text: str, last: bool = False) -> None:
            held.append(text)
            if last or len(held) >= 1000:
                out.write(bytearray("".join(held).encode()))
                held.clear()

        try:
            for k, (name, schema) in enumerate(SCHEMAS.items()):
                put(("{" if not k else ", ") + json.dumps(name) + ": [")
                for i, row in enumerate(_conform(getattr(graph, name), schema).toJSON().toLocalIterator()):
                    put((", " if i else "") + row)
                put("]")
            put("}", True)
        finally:
            out.close()

    def load(self) -> FactGraph:
        kinds = {name: self.spark.createDataFrame([], schema).schema.simpleString() for name, schema in SCHEMAS.items()}
        data = self.spark.read.schema(", ".join(f"{name} array<{kind}>" for name, kind in kinds.items())).json(self.path, multiLine=True)
        return FactGraph(**{name: _conform(data.select(F.inline(name)), schema) for name, schema in SCHEMAS.items()})


#: What the tables are in PostgreSQL, by the column types of ``SCHEMAS``.
_SQL_TYPES = {"string": "TEXT", "int": "INTEGER", "long": "BIGINT", "decimal(38,0)": "NUMERIC(38)", "array<double>": "FLOAT8[]", "array<string>": "TEXT[]", "map<string,string>": "JSONB DEFAULT '{}'"}


@dataclass
class JdbcStorage:
    """Tables of a PostgreSQL schema, with primary keys.  Needs the driver on Spark's class path.

    Rows are written to a table of their own first and then taken over by one statement that leaves what is there, so
    writers at the same time and repeated tasks insert nothing twice.
    """

    spark: SparkSession
    url: str
    schema: str = "factloom"
    properties: dict | None = None

    def _table(self, name: str) -> str:
        return f"{self.schema}.{name}"

    def _given(self) -> dict:
        return {"stringtype": "unspecified", **(self.properties or {})}  # text goes into JSONB columns

    def execute(self, statements: list[str]) -> None:
        """Runs ``statements`` in one transaction of a connection of the driver."""
        jvm = self.spark._jvm
        known = jvm.java.util.Properties()
        for k, v in self._given().items():
            known.setProperty(k, v)
        to = jvm.java.sql.DriverManager.getConnection(self.url, known)
        try:
            to.setAutoCommit(False)
            run = to.createStatement()
            for text in statements:
                run.execute(text)
            to.commit()
        finally:
            to.close()

    def definitions(self) -> list[str]:
        out = [f"CREATE SCHEMA IF NOT EXISTS {self.schema}"]
        for name, schema in SCHEMAS.items():
            columns = [c.split(" ", 1) for c in _fields(schema)]
            texts = [f'"{c}" {_SQL_TYPES[kind]}' + " NOT NULL" * (c in KEYS[name]) for c, kind in columns]
            keys = ", ".join(f'"{k}"' for k in KEYS[name])
            out.append(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({', '.join(texts)}, PRIMARY KEY ({keys}))")
        return out

    def create_tables(self) -> None:
        self.execute(self.definitions())

    def write(self, table: DataFrame, name: str, mode: str) -> None:
        table.write.mode(mode).jdbc(self.url, self._table(name), properties=self._given())

    def save(self, graph: FactGraph) -> None:
        self.create_tables()
        for name, schema in SCHEMAS.items():
            offered = _conform(getattr(graph, name), schema).dropDuplicates(KEYS[name])
            offered = offered.select(*[F.to_json(c).alias(c) if kind.startswith("map") else F.col(c) for c, kind in offered.dtypes])
            waiting = f"{name}_{uuid.uuid4().hex[:12]}"
            self.write(offered, waiting, "overwrite")
            columns = ", ".join(f'"{c}"' for c in offered.columns)
            values = ", ".join(f'"{c}"::jsonb' if c == "metadata" else f'"{c}"' for c in offered.columns)
            self.execute([f"INSERT INTO {self._table(name)} ({columns}) SELECT {values} FROM {self._table(waiting)} ON CONFLICT DO NOTHING", f"DROP TABLE {self._table(waiting)}"])

    def load(self) -> FactGraph:
        found = {}
        for name, schema in SCHEMAS.items():
            kinds = dict(self.spark.createDataFrame([], schema).dtypes)
            table = self.spark.read.jdbc(self.url, self._table(name), properties=self._given())
            found[name] = _conform(table.select(*[F.from_json(c, kinds[c]).alias(c) if kinds[c].startswith("map") else F.col(c) for c in kinds]), schema)
        return FactGraph(**found)


def _fields(schema: str) -> list[str]:
    """The columns of a DDL string, commas inside types left alone."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[begin:i].strip())
            begin = i + 1
    return out
