"""Exact list membership of urls by a Bloom filter cascade.

The corpus's complete key universe is known, so a chain of Bloom filters can be exact on it: the first level encodes the
listed keys, the second the first one's false positives among the unlisted keys, the third the second one's false
positives among the listed keys, and so on until a level makes no error.  A key is listed if the first level that lacks it
is an even one.  The chain has some bits for each listed key and replaces a join of all urls with the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, spread
from .textkernel import U64, mix

#: A cascade is shipped to every task, so it may have about so many bytes; a longer list is split by key hash into several, which
#: are built and shipped one after another.
MOST_BYTES = 64_000_000
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """The k bit positions of each key at one level; every level hashes anew."""
    with np.errstate(over="ignore"):
        a = mix(h1.astype(np.int64).view(U64) ^ mix(np.array([level + 1], U64)))
        b = mix(h2.astype(np.int64).view(U64) + U64(level)) | U64(1)
        return ((a[:, None] + np.arange(k, dtype=U64)[None, :] * b[:, None]) % U64(bits)).astype(np.int64)


class Cascade:
    """Levels of (bits, k, bit map).  ``holds`` is exact for the keys that it was built over."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, k, words = self.levels[level]
        at = _places(h1, h2, level, k, bits)
        return ((words[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool).all(1)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        at = np.arange(len(h1))
        for level in range(len(self.levels)):
            at = at[self.passes(level, h1[at], h2[at])]
            out[at] = level % 2 == 0
            if not len(at):
                break
        return out

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for _, _, w in self.levels)


def build_cascade(spark: SparkSession, universe: DataFrame, scratch: Scratch) -> Cascade:
    """From ``universe`` (h1 long, h2 long, listed boolean), one row per key.

    Bit maps are made of partial words in the tasks and combined by or; only the words come to the driver.  An empty
    list gives a cascade without levels, which holds nothing.
    """
    rows = {True: universe.where("listed"), False: universe.where("not listed")}
    counts = {k: v.count() for k, v in rows.items()}
    cascade, side, level = Cascade([]), True, 0
    while counts[side]:
        inside, outside = counts[side], counts[not side]
        rate = min(0.5, max(1e-6, math.sqrt(0.5) * inside / max(1, outside))) if not level else 0.5
        k = max(1, round(math.log2(1 / rate)))
        bits = max(64, math.ceil(inside * k / math.log(2) / 64) * 64)

        def words(batches: Iterator[pa.RecordBatch], level: int = level, k: int = k, bits: int = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(_places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), level, k, bits))
                word, first = np.unique(at >> 6, return_index=True)
                bit = U64(1) << (at & 63).astype(U64)
                yield pa.record_batch({"word": word, "bits": (np.bitwise_or.reduceat(bit, first) if len(at) else bit).view(np.int64)})

        found = rows[side].select("h1", "h2").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        table = np.zeros(bits // 64, U64)
        table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U64)
        cascade.levels.append((bits, k, table))

        shipped = spark.sparkContext.broadcast(cascade.levels)

        def wrong(batches: Iterator[pa.RecordBatch], level: int = level, shipped=shipped) -> Iterator[pa.RecordBatch]:
            known = Cascade(shipped.value)
            for batch in batches:
                yield batch.filter(pa.array(known.passes(level, batch.column(0).to_numpy(), batch.column(1).to_numpy())))

        side = not side
        rows[side] = scratch.save(rows[side].select("h1", "h2").mapInArrow(wrong, "h1 long, h2 long"))
        counts[side] = rows[side].count()
        level += 1
    return cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The keys under which a rule could list a url: host suffix + path prefix, for the numbers of labels and the
    path lengths that the rules have, longest first."""
    split = [(r[: r.index("/")], r[r.index("/") :]) for r in rules]
    keys = []
    for labels in sorted({h.count(".") + 1 for h, _ in split}, reverse=True):
        for length in sorted({len(p) for _, p in split}, reverse=True):
            suffix = F.substring_index(host, ".", -labels)
            keys.append(F.when(F.length(path) >= length, F.concat(suffix, F.substring(path, 1, length))))
    found = F.array_distinct(F.array_compact(F.array(*keys)))
    return F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def judge_urls(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; the longest that
    fits decides.  Where none fits the url is on no list: rule is null and the verdict ``default``.  A null url, one
    without ``://`` and an empty one have host and path empty, which no rule fits.  Repeated rows are judged alike;
    other columns are not read.  An empty table gives no rows; a very long url is read whole.
    """
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col(url_col))
    urls = spread(pages).select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), [r for r, _ in rules]))
    listed = spark.createDataFrame([(r, v == "block") for r, v in rules], "key string, block boolean")
    h1, h2 = hashes(F.col("key"))
    # the universe: every key of the corpus, each once, and the list itself, which labels its own
    keys = urls.select(F.explode("keys").alias("key"), F.lit(False).alias("listed"), F.lit(False).alias("block"))
    universe = keys.unionByName(listed.select("key", F.lit(True).alias("listed"), "block")).groupBy("key").agg(F.max("listed").alias("listed"), F.max("block").alias("block"))
    universe = scratch.save(universe.select(h1.alias("h1"), h2.alias("h2"), "listed", "block"))
    counts = universe.agg(F.count("*").alias("all"), F.count(F.when(F.col("listed"), 1)).alias("inside")).first()
    bits = counts["inside"] * (max(1.0, math.log2(max(2, counts["all"]) / max(1, counts["inside"])) + 1) + 3) / math.log(2)
    parts = max(1, math.ceil(bits / 8 / most_bytes))
    state = urls.withColumns({"one": F.transform("keys", lambda k: hashes(k)[0]), "two": F.transform("keys", lambda k: hashes(k)[1])})
    state = state.withColumns({x: F.transform("keys", lambda k: F.lit(False)) for x in ("hit", "block")})
    kinds = f"id {urls.dtypes[0][1]}, host string, path string, keys array<string>, one array<long>, two array<long>, hit array<boolean>, block array<boolean>"
    for part in range(parts):
        mine = universe.where(F.pmod("h1", F.lit(parts)) == part)
        on_list = build_cascade(spark, mine.select("h1", "h2", "listed"), scratch)
        blocked = build_cascade(spark, mine.where("listed").select("h1", "h2", F.col("block").alias("listed")), scratch)
        shipped = spark.sparkContext.broadcast((on_list.levels, blocked.levels))

        def look(batches: Iterator[pa.RecordBatch], part: int = part, shipped=shipped) -> Iterator[pa.RecordBatch]:
            lists = [Cascade(x) for x in shipped.value]
            for batch in batches:
                a, b, hit, block = (batch.column(i).flatten().to_numpy(zero_copy_only=False).copy() for i in (4, 5, 6, 7))
                at = np.flatnonzero(a % parts == part)
                hit[at] = lists[0].holds(a[at], b[at])
                at = at[hit[at]]
                block[at] = lists[1].holds(a[at], b[at])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.diff(batch.column(3).offsets.to_numpy()))]).astype(np.int32))
                new = [pa.ListArray.from_arrays(ends, pa.array(x, pa.bool_())) for x in (hit, block)]
                yield pa.record_batch([*batch.columns[:6], *new], names=batch.schema.names)

        state = state.mapInArrow(lean(look), kinds)
        if part < parts - 1:  # several cascades are in memory one after another, never together
            state = scratch.save(state)
            shipped.destroy()
    first = F.array_position("hit", F.lit(True)).cast("int")  # keys are in order, longest first
    rule = F.when(first > 0, F.element_at("keys", F.greatest(first, F.lit(1))))
    verdict = F.when(first == 0, F.lit(default)).when(F.element_at("block", F.greatest(first, F.lit(1))), F.lit("block")).otherwise(F.lit("allow"))
    return state.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


ORACLE = """
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS n
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
