"""Mixing sources to target weights, as a plan over fixed-length token blocks.

The words of a source, document after document, are packed into blocks of ``BLOCK`` words.  The mix is a sequence of slots in
output shards; a source is due its target divided by the mean words of its own blocks in slots.  Each shard draws
multinomial source counts (the whole part of every expectation is given, what is left is drawn).  What a source drew beyond
its due is taken back and given, in further shards, to the sources that drew too little, so every source ends with its due.
The slots of a source are numbered through all shards, and slot k takes the block that the source's pseudorandom
permutation of its indices gives for k, one permutation for each pass over the source.  Slots and blocks then meet by
(source, block).  Seeds depend on shard, source and pass alone, so reruns agree however tasks are placed.

Sources are rows like others: they are numbered by a range sort, their targets found by aggregates, and a shard draws from a
group of ``GROUP`` sources at most.  Prefix sums run in two levels (totals of hashed runs, then within a run), so no source is
ever in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, lean, maybe_broadcast, spread

BLOCK = 64
SHARD = 1024
RUN = 50_000  # rows of one run of the prefix sums
GROUP = 65_536  # sources that a shard draws from
SLOTS = 500_000  # slots that one task makes


def water_level(scratch: Scratch, sources: DataFrame, share: Fraction, cap: Fraction) -> tuple[Fraction, bool]:
    """The level L at which the sum of min(weight * L, cap * size) over ``sources`` (size, weight) is ``share`` of all sizes, and
    whether there is one; else all sources are at their cap.

    Level by level: sources that their share would lift above the cap are closed at it, the excess is shared anew.  Each
    round is an aggregate, in exact arithmetic.
    """
    wide = "decimal(38,0)"
    size, weight = F.col("size").cast(wide), F.col("weight").cast(wide)
    level = None
    while True:
        # closed: cap * size < weight * level
        shut = F.lit(False) if level is None else (F.lit(str(cap.numerator * level.denominator)).cast(wide) * F.col("size") < F.lit(str(level.numerator * cap.denominator)).cast(wide) * F.col("weight"))
        none = F.lit(0).cast(wide)
        row = sources.agg(F.sum(size).alias("all"), F.sum(F.when(shut, size).otherwise(none)).alias("full"), F.sum(F.when(shut, none).otherwise(weight)).alias("open")).first()
        if not row["open"]:
            return Fraction(0), False
        new = (share * int(row["all"]) - cap * int(row["full"])) / int(row["open"])
        if new == level:
            return new, True
        level = new


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of range(size), one for each key: four Feistel rounds, walked until inside the range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(K.U64)
    low = (K.U64(1) << half) - K.U64(1)
    out = index.astype(K.U64)
    todo = np.arange(len(out))
    key = key.astype(np.int64).view(K.U64)
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], low[todo], key[todo]
            a, b = out[todo] >> h, out[todo] & m
            for r in range(4):
                a, b = b, a ^ (K.mix(b + k + K.U64(r) * K.U64(0xA24BAED4963EE407)) & m)
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= size[todo].astype(K.U64)]
    return out.astype(np.int64)


def _starts(scratch: Scratch, rows: DataFrame, by: Sequence[str], run: Column, order: Sequence[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` before each row of its group ``by``, in the order of (run, order)."""
    rows = rows.withColumn("_run", run)
    totals = rows.groupBy(*by, "_run").agg(F.sum(amount).alias("_t"))
    before = totals.select(*by, "_run", (F.sum("_t").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum(amount).over(inside) - F.col(amount))
    return scratch.save(rows.join(before, [*by, "_run"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_run", "_before", "_in"))


class Mix:
    """``sources`` (sid, source, size, blocks, target, due), ``documents`` (id, sid, size, start), ``slots`` (shard, sid,
    pass_no, block) and the blocks' ``pieces`` (id, sid, size, start, block, words) as DataFrames."""

    def __init__(self, sources: DataFrame, documents: DataFrame, slots: DataFrame, pieces: DataFrame):
        self.sources, self.documents, self.slots, self.pieces = sources, documents, slots, pieces


def _number_sources(scratch: Scratch, found: DataFrame, weights: Sequence[int], share: float, cap: float, block: int, seed: int) -> DataFrame:
    """``found`` (source, size) numbered by code point, null last, with targets and the slots that are due to each."""
    ordered = scratch.save(found.orderBy(F.col("source").isNull(), "source").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])])
    known = scratch.save(scratch.spark.createDataFrame([(p, int(x)) for (p, _), x in zip(counts, before)], "_p long, _before long"))
    sid = (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid")
    numbered = ordered.join(F.broadcast(known), part == F.col("_p")).select(sid, "source", "size")  # a row for each range of the sort
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    numbered = scratch.save(numbered.withColumn("weight", weight))
    level, some = water_level(scratch, numbered.where("size > 0 and weight > 0"), Fraction(share), Fraction(cap))
    full = F.col("size") * F.lit(float(cap))
    target = full
    if some:
        for w in sorted(set(weights)):
            target = F.when(F.col("weight") == w, F.least(full, F.lit(float(w * level)))).otherwise(target)
    target = F.when((F.col("size") > 0) & (F.col("weight") > 0), target).otherwise(F.lit(0.0))
    blocks = F.expr(f"(size + {block - 1}) div {block}")
    rows = numbered.select("sid", "source", "size", blocks.alias("blocks"), target.alias("target"))
    due = F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(F.lit(0.0))
    # a source of less than a slot is settled by a hash, so that many small ones do not all go without; others by rounding
    chance = F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    whole = F.when(due < 1, (chance < due).cast("long")).otherwise(F.floor(due + 0.5))
    return scratch.save(rows.withColumn("part", due).withColumn("due", whole.cast("long")))


def draw_counts(shard: int, shards: int, total: int, part: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The slots of each source in one of the ``shards`` shards of a group, whose sources have the shares ``part``."""
    slots = min(size, total - shard * size)
    want = part * slots
    got = np.floor(want).astype(np.int64)
    rest = slots - int(got.sum())
    if rest > 0:
        left = want - got
        left = left if left.sum() > 0 else part
        got += np.random.Generator(np.random.PCG64([seed, shard, shards])).multinomial(rest, left / left.sum())
    return got


def plan_mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 1, group: int = GROUP) -> Mix:
    scratch = Scratch(spark, "mix")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for row, end, data, off in K.slices(batch.column(2)):
                size[row:end] = np.diff(K.word_bounds(data, off)[2])
            yield pa.record_batch({"id": batch.column(0), "source": batch.column(1), "h": batch.column(3), "size": size})

    named = spread(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")))
    sized = scratch.save(named.mapInArrow(lean(count), f"id {named.dtypes[0][1]}, source string, h long, size long"))
    found = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    rows = found.agg(F.sum("rows")).first()[0] or 0
    sources = _number_sources(scratch, found.select("source", "size"), weights, share, cap, block, seed)
    names = sources.select("sid", F.col("source").alias("name"))
    sized = sized.join(maybe_broadcast(names, 48), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    runs = max(1, -(-rows // RUN))
    # a row without words has no place; rows of equal id and size are told apart by their texts
    documents = _starts(scratch, sized.where("size > 0"), ["sid"], F.pmod(F.xxhash64("id", "size", "h"), F.lit(runs)), [F.col("id"), F.col("size"), F.col("h")], "size", "start")
    documents = documents.unionByName(sized.where("size = 0").withColumn("start", F.lit(0).cast("long"))).drop("h")

    # groups of sources, each with shards of its own: (g, total slots, shares)
    grouped = sources.where("part > 0").withColumn("g", F.expr(f"sid div {group}"))
    sums = grouped.groupBy("g").agg(F.ceil(F.sum(F.col("part").cast("decimal(38,6)"))).cast("long").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sid", "part"))).alias("members"))
    sums = sums.withColumn("shards", F.expr(f"(total + {shard - 1}) div {shard}"))
    pieces_of_work = sums.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1, F.lit(256).cast("long"))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g, total, shards, first = (batch.column(i)[r].as_py() for i in range(4))
                members = batch.column(4)[r].values
                sid, part = members.field(0).to_numpy(), members.field(1).to_numpy()
                part = part / part.sum()
                for at in range(first, min(first + 256, shards)):
                    got = draw_counts(at, shards, total, part, shard, seed + g)
                    has = np.flatnonzero(got)
                    yield pa.record_batch({"shard": np.full(len(has), (g << 40) + at), "sid": sid[has], "slots": got[has]})

    drawn = scratch.save(pieces_of_work.select("g", "total", "shards", "first", "members").repartition("g", "first").mapInArrow(lean(draw), "shard long, sid long, slots long"))
    drawn = _starts(scratch, drawn, ["sid"], F.expr(f"shard div {RUN}"), [F.col("shard")], "slots", "first")
    owed = scratch.save(sources.select("sid", "blocks", "due").join(drawn.groupBy("sid").agg(F.sum("slots").alias("got")), "sid", "left").select("sid", "blocks", "due", F.coalesce("got", F.lit(0)).cast("long").alias("got")))
    owes = maybe_broadcast(owed, 40)
    kept = drawn.join(owes, "sid").withColumn("slots", F.least("slots", F.col("due") - F.col("first"))).where("slots > 0").select("shard", "sid", "slots", "first", "blocks")
    # further shards for the sources that drew too little
    more = owed.where("got < due").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(due - got - 1) div {shard}"))))
    first = F.col("got") + F.col("k") * shard
    more = more.select((F.lit(1 << 60) + F.pmod(F.xxhash64("sid", "k"), F.lit(1 << 30))).alias("shard"), "sid", F.least(F.lit(shard).cast("long"), F.col("due") - first).alias("slots"), first.alias("first"), "blocks")
    plan = scratch.save(kept.unionByName(more))
    total = plan.agg(F.sum("slots")).first()[0] or 0

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, sids, slots, first, blocks = (batch.column(i).to_numpy() for i in range(5))
            for lo in range(0, len(shards), 64):
                n = slots[lo : lo + 64]
                sid, of = np.repeat(sids[lo : lo + 64], n), np.repeat(blocks[lo : lo + 64], n)
                k = np.repeat(first[lo : lo + 64] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                turn, at = k // of, k % of
                with np.errstate(over="ignore"):
                    key = K.mix(K.mix(sid.astype(K.U64) + K.U64(seed)) + turn.astype(K.U64)).view(np.int64)
                yield pa.record_batch({"shard": np.repeat(shards[lo : lo + 64], n), "sid": sid, "pass_no": turn, "block": permute(at, of, key)})

    slots = plan.repartition(max(1, -(-int(total) // SLOTS)), "shard", "sid").select("shard", "sid", "slots", "first", "blocks").mapInArrow(lean(take), "shard long, sid long, pass_no long, block long")
    size, start, b = F.col("size"), F.col("start"), F.lit(block).cast("long")
    pieces = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    pieces = pieces.withColumn("words", F.least(start + size, (F.col("block") + 1) * b) - F.greatest(start, F.col("block") * b))
    return Mix(sources, documents, slots, pieces)


def mix_taken(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words that the mix takes of it, repeats counted).

    Words are runs outside white space; null and empty texts have size 0 and give nothing.  Null is a source of its own,
    the last in order.  Rows that repeat an id are documents of their own.  No row gives more than ``cap`` times its size.
    Other columns are not read.  An empty table gives no rows; a very long text is a document of many blocks.
    """
    mix = plan_mix(spark, docs, id_col, text_col, source_col, **options)
    times = mix.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # the slots come from a small table of draws, so their size is guessed far too low: never broadcast them
    taken = mix.pieces.join(times.hint("merge"), ["sid", "block"], "left").groupBy("id", "sid", "size", "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = mix.documents.where("size = 0").select("id", "sid", "size", "start", F.lit(0).cast("long").alias("taken"))
    known = mix.sources.select("sid", F.col("size").alias("source_size"), "target")
    out = taken.unionByName(none).join(maybe_broadcast(known, 32), "sid")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
