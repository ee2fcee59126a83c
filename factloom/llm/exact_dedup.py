"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  The distinct blocks are sorted and each gets an integer name;
then the distinct pairs of adjacent names are sorted and named, and so on, halving the length each time, until every
text has one name.  Two texts of equal length in blocks have the same name exactly if they are identical.

Blocks are sorted by a pair of hashes first and by their bytes among equal hashes, so that blocks which no other equals need not
travel.  That equal hashes mean equal blocks is not assumed but looked up: the bytes of all hashes that repeat are
compared.  Should two blocks share their hashes, names are given in order of the blocks' bytes throughout.
Names are written to the shared folder as soon as they are given; recomputing a task cannot change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, spread

BLOCK = 4096


def _name(scratch: Scratch, values: DataFrame) -> DataFrame:
    """The distinct rows of ``values`` with an integer ``name`` that follows their order."""
    return scratch.save(values.distinct().orderBy(*values.columns).withColumn("name", F.monotonically_increasing_id()))


def name_levels(scratch: Scratch, now: DataFrame) -> DataFrame:
    """(row, n, name) of each text from its blocks' names, ``now`` (row, n blocks, pos, name): equal (n, name) means equal blocks
    throughout."""
    longest = now.agg(F.max("n")).first()[0] or 0
    done = now.where("n = 1").select("row", "n", "name")
    level = 1
    while (1 << (level - 1)) < longest:
        pairs = (
            now.where(F.col("n") > (1 << (level - 1)))
            .groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        pairs = scratch.save(pairs)
        names = _name(scratch, pairs.select("a", "b"))
        now = scratch.save(pairs.join(names.hint("merge"), ["a", "b"]).select("row", "n", "pos", "name"))
        scratch.drop(pairs)
        scratch.drop(names)
        done = done.unionByName(now.where(F.col("n") <= (1 << level)).select("row", "n", "name"))
        level += 1
    return done


def _blocks(text: Column, block: int) -> Column:
    """The array of a text's blocks of bytes; an empty text has one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.expr("0"), F.floor((F.octet_length(text) - 1) / block)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def _hashes(piece: Column) -> Column:
    return F.struct(F.xxhash64(piece).alias("h"), F.xxhash64(piece, F.lit(1)).alias("g"))


def named_rows(scratch: Scratch, texts: DataFrame, block: int, hashes=_hashes) -> DataFrame:
    """(row, id, sha, n, name) for each of ``texts`` (row, id, sha, text): equal (n, name) means identical texts."""
    marks = scratch.save(texts.select("row", "id", "sha", F.transform(_blocks(F.col("text"), block), hashes).alias("blocks")))
    pieces = marks.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "x")).select("row", "n", "pos", "x.h", "x.g")
    again = scratch.save(pieces.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g"))
    bytes_of = texts.select(F.explode(_blocks(F.col("text"), block)).alias("block")).withColumn("x", hashes(F.col("block"))).select("x.h", "x.g", "block")
    contents = bytes_of.join(maybe_broadcast(again, 32), ["h", "g"], "left_semi").distinct()
    if contents.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        names = _name(scratch, pieces.select("h", "g"))
        first = pieces.join(names.hint("merge"), ["h", "g"]).select("row", "n", "pos", "name")
    else:
        # with the numbers of this very reading of the texts
        cut = texts.select("row", "id", "sha", _blocks(F.col("text"), block).alias("b"))
        whole = scratch.save(cut.select("row", "id", "sha", F.size("b").alias("n"), F.posexplode("b").alias("pos", "block")))
        marks = whole.where("pos = 0")
        first = whole.join(_name(scratch, whole.select("block")).hint("merge"), "block").select("row", "n", "pos", "name")
    named = name_levels(scratch, scratch.save(first))
    return scratch.save(named.join(marks.select("row", "id", "sha"), "row"))


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and ``row_col`` if it is given.

    Texts are equal if identical; null counts as empty, so null and empty texts are one group.  Of a group the row of
    the largest id stays; a null id is smaller than any; of rows that repeat that id one stays.  Other columns are not read.
    ``row_col`` is a column of ``docs`` that numbers its rows.  An empty table gives no rows; a very long text is a row of many blocks.
    """
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    if row_col:
        texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), text)
    else:  # rows are numbered once, in the saved table that holds their hashes; texts are read again by no number
        texts = spread(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text)
    named = named_rows(scratch, texts.withColumn("sha", F.sha2("text", 256)), block)
    # saved, so that the rows of a hot group can be split when they are joined with it
    groups = scratch.save(named.groupBy("n", "name").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size")))
    out = named.join(groups.hint("merge"), ["n", "name"])
    more = [F.col("row").alias(row_col)] if row_col else []
    return out.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"), *more)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
