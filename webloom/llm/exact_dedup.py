"""Exact dedup by two passes of a Bloom filter.

A text's identity is the SHA-256 of its normalised form. Digests, not texts, are written once; then

1. the first pass sets one bit of one 64-bit block of the filter for each digest, as an aggregate that combines in the map task
   (``bit_or`` of the bits, count of the insertions). A block with more insertions than set bits has taken one that found its bit
   set: only such a block can hold a digest twice, whatever the load. Those blocks, a bit for each, are the second filter.
2. the second pass holds every row against that filter, which is broadcast. Rows of other blocks are unique and pass straight
   through; only the rest shuffle, to be grouped by their whole digest. A false positive costs a row's shuffle and no result.

The broadcast has a bound: ``FILTER_BLOCKS`` blocks, so a sixty-fourth as many rows of two longs. A table that needs more blocks is
worked through in segments of the digests' space, one filter for each, so the load of a block is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.llm import shared

#: Blocks of a broadcast filter at most (a power of two): 2 ** 20 rows of two longs.
FILTER_BLOCKS = 1 << 26
#: Blocks for each row: two, so that a unique row's block is rarely one that others hit twice.
BLOCKS_PER_ROW = 2
#: Groups with more than this share of the possibly repeated rows are at most as many as its inverse, so they are broadcast.
HEAVY = 1024


def normalised(text: Column) -> Column:
    """A text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shape(rows: int, most: int) -> tuple[int, int]:
    """Segments of the digests' space, and blocks in the filter of each."""
    wanted = 1 << max(6, (rows * BLOCKS_PER_ROW - 1).bit_length())
    return max(1, wanted // most), min(wanted, most)


def _block(blocks: int) -> Column:
    return F.xxhash64("sha").bitwiseAND(F.lit(blocks - 1).cast("long"))


def _shifted(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by.cast("int"))


def twice_hit(digests: DataFrame, blocks: int) -> DataFrame:
    """(word, bits): the second filter over ``sha``, 64 blocks to a word; blocks that no digest can be in twice are not in it."""
    one = F.lit(1).cast("long")
    place = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(1), "sha"), F.lit(58))
    first = digests.select(_block(blocks).alias("block"), _shifted("shiftleft", one, place).alias("bit"))
    hit = first.groupBy("block").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n")).where(F.col("n") > F.bit_count("bits"))
    low = F.col("block").bitwiseAND(F.lit(63).cast("long"))
    return hit.groupBy(F.shiftright("block", 6).alias("word")).agg(F.bit_or(_shifted("shiftleft", one, low)).alias("bits"))


def probed(rows: DataFrame, second: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``suspect``: whether their ``sha`` may be there twice. ``second`` is broadcast: one row for 64 blocks at most."""
    block = _block(blocks)
    names = [F.col(f"`{c}`") for c in rows.columns]
    bit = _shifted("shiftright", F.col("_bits"), block.bitwiseAND(F.lit(63).cast("long"))).bitwiseAND(F.lit(1).cast("long"))
    held = rows.join(F.broadcast(second.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), F.shiftright(block, 6) == F.col("_word"), "left")
    return held.select(*names, (F.coalesce(bit, F.lit(0).cast("long")) == 1).alias("suspect"))


def _in_segments(digests: DataFrame, segments: int) -> DataFrame:
    """``digests`` written by segment, so that each round reads its own."""
    spark, path = digests.sparkSession, session.place(digests.sparkSession, "segments")
    dealt = digests.withColumn("segment", F.pmod(F.shiftright(F.xxhash64(F.lit(2), "sha"), 8), F.lit(segments)).cast("int"))
    dealt.write.partitionBy("segment").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def classes(docs: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` for every row of ``docs``.

    Of rows with equal normalised texts the one with the smallest ``doc_id`` stays. A group with a large share of all rows is not
    shuffled row by row: there are few such groups by their very size, so their answers are broadcast.

    Defined cases: a null text counts as empty, so null, empty and no other texts are equal (a text of white space alone is one
    space); rows that share the smallest ``doc_id`` tie, and exactly one of them stays; a null ``doc_id`` comes behind all others,
    so a group of such rows has a null ``keep_id`` and one row that stays; other columns are ignored, whatever their names; an empty
    table gives an empty one. ``filter_blocks``, a power of two from 64 on, bounds the filter and changes no result.
    """
    docs = shared.plain(docs, doc_id="bigint", text="string")
    digests = shared.materialise(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    segments, blocks = _shape(digests.count(), filter_blocks)
    if segments > 1:
        whole, digests = digests, _in_segments(digests, segments)
        shared.drop(whole)
    straight, likely = None, None
    for k in range(segments):
        own = digests if segments == 1 else digests.where(F.col("segment") == k).drop("segment")
        told = probed(own, shared.keep(twice_hit(own, blocks)), blocks)
        clear = told.where("NOT suspect").drop("suspect")
        again = shared.materialise(told.where("suspect").drop("suspect"), "likely")
        straight = clear if straight is None else straight.unionByName(clear)
        likely = again if likely is None else likely.unionByName(again)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = shared.materialise(likely.groupBy("sha").agg(F.min(place).alias("first"), F.count("*").alias("n")), "groups")
    bound = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HEAVY
    heavy = F.broadcast(groups.where(F.col("n") > bound))  # fewer than HEAVY rows
    of_heavy = likely.join(heavy, "sha")
    of_light = likely.join(heavy.select("sha"), "sha", "left_anti").join(groups.where(F.col("n") <= bound), "sha")
    answer = lambda df, keep, n, kept: df.select("doc_id", keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    told = [answer(df, F.col("first.doc_id"), F.col("n"), F.col("row") == F.col("first.row")) for df in (of_heavy, of_light)]
    return answer(straight, F.col("doc_id"), F.lit(1), F.lit(True)).unionByName(told[0]).unionByName(told[1])


def deduplicated(docs: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter clears pass with no exchange. Of the others each task keeps its first row of every text before the shuffle.
    The filter has one segment here, whatever the size, since each would read the texts again: beyond its bound more rows shuffle.
    """
    shas = docs.select(F.sha2(normalised(F.col("text").cast("string")), 256).alias("sha"))
    shas = shared.materialise(shas, "digests")
    blocks = _shape(shas.count(), filter_blocks)[1]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.sha2(normalised(F.col("text").cast("string")), 256).alias("sha"))
    told = probed(packed, shared.keep(twice_hit(shas, blocks)), blocks)
    clear = told.where("NOT suspect").select("row")
    first = told.where("suspect").groupBy("sha").agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))).alias("row")).select("row")
    return clear.unionByName(first).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Texts are told apart by themselves here, not by a hash.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)
"""
