"""Which keys a crawl has met: an index that levels are added to and that a level's candidates are held against.

Levels are gathered in small tables first. When those hold ``RECENT`` keys they are folded into the index: Parquet by hash bucket, and a Bloom
filter of at most ``WORDS`` rows, which is broadcast. Candidates that the filter clears were never met and read nothing of the
index. The others read the buckets that they fall into, no others, and are told by their keys. So what a level costs follows its own
candidates, and what was met before them is shuffled only by the buckets that they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session

#: Keys of the small tables; buckets of the index; words of the filter (a power of two), 64 bits each.
RECENT, BUCKETS, WORDS = 1 << 20, 1024, 1 << 18


class Seen:
    def __init__(self, spark: SparkSession, recent: int = RECENT, buckets: int = BUCKETS, words: int = WORDS) -> None:
        self.spark, self.limit, self.buckets, self.n_words = spark, recent, buckets, words
        self.recent: list[DataFrame] = []
        self.waiting, self.path, self.words, self.schema = 0, None, None, None

    def _word(self) -> Column:
        return F.xxhash64("key").bitwiseAND(F.lit(self.n_words - 1).cast("long"))

    def _mask(self) -> Column:
        """Three of a word's bits."""
        h, one = F.xxhash64(F.lit(1), "key"), F.lit(1).cast("long")
        bit = lambda k: F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(self.buckets)).cast("int")

    def add(self, keys: DataFrame, rows: int) -> None:
        """``keys`` (a written table) were met; they need not be new."""
        if rows:
            self.recent.append(keys.select("key"))
            self.waiting += rows
        if self.waiting > self.limit:
            self._fold()

    def _all_recent(self) -> DataFrame:
        out = self.recent[0]
        for more in self.recent[1:]:
            out = out.unionByName(more)
        return out

    def _fold(self) -> None:
        new = self._all_recent()
        if self.path is None:
            self.path, self.schema = session.place(self.spark, "seen"), new.withColumn("bucket", self._bucket()).schema
        dealt = new.withColumn("bucket", self._bucket()).repartition("bucket")
        dealt.write.mode("append").partitionBy("bucket").parquet(self.path)
        bits = new.select(self._word().alias("word"), self._mask().alias("bits"))
        if self.words is not None:
            bits = bits.unionByName(self.words)
        before, self.words = self.words, session.materialise(bits.groupBy("word").agg(F.bit_or("bits").alias("bits")), "seen-words", tidy=False)
        if before is not None:
            session.drop(before)
        self.recent, self.waiting = [], 0

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The rows of ``candidates``, which have a ``key`` each of its own, whose key was never met."""
        names = candidates.columns
        if self.recent:
            candidates = candidates.join(self._all_recent(), "key", "left_anti")
        if self.words is None:
            return candidates
        mask = self._mask()
        held = candidates.withColumn("_word", self._word()).join(F.broadcast(self.words.select(F.col("word").alias("_word"), "bits")), "_word", "left")  # WORDS rows at most
        told = session.materialise(held.select(*names, (F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(mask) == mask).alias("_maybe")), "candidates", tidy=False)
        maybe = told.where("_maybe").select(*names)
        touched = [r[0] for r in maybe.select(self._bucket().alias("b")).distinct().collect()]  # BUCKETS rows at most
        known = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("bucket").isin(touched)).select("key")
        return told.where("NOT _maybe").select(*names).unionByName(maybe.join(known, "key", "left_anti"))
