"""Substring dedup by difference-cover anchors.

Hashes of 7-word windows are taken only at word positions whose remainder modulo 7 is 1, 2
or 4. That set is a difference cover: whatever the shift between two equal passages, within
any 7 consecutive positions there is one that is in the cover on both sides. So two equal
passages of at least 13 words share an aligned anchor, and no other window needs an exchange.

1. anchors of all texts meet by key; texts that share an anchor are told so;
2. only there the match is extended: the windows of ``width`` words around a shared anchor
   meet by key, and a text learns which of its windows begin in a smaller ``doc_id`` too;
3. the words those windows cover are removed.

Both exchanges combine in the map task first, so a passage in a third of all texts costs one
entry for each map task. Texts are shuffled once, by ``doc_id``; both joins reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import shared, words
from webloom.llm.meet import meet

PERIOD = 7
COVER = np.isin(np.arange(PERIOD), [1, 2, 4])
#: Words of a passage that must repeat.
WIDTH = 13
#: Anchors travel as 48 bits. They only say where to look: one in twenty may agree by chance in a corpus of 100 TB, and
#: the windows there are then compared by 64 bits.
ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)


def _anchors(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, row, at = words.windows(hashes, before, width - PERIOD + 1)
    ok = COVER[at % PERIOD]
    return key[ok] & ANCHOR_BITS, row[ok], at[ok]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Ids, hashes and words before each row, of some rows at a time."""
    data, offsets = words.strings(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for lo, hi in words.row_chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        hashes, before = words.word_hashes(part, offsets[lo : hi + 1] - offsets[lo])
        yield slice(lo, hi), ids[lo:hi], hashes, before


def _emit_anchors(width: int):
    def emit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, ids, hashes, before in _rows(batch):
            key, row, _ = _anchors(hashes, before, width)
            yield key, ids[row]

    return emit


def _payload(cell) -> np.ndarray:
    return np.frombuffer(cell or b"", np.uint64)


def _emit_windows(width: int):
    def emit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        told = batch.column("payload").to_pylist()
        for rows, ids, hashes, before in _rows(batch):
            key, row, at = _anchors(hashes, before, width)
            bounds = np.searchsorted(row, np.arange(len(ids) + 1))
            near = np.zeros(len(hashes) + 1, np.int32)
            for k, cell in enumerate(told[rows]):
                lo, hi = bounds[k], bounds[k + 1]
                hit = at[lo:hi][np.isin(key[lo:hi], _payload(cell))] + before[k]
                np.add.at(near, np.maximum(hit - PERIOD + 1, before[k]), 1)
                np.add.at(near, hit + 1, -1)
            wanted = np.cumsum(near)[:-1] > 0
            key, row, at = words.windows(hashes, before, width)
            ok = wanted[at + before[row]]
            yield key[ok], ids[row[ok]]

    return emit


def _remove(schema: pa.Schema, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            told = batch.column("payload").to_pylist()
            some = [k for k, cell in enumerate(told) if cell]
            gone = {}
            data, offsets = words.strings(batch.column("text").take(pa.array(some, pa.int64())))
            for lo, hi in words.row_chunks(offsets):
                hashes, before = words.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                key, row, at = words.windows(hashes, before, width)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    i, j = bounds[k], bounds[k + 1]
                    first = at[i:j][np.isin(key[i:j], _payload(told[some[lo + k]]))]
                    cover = np.zeros(before[k + 1] - before[k] + 1, np.int32)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + width, -1)
                    gone[some[lo + k]] = np.cumsum(cover)[:-1] > 0
            kept, n, removed = [], [], []
            for k, text in enumerate(texts):
                own = (text or "").encode().split()  # bytes split at exactly 0x20 and 0x09-0x0D
                n.append(len(own))
                mask = gone.get(k)
                if mask is not None:
                    own = list(compress(own, ~mask))
                removed.append(n[-1] - len(own))
                kept.append(b" ".join(own).decode())
            cols = [batch.column(f.name) for f in list(schema)[:-3]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], schema=schema)

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``text``, ``kept_text``, ``n_words``, ``n_removed`` for every row of ``docs``.

    A word goes if a window of ``width`` (13 or more) consecutive words that covers it also begins
    in a document with a smaller ``doc_id``; windows are judged on the input. ``kept_text`` has the
    words that stay, joined by one space.

    Defined cases: a null text has no words; a row with a null ``doc_id`` is kept as it is and
    removes nothing elsewhere; rows that repeat a ``doc_id`` don't remove one another's words, and
    what one loses to a smaller id the others lose too; within one document repeats stay; other
    columns are ignored, whatever their names; an empty table gives an empty one. Windows are
    compared by 64-bit hashes, and only where a shorter anchor agreed as well.
    """
    if width < 2 * PERIOD - 1:
        raise ValueError(f"width must be {2 * PERIOD - 1} or more")
    docs = shared.plain(docs, doc_id="bigint", text="string")
    n = shared.buckets(docs)
    named = docs.where(F.col("doc_id").isNotNull())
    # Both joins merge, at every size, so that the texts' exchange is one and the same.
    told = lambda answers: answers.withColumnRenamed("id", "doc_id").hint("merge")
    flagged = told(meet(named, _emit_anchors(width), "shared", n))
    again = named.join(flagged, "doc_id")
    found = told(meet(again, _emit_windows(width), "later", n))
    out = T.StructType([*docs.schema, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    rest = docs.where(F.col("doc_id").isNull()).withColumn("payload", F.lit(None).cast("binary"))
    return named.join(found, "doc_id", "left").unionByName(rest).mapInArrow(_remove(arrow, width), out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: A window is told by its whole word sequence here, not by a hash.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''), []) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
seq AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM seq) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM dup) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(g, k)), lambda k: w[k]) END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
