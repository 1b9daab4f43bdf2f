"""Phrases whose words come together more often than their parts would let one expect.

Every n-gram of one to ``longest`` words becomes a row, counted by hash aggregates that combine first within an Arrow batch, then in the
map task; one length after the other. A phrase that is seen often enough has only parts that are, so a row is made only where both
of the phrases one word shorter that lie in it (for two words: both words) may be frequent. That is read off a bitmap of the shorter
lengths' frequent phrases, hashed into ``FILTER_BITS`` bits at most and broadcast; what it lets through by chance is counted and
dropped by its exact count, so the bitmap saves rows and decides nothing. Phrases are counted by their words, not by hashes.

The rest is joins of frequent phrases with one another: the counts of the two parts of every cut, scores in Decimal, an anti-join
against extensions by one word (an equally frequent longer phrase has an equally frequent part that is one word longer), and ranks
in two steps, so no language is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import shared, words

LONGEST, LEAST, FIRST = 5, 100, 2000
UNKNOWN = "und"
#: Bits of a broadcast bitmap at most, and bits for each frequent phrase below that.
FILTER_BITS, BITS_PER_PHRASE = 1 << 26, 32
#: Bytes of texts that are taken at a time.
STRETCH = 1 << 19
#: Parts of all phrases of two words, which are most of the rows: one after the other is counted, so that their exchanges don't lie on the disks together.
PARTS = {2: 2}
_CHUNK = 1 << 15  # bits of a bitmap that Spark aggregates at a time
#: Salts of a language's first ranking.
SALTS = 64
_END, _SPACE = 0x0A, 0x20
#: Every byte as it counts here: capitals small, piece ends as line ends, tabs as spaces.
_AS = np.arange(256, dtype=np.uint8)
_AS[ord("A") : ord("Z") + 1] += 32
_AS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_AS[0x09] = _SPACE
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[_END, _SPACE]] = True
_COUNTS = "lang string, phrase string, f bigint"


def _segments(data: np.ndarray, back: int) -> Iterator[tuple[int, int, int]]:
    """(from, begin, end): stretches of ``data`` that end behind a word, each with the ``back`` words before it that are in its piece.

    Where nothing separates words for long, the stretch goes on to the next separator.
    """
    begin, start = 0, 0
    while begin < len(data):
        end = min(len(data), begin + STRETCH)
        while end < len(data) and not _SEPARATES[data[end - 1]]:
            ahead = np.flatnonzero(_SEPARATES[data[end : end + STRETCH]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(data), end + STRETCH)
        yield start, begin, end
        seen = data[start:end]
        inside = ~_SEPARATES[seen]
        inside[1:] &= ~inside[:-1]
        ends = np.flatnonzero(seen == _END)
        at = np.flatnonzero(inside)
        at = at[at > (ends[-1] if len(ends) else -1)]
        start, begin = (start + int(at[-back]) if len(at) >= back else start + int(at[0]) if len(at) else end), end


def _packed(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of a stretch one space apart; of each where it begins and ends there, its hash, its piece, and where it began in the stretch."""
    inside = ~_SEPARATES[data]
    starts, hashes = words._segment(data, breaks, False)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = breaks[(breaks > 0) & (breaks < len(data))]
    last[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(last) + 1
    piece = np.cumsum(data == _END)[starts] + np.searchsorted(breaks, starts, "right")
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), _SPACE, np.uint8)
    where = np.arange(len(out)) - np.repeat(at - starts, size)
    room = where < len(data)  # a last word ends where the data do
    out[room] = data[where[room]]
    out[at + size - 1] = _SPACE
    return out, at, at + size - 1, hashes, piece, starts


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of ``data`` between starts and ends, which may overlap."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[where]))


def _name(hashes: np.ndarray, k: int, salt: np.uint64) -> np.ndarray:
    """A hash of the ``k`` words from each word on."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, salt)
    for j in range(k):
        total += hashes[j : j + n] * words._COEF[j]
    return words.mix(total)


def _salt(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return words._segment(np.where(_SEPARATES[data], 1, data).astype(np.uint8), np.zeros(1, np.int64), False)[1].sum()


def _held(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    place = name & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = pc.fill_null(batch.column("lang"), UNKNOWN)
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.column("text").filter(pc.equal(langs, lang))


def _stretches(column: pa.Array, back: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Stretches of texts, where texts begin in each, and where what was not counted yet begins."""
    data, offsets = words.strings(column)
    for lo, hi in words.row_chunks(offsets, STRETCH):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(own):
            continue
        if hi - lo > 1 or len(own) <= STRETCH:
            yield _AS[own], at[:-1], 0
            continue
        own = _AS[own]
        for start, begin, end in _segments(own, back):
            yield own[start:end], np.zeros(1, np.int64), begin - start


def _grams(k: int, bits, part: int = 0, parts: int = 1):
    """Rows (lang, phrase, f) for one part of the phrases of ``k`` words; with ``k`` 1 also one without a phrase, the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, column in _by_lang(batch):
                salt, found, n = _salt(lang), [], 0
                for data, breaks, fresh in _stretches(column, max(1, k - 1)):
                    text, starts, ends, hashes, piece, at = _packed(data, breaks)
                    first, last = slice(0, max(0, len(starts) - k + 1)), slice(k - 1, None)
                    ok = (piece[first] == piece[last]) & (at[last] >= fresh)
                    if k > 1:
                        may = _held(bits.value, _name(hashes, k - 1, salt))
                        ok &= may[:-1] & may[1:]
                    if parts > 1:
                        ok &= (_name(hashes, k, salt) >> np.uint64(40)) % np.uint64(parts) == part
                    found.append(pc.value_counts(_slices(text, starts[first][ok], ends[last][ok])))
                    n += int(ok.sum())
                    if sum(map(len, found)) > 1 << 19:
                        yield _rows(lang, found)
                        found = []
                if k == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([n], pa.int64())], names=["lang", "phrase", "f"])
                if found:
                    yield _rows(lang, found)

    return run


def _rows(lang: str, found: list[pa.StructArray]) -> pa.RecordBatch:
    phrase = pa.concat_arrays([x.field("values") for x in found])
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(phrase)), phrase.cast(pa.string()), pa.concat_arrays([x.field("counts") for x in found])], names=["lang", "phrase", "f"])


def _places(k: int, bits: int):
    """The bit of each phrase of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, column in _by_lang(batch):
                for data, breaks, _ in _stretches(column, k):
                    *_, hashes, piece, _ = _packed(data, breaks)
                    name = _name(hashes, k, _salt(lang))[piece[: max(0, len(piece) - k + 1)] == piece[k - 1 :]]
                    yield pa.RecordBatch.from_arrays([pa.array((name & np.uint64(bits - 1)).astype(np.int64))], names=["place"])

    return run


def _bitmap(frequent: DataFrame, k: int, most: int):
    """The frequent phrases of ``k`` words as a broadcast bitmap of ``most`` bits or fewer."""
    n = max(_CHUNK, min(most, 1 << (frequent.count() * BITS_PER_PHRASE).bit_length()))
    place = frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(_places(k, n), "place bigint")
    low = F.col("place").bitwiseAND(F.lit(_CHUNK - 1).cast("long"))
    parts = place.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(low).alias("bits"))
    out = np.zeros(n // 8, np.uint8)
    for row in parts.toLocalIterator():  # n bits in all
        out[row.part * (_CHUNK // 8) :][: _CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of the phrases of ``k`` words, one to ``longest``, that occur ``least`` times or more; (lang, n) of all words."""
    texts = shared.plain(docs, lang="string", text="string")
    out, total, bits = None, None, None
    for k in range(1, longest + 1):
        counted = None
        for part in range(PARTS.get(k, 1)):
            rows = texts.mapInArrow(_grams(k, bits, part, PARTS.get(k, 1)), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            rows = shared.materialise(rows.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}")
            counted = rows if counted is None else counted.unionByName(rows)
        if bits is not None:
            bits.destroy()
        if k == 1:
            total = counted.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        counted = counted.where("phrase IS NOT NULL").withColumn("k", F.lit(k))
        out = counted if out is None else out.unionByName(counted)
        if k < longest:
            bits = _bitmap(counted, k, filter_bits)
    return out, total


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: each language's ``first`` collocations.

    A phrase of two to ``longest`` words that occurs ``least`` times or more scores floor(1000 a n / (l r)) by its weakest cut, the
    earliest of equally weak ones; phrases that lie in an equally frequent longer one go.

    Defined cases: a null language counts as ``und``, also beside rows that say so; a null text has no words; rows that repeat, with or
    without an id, count each; phrases with equal scores go by frequency, then by their bytes; other columns are ignored, whatever
    their names; an empty table gives an empty one. ``filter_bits``, a power of two from 32,768 on, changes no result.
    """
    known, total = frequent_phrases(docs, longest, least, filter_bits)
    several = known.where("k > 1").withColumnRenamed("f", "a")
    w = F.split("phrase", " ")
    part = lambda of, begin: F.array_join(F.slice(of, begin, F.col("k") - 1), " ")
    over = several.where("k > 2").select("lang", "a", F.explode(F.array(part(w, F.lit(1)), part(w, F.lit(2)))).alias("phrase")).distinct()
    alone = several.join(over, ["lang", "phrase", "a"], "left_anti")
    cuts = alone.withColumn("w", w).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    joined = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    told = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(told("head", "l"), ["lang", "head"]).join(told("rest", "r"), ["lang", "rest"]).join(total, "lang")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    product = (F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")).alias("x")
    scored = cuts.select("lang", "phrase", "a", "n", "cut", "l", "r", product, (whole("l") * whole("r")).alias("y")).withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("b"))
    rows = best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every phrase is counted here, frequent or not, and held against every longer one.
OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n::HUGEINT) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS m FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE m IS NULL OR m < a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
