"""Line dedup by a deletion-neighbourhood join.

The edit unit is the word. Every line with a word is compared; the bound is one edit (a word put in, taken out or
replaced) for lines of at least ``near_words`` words, of which one edit changes an eighth or less, and none for
shorter ones. A line goes if a line within the bound comes earlier, by ``doc_id`` and then line number; lines are
judged on the input.

1. Equal lines are brought together by a 128-bit hash; each keeps its earliest place.
2. Two lines within one edit agree in their first m or in their last m words, for every m up to
   half of the shorter one's words. Only lines that share such a head or tail with another line have
   a neighbour, so only they are expanded; this drops no pair.
3. Each of those emits the hashed keys of its deletion neighbourhood: itself and every variant
   with one word left out, a variant with the place of the gap. Lines with equal variants and gaps differ
   in one replaced word; a line that equals another's variant differs by one word taken out. The earliest
   place of each key is an aggregate, so no pairs within a group are made, and it is joined back.
4. The two texts behind every candidate are compared word by word, which verifies the distance; the
   earliest that holds decides. Variants are told by 64 bits of their words in order: only where two
   unlike ones had the same by chance could the earliest of them stand before another one's true neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import shared

#: Words of a line from which on one edit is allowed: a parameter.
NEAR_WORDS = 8
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place(doc: Column, line: Column) -> Column:
    return F.struct(doc.alias("doc_id"), line.alias("line"))


def _has_odd_space(text: Column) -> Column:
    """Whether words may be apart by anything but one space or a line end."""
    out = F.contains(text, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        out = out | F.contains(text, F.lit(c))
    return out


def _plain(line: Column, odd: Column) -> Column:
    """A line's words, joined by one space."""
    return F.when(odd, F.trim(F.regexp_replace(line, _SPACE, " "))).otherwise(F.trim(line))


def _end(s: Column, m: Column, tail: bool) -> Column:
    """Hash of a line's first or last ``m`` words."""
    return F.xxhash64(F.lit("tail" if tail else "head"), m, F.call_function("substring_index", s, F.lit(" "), -m if tail else m))


def _half(n: Column) -> Column:
    """The largest power of two up to half of ``n``."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.floor(n / 2))) - 1)


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of the lines of each document that go.

    ``docs`` must have ``doc_id`` and ``text``, both without nulls, and them only. Where an exploded array is never empty the outer
    form is used: for the other one the optimizer adds a filter that works the array out again.
    """
    s, n = F.col("s"), F.col("n")
    odd = docs.select("doc_id", "text", _has_odd_space(F.col("text")).alias("odd"))  # once for a text, so below the explode
    split = odd.select("doc_id", "odd", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "text"))
    lines = split.select("doc_id", "line", _plain(F.col("text"), F.col("odd")).alias("s")).where(s != "")
    name = [F.xxhash64(s).alias("h"), F.xxhash64(F.lit(7), s).alias("g")]
    # Heads and tails of two sizes, where a line one word shorter takes another. Small projections keep the generated methods
    # small enough to be compiled.
    marked = lines.select("doc_id", "line", "s", F.size(F.split(s, " ")).alias("n"))
    marked = marked.select("doc_id", "line", "s", F.when(n >= near_words, _half(n)).alias("m"), F.when((n > near_words) & (_half(n) != _half(n - 1)), _half(n - 1)).alias("k"))
    m, k = F.col("m"), F.col("k")
    e = [F.when(x.isNotNull(), _end(s, x, tail)) for x in (m, k) for tail in (False, True)]
    marked = marked.select("doc_id", "line", *name, *[c.alias(f"e{i}") for i, c in enumerate(e)])
    first = marked.groupBy("h", "g").agg(F.min(_place(F.col("doc_id"), F.col("line"))).alias("first"), *[F.first(f"e{i}").alias(f"e{i}") for i in range(4)], F.count("*").alias("n"))
    first = shared.keep(first)
    ends = first.where("e0 IS NOT NULL").select("first", F.explode(F.array("e0", "e1", "e2", "e3")).alias("end")).where("end IS NOT NULL")
    common = ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select("end")
    near = ends.join(common, "end").select("first").distinct()
    # The words of those lines, from the documents where they come first; picked within the row, as an explode would copy the text.
    asked = near.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.line").alias("asked"))
    picked = _let(F.split("text", "\n", -1), lambda x: F.transform("asked", lambda i: F.struct(i.alias("line"), F.get(x, i).alias("text"))))
    texts = docs.join(asked.hint("merge"), "doc_id").select("doc_id", F.explode_outer(picked).alias("p"))
    texts = texts.select(_place(F.col("doc_id"), F.col("p.line")).alias("first"), _plain(F.col("p.text"), F.lit(True)).alias("s"))
    texts = shared.materialise(texts.hint("rebalance"), "near-lines")  # written, so that the texts' exchange can go
    def variants(w: Column) -> Column:
        """Of each gap the hash of the line without that word, and of the line itself.

        A sequence's hash is the xor of its words' hashes, each taken with the word's place. In a variant the words behind
        the gap move up one place, so it is made of xors up to the gap. Those come from rounds that double how far
        back each one reaches: a line of n words takes n log n steps.
        """
        n = F.size(w)
        at = lambda k, place: F.xxhash64(F.get(w, k), place)
        # The first variant, then what turns each into the next one, the line itself being the last.
        behind = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda t, k: F.when(k == 0, t).otherwise(t.bitwiseXOR(at(k, k - 1))))
        turn = lambda k: at(k - 1, k - 1).bitwiseXOR(F.when(k == n, F.lit(0).cast("bigint")).otherwise(at(k, k - 1)))
        steps = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, behind).otherwise(turn(k)))
        reach = F.transform(F.sequence(F.lit(0), F.length(F.bin(n)) - 1), lambda j: F.call_function("shiftleft", F.lit(1), j))
        xors = F.aggregate(reach, steps, lambda x, far: F.transform(x, lambda v, i: F.when(i < far, v).otherwise(v.bitwiseXOR(F.get(x, i - far)))))
        return F.transform(xors, lambda v, i: F.struct(v.alias("v"), F.when(i == n, F.lit(-1)).otherwise(i).alias("gap")))

    # Worked out twice, for the count and for the join: that is cheaper than to keep them.
    keys = texts.select("first", F.explode_outer(_let(F.split("s", " "), variants)).alias("k")).select("first", "k.v", "k.gap")
    # Of two lines or more: a line's own gaps share a variant where it repeats a word.
    one = F.xxhash64("first")
    shared_keys = keys.groupBy("v").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("v")
    keys = shared.materialise(keys.join(shared_keys, "v").hint("rebalance"), "shared-variants")
    # Of each variant: the earliest line with it at each gap, and the line that equals it.
    best = keys.groupBy("v", "gap").agg(F.min("first").alias("best"), F.count("*").alias("n"))
    whole = best.where("gap = -1").select("v", F.col("best").alias("whole"))
    gaps = best.where("gap >= 0")
    shorter = gaps.groupBy("v").agg(F.min("best").alias("best"))
    told = keys.where("gap >= 0").join(gaps.where("n > 1").select("v", "gap", "best"), ["v", "gap"]).select("first", "best")
    told = told.unionByName(keys.where("gap >= 0").join(whole, "v").select("first", F.col("whole").alias("best")))
    told = told.unionByName(keys.where("gap = -1").join(shorter, "v").select("first", "best"))
    told = told.where("best < first").distinct()  # each is verified, so that one that fails hides no other
    told = told.join(texts, "first").join(texts.select(F.col("first").alias("best"), F.col("s").alias("other")), "best")
    told = told.where(_within_one(F.split("s", " "), F.split("other", " "))).groupBy("first").agg(F.min("best").alias("best"))
    # Every occurrence of a line but the earliest goes, and the earliest where a neighbour comes before it.
    least = first.select("h", "g", "first", "n").join(told, "first", "left").where("n > 1 OR best IS NOT NULL").select("h", "g", F.coalesce("best", "first").alias("keep"))
    gone = lines.select("doc_id", "line", *name).join(least, ["h", "g"]).where(F.col("keep") < _place(F.col("doc_id"), F.col("line")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _within_one(a: Column, b: Column) -> Column:
    """Whether one edit at most turns word list a into b: what heads and tails share leaves one word."""

    def decide(x: Column) -> Column:
        p, q = x["a"], x["b"]
        least = F.least(F.size(p), F.size(q))

        def run(same) -> Column:
            differs = F.array_position(F.transform(F.sequence(F.lit(0), least - 1), same), F.lit(False))
            return F.when(differs == 0, least).otherwise(differs - 1)

        head = run(lambda j: F.get(p, j) == F.get(q, j))
        tail = run(lambda j: F.get(p, F.size(p) - 1 - j) == F.get(q, F.size(q) - 1 - j))
        return (F.abs(F.size(p) - F.size(q)) <= 1) & (head + tail >= F.greatest(F.size(p), F.size(q)) - 1)

    return _let(F.struct(a.alias("a"), b.alias("b")), decide)


def line_dedup(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``text`` without the lines that go, ``n_lines`` and ``n_removed``.

    Lines are split at \\n and joined again by it; lines without a word stay.

    Defined cases: a null text stays null and has no lines; a row with a null ``doc_id`` stays as
    it is; of rows that repeat a ``doc_id`` each loses the lines that the id loses, and lines of equal
    place count as one; ties cannot occur otherwise; other columns stay, but ``n_lines`` and
    ``n_removed`` of the input are replaced; an empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    plain = shared.plain(docs, doc_id="bigint", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = removed_lines(plain, near_words).toDF("id", "gone").hint("merge")
    # In a struct the columns' names clash with none of these.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    out = rows.join(gone, "id", "left")
    text = F.col("row.text").cast("string")
    split = F.split(text, "\n", -1)
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(_let(split, stay), "\n"))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    return out.select(*[(kept if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns], n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: Texts that stay for each document: (doc_id, text, n_lines, n_removed).
KEPT_SQL = r"""
l AS (SELECT doc_id, i - 1 AS i, x[i] AS line, list_filter(string_split_regex(x[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(x) + 1)) AS i FROM {documents} WHERE text IS NOT NULL)),
u AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min(doc_id * 100000000 + i) AS first FROM l WHERE len(w) >= 1 GROUP BY 1),
v AS (SELECT s, first, k, array_to_string(list_concat(w[:k - 1], w[k + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM u WHERE len(w) >= 8)),
t AS (SELECT s, min(first) OVER (PARTITION BY v, k) AS best FROM v
  UNION ALL SELECT v.s, u.first FROM v JOIN u ON u.s = v.v AND len(u.w) >= 8
  UNION ALL SELECT u.s, v.first FROM u JOIN v ON u.s = v.v AND len(u.w) >= 8
  UNION ALL SELECT s, first FROM u),
m AS (SELECT s, min(best) AS best FROM t GROUP BY s),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (best < l.doc_id * 100000000 + i) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (best IS NULL OR best >= l.doc_id * 100000000 + i), '') AS text
  FROM l LEFT JOIN m ON len(l.w) >= 1 AND m.s = array_to_string(l.w, ' ') GROUP BY l.doc_id)
"""
OP2_SQL = "WITH " + KEPT_SQL.replace("{documents}", "documents") + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept.text) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
