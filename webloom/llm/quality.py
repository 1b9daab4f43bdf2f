"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one failure bit
for each rule. A policy is a named version, a mask of the rules that reject; applying one, or
working out what a rule alone rejects, only reads the ledger's bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SYMBOLS = "[#*$%&|<>]"

#: Rules by bit, over the measurements; the first two are the base.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 30 * m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    "shouting": lambda m: 100 * m["n_upper"] > 60 * m["word_chars"],
}
#: Versions of the policy: the rules that reject.
BASE = ("few_words", "repeated_windows")
POLICIES = {"base": BASE, "v1": (*BASE, "symbols"), "v2": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in set(rules))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    A window is first a long, its hash above and its place below, so that one sort of longs brings equal ones together. Those that
    share their hash's bits with another are then told apart by their words, in a second sort.
    """
    n = F.size(w)
    bits = F.greatest(F.ceil(F.log2(n.cast("double"))), F.lit(1)).cast("int")
    up, down = (lambda x, b, f=f: F.call_function(f, x, b) for f in ("shiftleft", "shiftrightunsigned"))

    def repeats(found: Column, name: Callable[[Column], Column]) -> Column:
        """Of a sorted array what has the same name as what stands before or behind it."""
        same = lambda s, i, x: F.coalesce(name(F.get(s, i)) == name(x), F.lit(False))
        return _let(found, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))

    def of(b: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: up(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long")))
        place = lambda x: x.bitwiseAND(up(F.lit(1).cast("long"), b) - 1).cast("int")
        likely = repeats(F.sort_array(keys), lambda x: down(x, b))
        window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))
        found = repeats(F.array_sort(F.transform(likely, lambda x: _let(place(x), window))), lambda x: x["s"])
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: x["i"] + k)))))

    return F.when(n < 4, F.lit(0)).otherwise(_let(bits, of))


def measurements(text: Column) -> Column:
    """struct of a text's measurements."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long = lambda x, name: x.cast("long").alias(name)

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        of_words = lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("r"))
        of_lines = lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))
        parts = F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"))
        return _let(parts, lambda p: F.struct(
            long(p["w"]["n"], "n_words"), long(p["w"]["chars"], "word_chars"), long(F.regexp_count(t, F.lit(_SYMBOLS)), "n_symbols"), long(p["l"]["n"] - p["l"]["d"], "n_dup_lines"),
            long(p["w"]["r"], "n_repeat_words"), long(p["l"]["n"], "n_lines"), long(F.regexp_count(t, F.lit("[A-Z]")), "n_upper"),
        ))

    return _let(text, of)


def failures(m: Column) -> Column:
    """The bits of the rules that measurements fail."""
    return sum((F.when(rule(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed``, the bits of the rules that each document fails.

    Defined cases: a null text has no words and fails ``few_words``; a null ``doc_id`` and repeated
    rows each get their row; columns other than ``doc_id`` and ``text`` are ignored, whatever their
    names; an empty table gives an empty ledger.
    """
    return docs.select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*", failures(F.col("m")).alias("failed"))


def _hits(failed: Column, rules: tuple[str, ...]) -> Column:
    return failed.bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def apply_policy(book: DataFrame, version: str = "v2") -> DataFrame:
    """``base_failed`` and ``kept`` of a ledger under a policy."""
    base = _hits(F.col("failed"), BASE)
    return book.withColumn("base_failed", base).withColumn("kept", ~(_hits(F.col("failed"), POLICIES[version]) | F.col("base_failed")))


def ablations(book: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    rejects = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    by = book.groupBy(rejects.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 to the number of rules
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[version]])
    each = by.select("n", "bits", F.explode(names).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def passing(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns; no exchange.

    The verdict decides what a generator gives: a filter would be pushed down and work the measurements out once for each of
    its mentions of them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = _let(measurements(F.col("text")), lambda m: ~_hits(failures(m), (*POLICIES[version], *BASE)))
    found = docs.select(F.explode_outer(F.when(kept, F.array(row))).alias("row")).where("row IS NOT NULL")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = apply_policy(ledger(docs.select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


#: Measurements and failure bits of each document.
LEDGER_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {documents}),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT k) AS r FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM win WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM t LEFT JOIN rep USING (doc_id)),
book AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed FROM m)
"""
OP5_SQL = "WITH " + LEDGER_SQL.replace("{documents}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM book
"""
