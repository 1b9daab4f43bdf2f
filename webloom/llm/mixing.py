"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell, a cell being (source, language, topic) with every source and language that the
targets don't name under ``other``. So the cells are as many as the targets ask for, however large the corpus
is. The tokens to keep of each cell start at the wanted share of what it has and are raked to the three marginals in turn,
never above what the cell has: what a full cell cannot give, the others of its category give in the next rounds.
All of that is within one row of SQL. A document's probability is its cell's fitted tokens over those it has.
Sampling compares it with a hash of ``doc_id``, so it is repeatable and needs no exchange. ``residuals`` tells how
far each category is from its target, which can only be where all tokens of a category are too few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Wanted token shares; a marginal's shares are scaled to 1 over the categories that occur.

    The default ones even out twenty sources. ``keep`` is the share of all tokens that stays, ``rounds`` how often each marginal is
    raked to.
    """

    source: dict[str, float] = field(default_factory=lambda: {f"src{k}": 0.05 for k in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.1, OTHER: 0.01})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.95, "notice": 0.02, "table": 0.03})
    keep: float = 0.6
    rounds: int = 25
    seed: str = "mix"

    def marginals(self) -> list[tuple[str, dict[str, float]]]:
        return [(name, getattr(self, name)) for name in DIMENSIONS]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def topic_of(text: Column) -> Column:
    """A text with ``|`` in it is a table, one that shouts (``!!``) a notice, any other prose."""
    return F.when(F.contains(text, F.lit("|")), "table").when(F.contains(text, F.lit("!!")), "notice").otherwise("prose")


def cells(docs: DataFrame, targets: Targets, topic=topic_of) -> DataFrame:
    """``doc_id``, the three categories and ``tokens`` (words) of each document, beside ``_row``, all its columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c, want: F.when(F.col(c).isin([k for k in want if k != OTHER]), F.col(c)).otherwise(OTHER)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), named("source", targets.source).alias("source"), named("lang", targets.lang).alias("lang"), topic(text).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda total, x: total + x)


def _rake(at: Column, want: Column, whole: Column, has: Column, w: Column) -> Column:
    """Tokens ``w`` of the cells scaled to one marginal, but no more than each cell ``has``.

    ``at``: the cells' categories by number, -1 for a cell outside the marginal, which stays as it is; ``want``: their shares.
    """

    def of_category(k: Column) -> Column:
        return _sum(F.zip_with(at, w, lambda a, x: F.when(a == k, x).otherwise(0.0)))

    def scaled(parts: Column) -> Column:
        inside = whole - (_sum(w) - _sum(parts))  # what cells outside the marginal leave for it
        there = _sum(F.zip_with(parts, want, lambda x, v: F.when(x > 0, v).otherwise(0.0)))
        steps = F.zip_with(parts, want, lambda x, v: F.when((x > 0) & (there > 0), v / there * inside / x).otherwise(1.0))
        factor = lambda step, i: F.when(F.get(at, i) >= 0, F.get(step, F.get(at, i))).otherwise(1.0)
        return _let(steps, lambda step: F.transform(w, lambda x, i: F.least(F.get(has, i), x * factor(step, i))))

    return _let(F.transform(F.sequence(F.lit(0), F.size(want) - 1), of_category), scaled)


def factors(rows: DataFrame, targets: Targets) -> DataFrame:
    """(source, lang, topic, p) of each cell; one small row is worked on."""
    sums = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("w")).where("w > 0")
    one = sums.agg(F.array_sort(F.collect_list(F.struct(*DIMENSIONS, "w"))).alias("c"))

    def number(name: str, want: dict[str, float]) -> Column:
        names = F.array(*[F.lit(k) for k in want])
        return F.transform("c", lambda x: F.array_position(names, x[name]).cast("int") - 1)

    has = F.transform("c", lambda x: x["w"])
    setup = F.struct(
        F.col("c"), has.alias("has"), (_sum(has) * targets.keep).alias("whole"),
        F.array(*[number(name, want) for name, want in targets.marginals()]).alias("at"),
        F.array(*[F.array(*[F.lit(float(v)) for v in want.values()]) for _, want in targets.marginals()]).alias("want"),
    )

    def fit(s: Column) -> Column:
        start = F.transform(s["has"], lambda x: x * targets.keep).cast("array<double>")

        def turn(w: Column, k: Column) -> Column:
            k = F.pmod(k, F.lit(len(DIMENSIONS)))
            return _rake(F.get(s["at"], k), F.get(s["want"], k), s["whole"], s["has"], w).cast("array<double>")

        fitted = F.aggregate(F.sequence(F.lit(0), F.lit(len(DIMENSIONS) * targets.rounds - 1)), start, turn)
        share = lambda c, f: F.struct(*[c[d].alias(d) for d in DIMENSIONS], (f / c["w"]).alias("p"))
        return F.zip_with(s["c"], fitted, share)

    return one.where(F.size("c") > 0).select(F.explode(_let(setup, fit)).alias("x")).select("x.*")


def chance(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that follows from ``doc_id``: 48 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, targets: Targets | None = None, topic=topic_of) -> DataFrame:
    """Each document with its cell, ``tokens``, probability ``p`` and whether it is ``kept``; ``_row`` has its columns.

    Defined cases: null or unlisted sources and languages fall under ``other``; a document without words
    is in no cell that has tokens by itself and takes its cell's probability, or 1 where the cell has none; a null
    ``doc_id`` is sampled as one id; rows that repeat a ``doc_id`` are kept or left together within a
    cell; a category of the targets that doesn't occur is left out and the shares of the others grow; a category that
    no target names (a topic, or ``other`` where it isn't listed) keeps its weight within the others' fitting;
    where targets ask for more of a category than there is, its documents all stay, ``residuals`` tells what is missing, and
    the other categories make up for it as far as their own targets let them; an empty table gives an empty one.
    """
    targets = targets or Targets()
    rows = cells(docs, targets, topic)
    # At most one row for each combination of named categories, whatever the corpus holds.
    fitted = F.broadcast(factors(rows.drop("_row"), targets))
    out = rows.join(fitted, ["source", "lang", "topic"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return out.withColumn("kept", chance(F.col("doc_id"), targets.seed) < F.col("p"))


def sampled(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    return mix(docs, targets).where("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def residuals(mixed: DataFrame, targets: Targets | None = None) -> DataFrame:
    """For each category of each marginal: its share of the tokens before, wanted, expected and kept.

    ``mixed`` is what ``mix`` gave. ``wanted`` is scaled to 1 over the categories that occur, null for one that no target names.
    """
    targets = targets or Targets()
    tokens = {"before": F.col("tokens"), "expected": F.col("p") * F.col("tokens"), "kept": F.when(F.col("kept"), F.col("tokens")).otherwise(0)}
    dims = F.array(*[F.struct(F.lit(d).alias("marginal"), F.col(d).alias("category")) for d in DIMENSIONS])
    sums = mixed.groupBy(*DIMENSIONS).agg(*[F.sum(x).cast("double").alias(k) for k, x in tokens.items()])
    by = sums.select(F.explode(dims).alias("d"), *tokens).groupBy("d.marginal", "d.category").agg(*[F.sum(k).alias(k) for k in tokens])
    want = [(d, k, float(v)) for d, shares in targets.marginals() for k, v in shares.items()]
    by = by.join(mixed.sparkSession.createDataFrame(want, "marginal string, category string, wanted double"), ["marginal", "category"], "left")
    whole = by.groupBy("marginal").agg(*[F.sum(k).alias(f"all_{k}") for k in tokens], F.sum(F.when(F.col("before") > 0, F.col("wanted"))).alias("all_wanted"))
    return by.join(whole, "marginal").select("marginal", "category", *[(F.col(k) / F.col(f"all_{k}")).alias(k) for k in ("before", "wanted", "expected", "kept")])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"), "kept")


def _sql(targets: Targets, documents: str) -> str:
    listed = lambda want: ", ".join(f"'{k}'" for k in want if k != OTHER)
    values = ", ".join(f"('{d}', '{k}', {float(v)!r}::DOUBLE)" for d, want in targets.marginals() for k, v in want.items())

    def rake(d: str, inner: str) -> str:
        return f"""SELECT s.source, s.lang, s.topic, s.w, s.k, least(s.w, s.f * coalesce(v / there * whole / part, 1.0)) AS f FROM (
      SELECT x.*, v, sum(x.f) OVER (PARTITION BY x.{d}) AS part, {targets.keep!r} * sum(x.w) OVER () - sum(CASE WHEN v IS NULL THEN x.f ELSE 0.0 END) OVER () AS whole,
        sum(v / cnt) OVER () AS there FROM (SELECT y.*, t.v, count(*) OVER (PARTITION BY y.{d}) AS cnt FROM ({inner}) y LEFT JOIN want t ON t.d = '{d}' AND t.c = y.{d}) x) s"""

    turn = rake("topic", rake("lang", rake("source", f"SELECT * FROM fit WHERE k < {targets.rounds}")))
    return f"""want(d, c, v) AS (VALUES {values}),
rows_ AS (SELECT doc_id, CASE WHEN source IN ({listed(targets.source)}) THEN source ELSE 'other' END AS source, CASE WHEN lang IN ({listed(targets.lang)}) THEN lang ELSE 'other' END AS lang,
  CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN contains(coalesce(text, ''), '!!') THEN 'notice' ELSE 'prose' END AS topic,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM {documents}),
cell AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS w FROM rows_ GROUP BY ALL HAVING sum(tokens) > 0),
fit(source, lang, topic, w, k, f) AS (SELECT source, lang, topic, w, 0, {targets.keep!r} * w FROM cell UNION ALL SELECT source, lang, topic, w, k + 1, f FROM ({turn})),
mixed AS (SELECT x.*, coalesce((SELECT f / w FROM fit c WHERE k = {targets.rounds} AND c.source = x.source AND c.lang = x.lang AND c.topic = x.topic), 1.0) AS p,
  CAST('0x' || substr(md5('{targets.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u FROM rows_ x)"""


OP4_SQL = "WITH RECURSIVE " + _sql(Targets(), "documents") + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p, u < p AS kept FROM mixed"
