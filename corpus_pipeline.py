"""Documents to packed training sequences in five stages, each an operator of ``webloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last give the
columns of ``documents``. ``run`` writes what each stage gives to the shared folder, so a
lost executor never costs an earlier stage, and deletes it when the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.llm import line_dedup, mixing, ngram_join, packing, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    session.ship(spark)
    return quality.passing(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come earlier, or within one word of it, go; ``n_chars`` follows the text."""
    session.ship(spark)
    out = line_dedup.line_dedup(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; rows without an id stay too.

    Near copies share 80 of 100 of their distinct five-word shingles, the operator's own measure.
    """
    session.ship(spark)
    first = ngram_join.near_copies(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights."""
    session.ship(spark)
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    session.ship(spark)
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]
#: SQL has no tokenizer for the last stage; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        shared.drop(before)
        session.unkeep()
    return STAGES[-1][1](spark, docs, sf_dir)
