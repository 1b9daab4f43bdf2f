"""Exact dedup against brute force: every row's class, and what stays."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, sha string, word string, row int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    out = []
    for s, ids in groups.items():
        ids = sorted(ids, key=lambda k: (k is None, k or 0))
        out += [(k, ids[0], len(ids), n == 0, hashlib.sha256(s.encode()).hexdigest()) for n, k in enumerate(ids)]
    return out


def order(rows):
    return sorted(rows, key=str)


def corpus(seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices("abcdefgh", k=r.choice([1, 2, 3, 9]))) for _ in range(300)]
    texts += ["the same text again\nand again"] * 150 + ["the  same\ttext again and again"] * 50 + [None, "", " ", "\n\r", "\x0b", "\x1c", "é" * 3, "x" * 2_000_000, "x" * 2_000_000 + " "]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, "the same text again and again"), (None, "only without an id"), (None, "only without an id"), (7, "tied"), (7, "tied")]


@pytest.mark.parametrize(("seed", "blocks"), [(1, 1 << 26), (2, 256)])
def test_classes(spark, seed, blocks):
    """Also with filters so small that the digests go in segments and nearly every block is hit twice."""
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "clash", "clash", 1) for k, t in rows], SCHEMA).repartition(6)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.classes(df, blocks).collect()]
    assert order(got) == order(brute(rows))


@pytest.mark.parametrize("blocks", [64])
def test_rows_that_stay(spark, blocks):
    rows = corpus(4)
    df = spark.createDataFrame([(k, t, "clash", "clash", 1) for k, t in rows], SCHEMA).repartition(5)
    out = exact_dedup.deduplicated(df, blocks)
    assert out.columns == df.columns
    assert order(r.doc_id for r in out.collect()) == order(k for k, _, _, kept, _ in brute(rows) if kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(df).count() == 0 and exact_dedup.deduplicated(df).count() == 0
    assert exact_dedup.classes(df).dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]


def test_unique_rows_do_not_shuffle(spark):
    """The filter leaves nearly all unique rows out, and keeps every repeated one."""
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    both = rows.unionByName(rows.limit(100))
    _, blocks = exact_dedup._shape(20_100, exact_dedup.FILTER_BLOCKS)
    told = exact_dedup.probed(both, exact_dedup.twice_hit(both, blocks), blocks)
    likely = told.where("suspect").count()
    assert 200 <= likely < 1500
    assert told.groupBy("sha").agg(F.count("*").alias("n"), F.min("suspect").alias("s")).where("n > 1 AND NOT s").count() == 0
