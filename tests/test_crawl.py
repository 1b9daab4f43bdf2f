"""Crawls against a plain walk: budgets, blocked pages, resumed and restarted ones, an index that is folded often."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from webloom.functions.scope import Scope
from webloom.operators import frontier
from webloom.operators.journal import Journal, Stopped
from webloom.operators.seen import Seen

EDGES, SEEDS = "src bigint, dst bigint, pos int", "key bigint, seq bigint"


def walk(edges, seeds, scope, expands=None, blocked=(), queued=(), captured=()):
    """(admitted: key -> (depth, seq, parent), deferred: key -> depth, refused: key -> depth), level by level."""
    out = {}
    for src, dst, pos in sorted(edges, key=lambda e: (e[0], e[2])):
        out.setdefault(src, []).append(dst)
    admitted, deferred, refused, used = {}, {}, {}, len(set(captured))
    due = {}
    for key, depth in queued:
        due[key] = min(depth, due.get(key, depth))
    level, depth = [(k, None) for k, _ in sorted(seeds, key=lambda s: (s[1], s[0]))], 0
    last = max(due.values(), default=0)
    while True:
        now = []
        for key, parent in level:
            if key in admitted or key in captured or key in refused:
                continue
            if key in blocked:
                refused[key] = depth
            elif scope.max_pages and used >= scope.max_pages:
                deferred.setdefault(key, depth)
            else:
                admitted[key] = (depth, len(now), parent)
                used += 1
                now.append(key)
        links = [(d, k) for k in now if expands is None or k in expands for d in out.get(k, [])]
        if depth >= scope.max_depth:
            for d, _ in links:
                deferred.setdefault(d, depth + 1)
            links = []
        level = [(k, None) for k in sorted(due) if due[k] == depth + 1] + links
        if not level and depth >= last:
            break
        depth += 1
    return admitted, {k: d for k, d in deferred.items() if k not in admitted and k not in captured and k not in refused}, refused


def graph(seed, n=120):
    r = random.Random(seed)
    edges = {(r.randrange(n), r.choice([r.randrange(n), n + r.randrange(40), 5]), p) for p in range(4) for _ in range(n)}
    unique = {(s, p): (s, d, p) for s, d, p in sorted(edges)}
    return sorted(unique.values()), [(k, i) for i, k in enumerate(r.sample(range(n), 3))], r


def keyed(df, *columns):
    return {r.key: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


@pytest.mark.parametrize(("seed", "depth", "budget"), [(1, 4, 0), (2, 6, 30), (3, 2, 9)])
def test_crawl_with_an_index_that_is_folded(spark, seed, depth, budget):
    edges, seeds, r = graph(seed)
    blocked, expands = set(r.sample(range(160), 20)), set(range(0, 160)) - set(r.sample(range(160), 30))
    scope = Scope(max_depth=depth, max_pages=budget)
    as_keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "key bigint")
    seen = Seen(spark, recent=2, buckets=16, words=4)
    got = frontier.crawl_with_refused(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS), scope, as_keys(expands), None, as_keys(blocked), seen=seen)
    want = walk(edges, seeds, scope, expands, blocked)
    assert (keyed(got[0], "depth", "seq", "parent"), keyed(got[1], "depth"), keyed(got[2], "depth")) == want
    assert seen.words is not None


def test_seen_reads_the_buckets_that_are_asked(spark):
    seen = Seen(spark, recent=100, buckets=64, words=1 << 12)
    for k in range(5):
        seen.add(spark.range(k * 1000, k * 1000 + 1000).withColumnRenamed("id", "key"), 1000)
    ask = spark.createDataFrame([(3, "old"), (4999, "old"), (5000, "new"), (9999, "new")], "key bigint, name string")
    assert {(r.key, r.name) for r in seen.unseen(ask).collect()} == {(5000, "new"), (9999, "new")}
    assert seen.unseen(ask.limit(0)).count() == 0
    few = seen.unseen(ask.where("key = 3"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 0 and re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", plan), plan


@pytest.mark.parametrize("budget", [0, 60])
def test_crawl_on(spark, budget):
    """What was captured takes its part of the budget; what failed and what it led to comes again at its depth."""
    edges, seeds, r = graph(7)
    pages = [(k, r.randrange(3), "timeout" if r.random() < 0.3 else None) for k in r.sample(range(120), 40)]
    scope = Scope(max_depth=4, max_pages=budget)
    good = {k: d for k, d, e in pages if e is None}
    queued = [(d, good[s] + 1) for s, d, _ in edges if s in good and d not in good]
    got = frontier.crawl_on(spark.createDataFrame(pages, "key bigint, depth int, error string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS), scope)
    want = walk(edges, seeds, scope, queued=queued, captured=set(good))
    assert (keyed(got[0], "depth", "seq", "parent"), keyed(got[1], "depth")) == want[:2]
    if budget:
        assert len(good) < len(good) + len(want[0]) == budget


def test_a_stopped_crawl_goes_on(spark):
    edges, seeds, r = graph(9)
    scope, run = Scope(max_depth=5, max_pages=70), f"test-{uuid.uuid4().hex}"
    blocked = spark.createDataFrame([(k,) for k in r.sample(range(160), 25)], "key bigint")
    args = (spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS), scope, None, None, blocked)
    whole = [sorted(map(tuple, df.collect()), key=str) for df in frontier.crawl_with_refused(*args)]
    settings, made = {"max_depth": 5}, []
    for _ in range(20):
        journal = Journal(spark, run, settings, pause_after=3)
        try:
            got = frontier.crawl_with_refused(*args, journal)
            break
        except Stopped:
            assert len(journal.made) == 3
        finally:
            made += journal.made
    assert [sorted(map(tuple, df.collect()), key=str) for df in got] == whole
    assert len(made) == len(set(made)) > 6 and sorted(made) == journal.steps()
    again = Journal(spark, run, settings, pause_after=0)  # nothing is left to be made
    assert [sorted(map(tuple, df.collect()), key=str) for df in frontier.crawl_with_refused(*args, again)] == whole
    with pytest.raises(ValueError, match="other settings"):
        Journal(spark, run, {"max_depth": 6})
    with pytest.raises(ValueError, match="not a name"):
        Journal(spark, "../x")
    again.forget()
    assert Journal(spark, run, settings).steps() == []


def test_half_a_step_never_happened(spark):
    journal = Journal(spark, f"test-{uuid.uuid4().hex}")

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        journal.step("a", fails)
    assert journal.steps() == []
    df, facts = journal.step("a", lambda: spark.range(3), lambda df: {"rows": df.count(), "text": "é\n"})
    assert df.count() == 3 and facts == {"rows": 3, "text": "é\n"}
    df, facts = journal.step("a", fails)
    assert df.count() == 3 and facts == {"rows": 3, "text": "é\n"}
    journal.forget()


def test_robots_by_beginnings(spark):
    """The first of all rules that match decides, as in a scan of the rules; 10,000 rules of one host make no more rows than lengths."""
    r = random.Random(3)
    path = lambda n: "/" + "".join(r.choices("ab/%é", k=n))
    rules = [(o, k, r.random() < 0.4, r.choice([path(r.randrange(5)), "", "/"]) if r.random() < 0.9 else None) for o in ("h", "g") for k in range(40)]
    urls = [(r.choice(["h", "g", "free"]), path(r.randrange(8))) for _ in range(400)]
    got = frontier.allowed(spark.createDataFrame(urls, "origin string, target string"), spark.createDataFrame(rules, "origin string, seq int, allow boolean, prefix string")).collect()
    for row in got:
        first = next((a for o, _, a, p in rules if o == row.origin and p is not None and row.target.startswith(p)), True)
        assert row.allowed == first, row
    assert len(got) == len(urls)
    many = spark.range(10_000).select(F.lit("h").alias("origin"), F.col("id").cast("int").alias("seq"), (F.col("id") % 2 == 0).alias("allow"), F.format_string("/p%05d", "id").alias("prefix"))
    asked = spark.range(20_000).select(F.lit("h").alias("origin"), F.format_string("/p%05d/x", "id").alias("target"))
    assert frontier.allowed(asked, many).where("allowed").count() == 15_000
