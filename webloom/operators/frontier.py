"""The crawl frontier as a fixpoint over a corpus: breadth first, level by level.

A level's pages are joined with the link table; what they lead to is reduced to the first mention of each key, held
against the keys already seen, ordered by (place of the parent, place in it) and cut at the page budget. Each level is
written once, so lineage doesn't grow and a lost executor costs no earlier level; with a journal a crawl that was stopped goes on
behind its last whole level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import session
from webloom.functions.scope import Scope
from webloom.operators.journal import Facts, Journal, Unkept
from webloom.operators.seen import Seen


def _first_mention(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("key").agg(F.min(F.struct("parent_seq", "pos", "parent")).alias("f")).select("key", "f.parent_seq", "f.pos", "f.parent")


def admit(candidates: DataFrame, seen: DataFrame, room: int | None) -> tuple[DataFrame, DataFrame]:
    """Candidates (key, parent, parent_seq, pos) to the admitted ones (with ``seq`` from 0) and those beyond the budget."""
    ranked = number(_first_mention(candidates).join(seen.select("key"), "key", "left_anti"), ["parent_seq", "pos", "key"])
    if room is None:
        return ranked, ranked.limit(0)
    return ranked.where(F.col("seq") < room), ranked.where(F.col("seq") >= room)


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in ranges of ``order``, sorted within them, with ``_at``: the range above, the place in it below."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def _ranges(dealt: DataFrame) -> Facts:
    """Of a written table of ``_dealt`` the rows, and those before each range: one number for each."""
    counts = {r.part: r.n for r in dealt.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    return {"rows": total, "before": before}


def _placed(dealt: DataFrame, facts: Facts) -> DataFrame:
    """A written table of ``_dealt`` with ``seq``, each row's place from 0 in the whole."""
    before = F.lit(facts["before"] or [0]).cast("array<bigint>")
    at = F.col("_at")
    return dealt.withColumn("seq", F.get(before, F.shiftright(at, 33).cast("int")) + at.bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).drop("_at")


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``seq``, their place from 0 in the order of columns that tell every row apart.

    Numbers are given without a single task: rows are dealt by range, and each range needs how many rows lie before it.
    """
    dealt = session.materialise(_dealt(rows, order), "numbered", tidy=False)
    return _placed(dealt, _ranges(dealt))


def crawl(edges: DataFrame, seeds: DataFrame, scope: Scope, expands: DataFrame | None = None, sitemap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``crawl_with_refused`` where no page is blocked: admitted pages (key, depth, seq, parent) and deferred ones (key, depth)."""
    return crawl_with_refused(edges, seeds, scope, expands, sitemap)[:2]


def crawl_with_refused(
    edges: DataFrame, seeds: DataFrame, scope: Scope, expands: DataFrame | None = None, sitemap: DataFrame | None = None, blocked: DataFrame | None = None,
    journal: Journal | None = None, queued: DataFrame | None = None, captured: DataFrame | None = None, seen: Seen | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Admitted pages (key, depth, seq, parent), deferred ones (key, depth) and, with ``blocked``, refused ones (key, depth, parent).

    ``edges``: (src, dst, pos). ``seeds``: (key, seq) at depth 0. ``sitemap``: (key, seq) at depth 1, whatever the depth limit,
    ahead of level 0's links. ``expands``: keys of pages with html and no wall, which lead on; all if None. ``blocked``: keys that
    are met but never admitted; they take nothing of the budget. ``max_pages`` 0 is no limit.
    Deferred pages keep the first depth at which they were met; those admitted later are left out.

    A crawl that goes on: ``captured`` keys count as seen and take their part of the budget; ``queued`` (key, depth), from 1 on, come at
    their depth, whatever the limit, ahead of links, by key. With a ``journal``, levels that it has are taken from there; the
    other arguments must be the same then.
    """
    kind = seeds.schema["key"].dataType
    step, seen = (journal or Unkept()).step, seen or Seen(seeds.sparkSession)
    none = F.lit(None).cast(kind).alias("parent")
    place = F.lit(-1).cast("long").alias("parent_seq")
    used, last_queued = 0, 0
    if captured is not None:
        captured, known = step("captured", lambda: captured.select("key").distinct(), lambda df: {"rows": df.count()})
        used = known["rows"]
        seen.add(captured, used)
    if queued is not None:
        queued, known = step("queued", lambda: queued.where("depth > 0").groupBy("key").agg(F.min("depth").cast("int").alias("depth")), lambda df: {"last": df.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]})
        last_queued = known["last"]
    cand = seeds.select("key", none, place, F.col("seq").cast("long").alias("pos"))
    admitted = deferred = level = None
    depth, rows = -1, 1
    while True:
        # Here ``level`` is at ``depth``, and the candidates of the next one are met.
        if level is not None:
            from_level = level if expands is None else level.join(expands.select("key"), "key", "left_semi")
            links = from_level.select(F.col("key").alias("parent"), F.col("seq").alias("parent_seq")).join(edges, F.col("parent") == F.col("src"))
            cand = links.select(F.col("dst").alias("key"), "parent", "parent_seq", F.col("pos").cast("long").alias("pos"))
            if depth >= scope.max_depth:
                if rows:
                    over = cand.select("key", F.lit(depth + 1).alias("depth"))
                    deferred = over if deferred is None else deferred.unionByName(over)
                cand = None
            if depth == 0 and sitemap is not None:
                listed = sitemap.select("key", none, place, F.col("seq").cast("long").alias("pos"))
                cand = listed if cand is None else cand.unionByName(listed)
            if depth < last_queued:
                due = queued.where(F.col("depth") == depth + 1).select("key", none, F.lit(-2).cast("long").alias("parent_seq"), F.lit(0).cast("long").alias("pos"))
                cand = due if cand is None else cand.unionByName(due)
            if cand is None:
                break
        depth += 1
        if blocked is not None:
            cand = cand.join(blocked, "key", "left_anti")
        room = max(0, scope.max_pages - used) if scope.max_pages else None
        new, facts = step(f"level-{depth}", lambda cand=cand: _dealt(seen.unseen(_first_mention(cand)), ["parent_seq", "pos", "key"]), _ranges)
        # One table holds what the budget admits and what it doesn't: its first rows and the others.
        ranked = _placed(new, facts).select("key", "seq", "parent").withColumn("depth", F.lit(depth))
        rows = facts["rows"] if room is None else min(room, facts["rows"])
        level = ranked if rows == facts["rows"] else ranked.where(F.col("seq") < rows)
        if rows < facts["rows"]:
            over = ranked.where(F.col("seq") >= rows).select("key", "depth")
            deferred = over if deferred is None else deferred.unionByName(over)
        admitted = level if admitted is None else admitted.unionByName(level)
        if not rows and depth >= last_queued and (depth or sitemap is None):
            break
        seen.add(level, rows)
        used += rows
    if deferred is None:
        deferred = admitted.select("key", "depth").limit(0)
    deferred = deferred.groupBy("key").agg(F.min("depth").alias("depth")).join(admitted.select("key"), "key", "left_anti")
    if captured is not None:
        deferred = deferred.join(captured, "key", "left_anti")
    if blocked is None:
        return admitted, deferred, None
    # Blocked pages lead nowhere, so what met them can be looked up once, when all levels are known.
    by = admitted.where(F.col("depth") < scope.max_depth)
    by = (by if expands is None else by.join(expands.select("key"), "key", "left_semi")).select(F.col("key").alias("parent"), F.col("seq").alias("parent_seq"), "depth")
    met = by.join(edges, F.col("parent") == F.col("src")).select(F.col("dst").alias("key"), (F.col("depth") + 1).alias("depth"), "parent_seq", F.col("pos").cast("long").alias("pos"), "parent")
    for rows, at, before in ((seeds, F.lit(0), -1), (sitemap, F.lit(1), -1), (queued, F.col("depth"), -2)):
        if rows is not None:
            pos = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
            met = met.unionByName(rows.select("key", at.cast("int").alias("depth"), F.lit(before).cast("long").alias("parent_seq"), pos.alias("pos"), none))
    first = met.join(blocked, "key", "left_semi").groupBy("key").agg(F.min(F.struct("depth", "parent_seq", "pos", "parent")).alias("f"))
    refused, _ = step("refused", lambda: first.select("key", "f.depth", "f.parent"))
    return admitted, deferred, refused


def resume(pages: DataFrame, links: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """On resume: what is to be fetched (key, depth), and the keys that count as seen: captured pages, with and without an error
    that isn't tried again, and what is queued."""
    queue = requeue(pages, links, scope)
    seen = pages.select("key").unionByName(queue.select("key")).distinct()
    return queue, seen


def crawl_on(pages: DataFrame, edges: DataFrame, seeds: DataFrame, scope: Scope, expands: DataFrame | None = None, journal: Journal | None = None) -> tuple[DataFrame, DataFrame]:
    """A crawl that goes on from captured ``pages`` (key, depth, error): what is fetched anew (key, depth, seq, parent), and what is left (key, depth).

    Captured pages without an error are seen and count to the page budget; links of theirs that lead to no captured page are queued at
    their depth; start pages that were never captured come again.
    """
    good = pages.where("error IS NULL OR error = ''")
    return crawl_with_refused(edges, seeds, scope, expands, None, None, journal, requeue(pages, edges, scope), good)[:2]


def requeue(pages: DataFrame, links: DataFrame, scope: Scope) -> DataFrame:
    """On resume: links of captured pages (key, depth, error) that lead to no captured page: (key, depth), first depth.

    Rows with an error are fetched again, so they count as not captured. ``strict_depth`` leaves out what lies beyond the depth limit.
    """
    good = pages.where("error IS NULL OR error = ''").select("key", "depth")
    out = links.join(good, links["src"] == good["key"]).select(F.col("dst").alias("key"), (F.col("depth") + 1).alias("depth"))
    if scope.strict_depth:
        out = out.where(F.col("depth") <= scope.max_depth)
    return out.join(good.select("key"), "key", "left_anti").groupBy("key").agg(F.min("depth").alias("depth"))


def lineage(pages: DataFrame, hops: int) -> DataFrame:
    """(key, ancestor, up): each page's parents, up to ``hops`` above it, by self joins on the parent."""
    step = pages.select("key", F.col("parent").alias("ancestor"), F.lit(1).alias("up")).where("ancestor IS NOT NULL")
    out, of = step, pages.select(F.col("key").alias("at"), F.col("parent").alias("next"))
    for k in range(2, hops + 1):
        step = step.join(of, F.col("ancestor") == F.col("at")).select("key", F.col("next").alias("ancestor"), F.lit(k).alias("up")).where("ancestor IS NOT NULL")
        out = out.unionByName(step)
    return out


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (origin, target, ...) with ``allowed`` by robots ``rules`` (origin, seq, allow, prefix): the first rule that matches decides.

    Origins without rules allow everything. Targets are cut to the lengths that their origin's prefixes have, and those beginnings meet
    the rules by equality: a target meets as many rows as its origin has lengths, however many rules there are, and one rule of each length.
    """
    first = rules.where("prefix IS NOT NULL").groupBy("origin", "prefix").agg(F.min_by("allow", "seq").alias("allow"), F.min("seq").alias("seq"))
    lengths = first.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = urls.select("origin", "target").distinct().join(lengths, "origin")
    cut = asked.select("origin", "target", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))).alias("n"))
    hit = cut.select("origin", "target", F.substring("target", F.lit(1), F.col("n")).alias("prefix")).join(first, ["origin", "prefix"])
    told = hit.groupBy("origin", "target").agg(F.min_by("allow", "seq").alias("rule"))
    return urls.join(told, ["origin", "target"], "left").withColumn("allowed", F.coalesce("rule", F.lit(True))).drop("rule")


def is_retryable(status: Column) -> Column:
    from webloom.functions import fixed

    return status.isin(fixed.RETRY_STATUSES)
