"""State machines over fetch logs: host throttling and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import fixed
from webloom.functions.scope import Scope

#: A complaint doubles a host's spacing, 32 times at most; a clean response takes a seventh or so off, down to 1.
PENALTY, MOST, RELAX, LEAST = 2.0, 32.0, 1.15, 1.0
SHORTEST_GAP = 0.05


def _step(bad: Column) -> Column:
    """What one response does to a multiplier x: min(hi, max(lo, a * x))."""
    return F.when(bad, F.struct(F.lit(PENALTY).alias("a"), F.lit(0.0).alias("lo"), F.lit(MOST).alias("hi"))).otherwise(F.struct(F.lit(1 / RELAX).alias("a"), F.lit(LEAST).alias("lo"), F.lit(float("inf")).alias("hi")))


def _after(f: Column, g: Column) -> Column:
    """g after f, again such a function."""
    clamp = lambda x: F.least(g["hi"], F.greatest(g["lo"], g["a"] * x))
    return F.struct((f["a"] * g["a"]).alias("a"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"))


def _compose(steps: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    return F.aggregate(steps, start, _after)


def throttle_multiplier(log: DataFrame, order: list[str]) -> DataFrame:
    """(host, multiplier) after ``log`` (host, bad, ...), taken in ``order``.

    Responses act on the multiplier as clamped linear functions, which are closed under composition. So the log is dealt by range of
    (host, order); each range's responses of a host become one function, and only those meet by host. A host with a third of the log is
    spread over as many ranges as its share asks for.
    """
    dealt = log.select("host", "bad", *order).repartitionByRange("host", *order).withColumn("part", F.spark_partition_id())
    each = dealt.groupBy("host", "part").agg(F.array_sort(F.collect_list(F.struct(*order, "bad"))).alias("rows"))
    parts = each.select("host", "part", _compose(F.transform("rows", lambda r: _step(r["bad"]))).alias("f"))
    whole = parts.groupBy("host").agg(_compose(F.transform(F.array_sort(F.collect_list(F.struct("part", "f"))), lambda p: p["f"])).alias("f"))
    return whole.select("host", F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("f.a"))).alias("multiplier"))


def throttle_schedule(log: DataFrame, order: list[str], delay: float = 0.4) -> DataFrame:
    """``log`` (host, at in seconds, ...) with ``due``, when each request may go: one at a time for each host, a gap apart.

    due(i) = max(at(i), due(i - 1) + gap), which is a running maximum of at(j) - j * gap. The log is dealt by range of (host, order),
    so a large host is worked on in pieces: each piece's length and maximum are what the pieces behind it need, and
    those few rows are folded by host.
    """
    gap = F.lit(float(max(SHORTEST_GAP, delay)))
    at = F.monotonically_increasing_id()  # the range above, the place in it below
    place, part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long")), F.shiftright("_at", 33).cast("int")
    dealt = session.materialise(log.repartitionByRange("host", *order).sortWithinPartitions("host", *order).withColumn("_at", at), "requests", tidy=False)
    dealt = dealt.withColumn("_place", place).withColumn("_part", part)
    parts = dealt.groupBy("host", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_low"), F.max(F.col("at") - F.col("_place") * gap).alias("_most"))
    parts = parts.withColumn("_most", F.col("_most") + F.col("_low") * gap)
    by_part = Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(by_part), F.lit(0)))
    parts = parts.withColumn("_floor", F.max(F.col("_most") - F.col("_before") * gap).over(by_part)).select("host", "_part", "_low", "_before", "_floor")
    # A piece has one row here, so a host's rows meet it by piece.
    whole = dealt.join(parts, ["host", "_part"]).withColumn("_k", F.col("_place") - F.col("_low") + F.col("_before"))
    run = F.max(F.col("at") - F.col("_k") * gap).over(Window.partitionBy("host", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return whole.withColumn("due", F.greatest(run, F.col("_floor")) + F.col("_k") * gap).drop("_k", "_at", "_place", "_part", "_low", "_before", "_floor")


#: The most walls that a fetch has cleared for it.
CLEARS = 2


def retry_outcomes(attempts: DataFrame, scope: Scope, gate: bool = True) -> DataFrame:
    """(key, outcome, attempts, slowdowns, walls, waited) of fetches from ``attempts`` (key, seq, status, wall, html_empty, error, cleared).

    Rate limits and failing servers are tried again after a pause that doubles; walls that a person can clear are shown to one, twice at
    most; an error without html is tried again after a plain pause. No fetch looks at more than ``max_retries`` + 3 attempts, so only
    those are gathered, however many there are.
    """
    most = scope.max_retries + CLEARS + 1
    first = attempts.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where(F.col("_k") <= most)
    rows = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_k", "status", "wall", "html_empty", "error", "cleared"))).alias("rows"))
    start = F.struct(F.lit("").alias("outcome"), *[F.lit(0).alias(n) for n in ("attempts", "slowdowns", "clears", "walls")], F.lit(0.0).alias("waited"))

    def step(s: Column, r: Column) -> Column:
        clearable = F.coalesce(r["wall"].isin(fixed.CLEARABLE), F.lit(False))
        limited = ~clearable & (F.coalesce(r["status"].isin(fixed.RETRY_STATUSES), F.lit(False)) | F.coalesce(r["wall"] == "rate-limit", F.lit(False)))
        walled = ~limited & r["wall"].isNotNull()
        blank = ~limited & ~walled & F.coalesce(r["error"], F.lit(False)) & r["html_empty"]
        room = s["slowdowns"] < scope.max_retries
        solved = clearable & F.lit(gate) & (s["clears"] < CLEARS) & r["cleared"]
        again = ((limited | blank) & room) | (walled & solved)
        pause = F.when(limited & room, scope.backoff * F.pow(F.lit(2.0), s["slowdowns"])).when(blank & room, F.lit(scope.backoff)).otherwise(0.0)
        outcome = F.when(again, "").when(limited, "rate limited").when(walled, "walled").when(F.coalesce(r["error"], F.lit(False)), "error").otherwise("ok")
        one = lambda c: F.when(c, 1).otherwise(0)
        nxt = F.struct(
            outcome.alias("outcome"), (s["attempts"] + 1).alias("attempts"), (s["slowdowns"] + one((limited | blank) & room)).alias("slowdowns"), (s["clears"] + one(walled & solved)).alias("clears"),
            (s["walls"] + one(walled)).alias("walls"), (s["waited"] + pause).alias("waited"),
        )
        return F.when(s["outcome"] != "", s).otherwise(nxt)

    done = rows.select("key", F.aggregate("rows", start, step).alias("s"))
    return done.select("key", F.when(F.col("s.outcome") == "", "unfinished").otherwise(F.col("s.outcome")).alias("outcome"), *[F.col(f"s.{n}").alias(n) for n in ("attempts", "slowdowns", "walls", "waited")])


def gate_events(events: DataFrame) -> DataFrame:
    """Of each session of a gate (session, seq, seen_epoch, enabled, action): what every caller gets.

    (session, seq, returned, prompts, solved, abandoned): a caller who knows an older epoch goes on with the newer cookies; ``auto`` and ``enter`` solve the
    wall; ``s`` gives up for all that follow. A session is one person's, so its events are few.
    """
    rows = events.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "seen_epoch", "enabled", "action"))).alias("rows"))
    blank = F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("returned"), F.lit(0).alias("prompts"), F.lit(0).alias("solved"), F.lit(False).alias("abandoned"))

    def step(out: Column, r: Column) -> Column:
        last = F.when(F.size(out) == 0, blank).otherwise(F.try_element_at(out, F.lit(-1)))
        off = ~r["enabled"] | last["abandoned"]
        shared = ~off & (last["solved"] > r["seen_epoch"])
        asks = ~off & ~shared
        wins = asks & r["action"].isin("auto", "enter")
        one = lambda c: F.when(c, 1).otherwise(0)
        row = F.struct(r["seq"].cast("bigint").alias("seq"), (shared | wins).alias("returned"), (last["prompts"] + one(asks)).alias("prompts"), (last["solved"] + one(wins)).alias("solved"), (last["abandoned"] | (asks & (r["action"] == "s"))).alias("abandoned"))
        return F.concat(out, F.array(row))

    kind = "array<struct<seq:bigint,returned:boolean,prompts:int,solved:int,abandoned:boolean>>"
    return rows.select("session", F.explode(F.aggregate("rows", F.array().cast(kind), lambda o, r: step(o, r).cast(kind))).alias("e")).select("session", "e.*")


def adopted_sessions(fetches: DataFrame, cleared: DataFrame) -> DataFrame:
    """``fetches`` (site, at, seq, ...) with ``epoch``, the walls cleared on the site by then, and ``session``, what the last of them left.

    ``cleared``: (site, at, seq, session), a row for each cleared wall; one at a fetch's own (at, seq) counts. A fetch without a cleared wall before
    it has epoch 0 and no session; a wall that left nothing keeps the session before it. Both are running values over the
    union of the two, so no fetch is paired with a wall; sites are dealt by range of time, and what pieces before hold is folded by piece.
    """
    columns = [c for c in fetches.columns if c not in ("epoch", "session")]
    rows = fetches.select("site", "at", "seq", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_left"), F.struct(*columns).alias("_row"))
    walls = cleared.select("site", "at", "seq", F.lit(0).alias("_kind"), F.col("session").cast("string").alias("_left"))
    both = rows.unionByName(walls, allowMissingColumns=True).repartitionByRange("site", "at", "seq", "_kind").withColumn("_part", F.spark_partition_id())
    both = session.materialise(both, "sessions", tidy=False)
    run = Window.partitionBy("site", "_part").orderBy("at", "seq", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_n", F.count_if(F.col("_kind") == 0).over(run)).withColumn("_last", F.last("_left", ignorenulls=True).over(run))
    parts = both.where("_kind = 0").groupBy("site", "_part").agg(F.count("*").alias("n"), F.max_by("_left", F.when(F.col("_left").isNotNull(), F.struct("at", "seq"))).alias("last"))
    # Pieces without a wall count too: a few rows for each site.
    parts = both.select("site", "_part").distinct().join(parts, ["site", "_part"], "left")
    ahead = Window.partitionBy("site").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("site", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"), F.last("last", ignorenulls=True).over(ahead).alias("_had"))
    out = here.where("_kind = 1").join(parts, ["site", "_part"])
    return out.select("_row.*", (F.col("_n") + F.col("_before")).alias("epoch"), F.coalesce("_last", "_had").alias("session"))


def remembered_sessions(fetches: DataFrame) -> DataFrame:
    """(site, session): the latest cookies that are not empty, of fetches (site, host, start_host, at, seq, cookies) from the site's own start host."""
    own = fetches.where("host = start_host AND cookies IS NOT NULL AND cookies <> ''")
    return own.groupBy("site").agg(F.max_by("cookies", F.struct("at", "seq")).alias("session"))
