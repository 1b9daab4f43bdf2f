"""A Merkle manifest of a table: a tree of SHA-256 digests for each language, and one over their roots.

Leaves are written once, sorted by range into runs, and numbered by run; they and every level above them are a Parquet table
partitioned by level, the node store. A node's coordinate is (tree, level, place), and its children's places are eight times its own
and on, so nodes are dealt by place: a block of 4,096 neighbours is read in order and folded ``STEPS`` levels up by one small task,
and the next round reads what that wrote. The number of rounds follows the logarithm of the leaves.

Proofs go down the same blocks: a block's nodes are scanned along with the proof of the node above the block, which all its leaves share.
No tree, level or language is ever in one task, and nothing but counts comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom import session
from webloom.llm import shared

#: Children of a node.
WIDTH = 8
#: Levels that one round folds: a block has ``WIDTH ** STEPS`` leaves.
STEPS = 4
#: The tree over the roots.
TOP = "top"
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
_NODE = "tree string, place bigint, n bigint, digest binary, level int"
_ARROW = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("level", pa.int32())])


def _hash(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def _leaf(text: Column) -> Column:
    """A row's digest: each field as ``-`` for null, else its byte count, ``:`` and itself."""
    values = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256))


def tampered(doc_id: Column, text: Column) -> Column:
    """A text with A-Z in lower case where 3 divides the id's CRC-32; no change without an id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def leaves(docs: DataFrame, offered: Column | None = None) -> DataFrame:
    """``doc_id``, ``tree`` (the language, null first in order), ``digest`` and ``offered``, the digest of the row with ``offered`` as its text."""
    rows = shared.plain(docs, **FIELDS)
    digest = _leaf(F.col("text"))
    other = digest if offered is None else _leaf(offered)
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), digest.alias("digest"), other.alias("offered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in sorted runs, written, with ``place`` (from 0 within each ``tree``) and ``n``, the tree's size.

    A run's rows have their place in it as they are written; what lies before a run is summed up from one row for each run and tree.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    runs = shared.materialise(dealt.withColumn("run", F.shiftright(at, 33).cast("int")).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1).cast("long"))), "runs")
    ends = runs.groupBy("run", "tree").agg(F.min("at").alias("low"), F.count("*").alias("rows"))  # as many as runs and trees
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("run", "tree", (before - F.col("low")).alias("shift"), F.sum("rows").over(by).alias("n"))
    return runs.join(ends, ["run", "tree"]).withColumn("place", F.col("at") + F.col("shift")).drop("run", "at", "shift")


def _folded(run: list[str], n: int, steps: int) -> Iterator[list[str]]:
    """The levels above ``run``, a block's digests of a level that has ``n`` in all: ``steps``, or up to the root."""
    for _ in range(steps):
        if n == 1:
            return
        n = -(-n // WIDTH)
        run = [_hash("".join(run[k : k + WIDTH])) for k in range(0, len(run), WIDTH)]
        yield run


def _in_order(table: pa.Table) -> tuple[pa.Table, list[str], int, int]:
    table = table.sort_by("place")
    return table, [x.hex() for x in table["digest"].to_pylist()], table["place"][0].as_py(), table["n"][0].as_py()


def _climb(steps: int):
    """The nodes above a block."""

    def run(table: pa.Table) -> pa.Table:
        _, digests, place, n = _in_order(table)
        level, tree, out = table["level"][0].as_py(), table["tree"][0].as_py(), []
        for up in _folded(digests, n, steps):
            level, place, n = level + 1, place // WIDTH, -(-n // WIDTH)
            out += [(tree, place + k, n, bytes.fromhex(x), level) for k, x in enumerate(up)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def _block(steps: int) -> Column:
    return F.shiftright("place", 3 * steps).alias("block")


class Manifest:
    """The node store of a table's trees, in the shared folder: ``nodes`` (tree, place, n, digest, level), ``bases`` (the leaves, with
    the columns given) and ``roots`` (tree, digest, top: its level). ``rounds`` of ``steps`` levels build its largest tree."""

    def __init__(self, rows: DataFrame, steps: int = STEPS):
        spark, self.steps = rows.sparkSession, steps
        self.path = session.place(spark, "nodes")
        self.bases = shared.materialise(rows.withColumn("level", F.lit(0)), "leaves")
        self.rounds, here = 0, self.bases.select("tree", "place", "n", "digest", "level")
        here.write.partitionBy("level").parquet(self.path)
        # Each round reads one level and appends those above it.
        while not here.where("n > 1").isEmpty():
            above = here.where("n > 1").groupBy("tree", _block(steps)).applyInArrow(_climb(steps), _NODE)
            above.write.mode("append").partitionBy("level").parquet(self.path)
            self.rounds += 1
            here = self.level(self.rounds * steps)
        self.nodes = spark.read.schema(_NODE).parquet(self.path)
        self.roots = shared.materialise(self.nodes.where("n = 1").select("tree", "digest", F.col("level").alias("top")), "roots")

    def level(self, k: int) -> DataFrame:
        return self.bases.sparkSession.read.schema(_NODE).parquet(self.path).where(F.col("level") == k)


def _siblings(run: list[str], k: int, size: int) -> tuple[str, str]:
    """What lies to the left and to the right of a run's member, without their brackets."""
    low = k - k % WIDTH
    return "".join(run[low:k]), "".join(run[k + 1 : min(low + WIDTH, size)])


def _ways(table: pa.Table, above: pa.Table, steps: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """Of each node of a block, in order: its row, and its siblings level by level up to the last root."""
    _, run, _, n = _in_order(table)
    levels = [run, *_folded(run, n, steps)]
    top = [(x["left"], x["right"]) for x in above["way"][0].as_py()]
    ways = [top] * len(levels[-1])
    for run in levels[-2::-1]:
        ways = [[_siblings(run, k, len(run)), *ways[k // WIDTH]] for k in range(len(run))]
    yield from enumerate(ways)


_WAY = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _descend(keep: list[str], steps: int):
    """Rows of a block with ``way``, from the way of the node above it."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)[0] if len(table) else table
        ways = [[{"left": a, "right": b} for a, b in way] for _, way in _ways(table, above, steps)] if len(table) and len(above) else []
        return table.select(keep).slice(0, len(ways)).append_column("way", pa.array(ways, _WAY))

    return run


def _checked(steps: int):
    """Leaves of a block with the digest of their proof, and the root that the offered leaf folds to along it."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)[0] if len(table) else table
        proofs, folds = [], []
        offered = [x.hex() for x in table["offered"].to_pylist()]
        for k, way in _ways(table, above, steps) if len(table) and len(above) else ():
            proofs.append(_hash("".join(a + b for a, b in way)))
            at = offered[k]
            for a, b in way:
                at = _hash(a + at + b)
            folds.append(at)
        told = table.select(["doc_id", "tree", "digest"]).slice(0, len(proofs))
        return told.append_column("proof", pa.array(proofs, pa.string())).append_column("folded", pa.array(folds, pa.string()))

    return run


_WAY_SQL = "way array<struct<left string, right string>>"


def _down(trees: Manifest, tops: DataFrame, last, schema: str) -> DataFrame:
    """From ``tops`` (tree, way), the ways of the roots, down the blocks of ``trees``: ``last`` is given the leaves with the ways above them."""
    # A tree whose root lies between two rounds takes its way at the block that holds its root.
    root = trees.roots.select("tree", "top").join(tops, "tree")
    above, steps = None, trees.steps
    for k in range(max(trees.rounds - 1, 0), -1, -1):
        base = k * steps
        rows = trees.bases if k == 0 else trees.level(base)
        inside = (F.col("top") > base) & (F.col("top") <= base + steps) if k else F.col("top") <= steps
        ways = root.where(inside).select("tree", F.lit(0).cast("long").alias("block"), "way")
        if above is not None:
            ways = ways.unionByName(above.select("tree", F.col("place").alias("block"), "way"))
        blocks, over = rows.withColumn("block", _block(steps)).groupBy("tree", "block"), ways.groupBy("tree", "block")
        if k == 0:
            return blocks.cogroup(over).applyInArrow(last, schema)
        above = shared.materialise(blocks.cogroup(over).applyInArrow(_descend(["tree", "place"], steps), f"tree string, place bigint, {_WAY_SQL}"), "ways")
    raise AssertionError


def _over_roots(trees: Manifest) -> Manifest:
    """The tree over the roots, whose leaves are the trees in order."""
    subroots = trees.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    return Manifest(numbered(subroots, ["of"]), trees.steps)


def _nothing(trees: Manifest) -> DataFrame:
    return trees.roots.select("tree", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("way"))


def _trees(docs: DataFrame, offered: Column | None, steps: int) -> tuple[Manifest, Manifest]:
    digests = shared.materialise(leaves(docs, offered), "digests")
    trees = Manifest(numbered(digests, ["doc_id", "digest", "offered"]), steps)
    return trees, _over_roots(trees)


def _to_roots(top: Manifest) -> DataFrame:
    """(tree, way): of each tree's root the siblings up to the root of all."""
    return _down(top, _nothing(top), _descend(["of"], top.steps), f"of string, {_WAY_SQL}").select(F.col("of").alias("tree"), "way")


def _named(rows: DataFrame, trees: Manifest, top: Manifest) -> DataFrame:
    """``rows`` with their tree's root and the root of all: a row for each tree, and one."""
    roots = trees.roots.select("tree", F.hex("digest").alias("subroot")).crossJoin(F.broadcast(top.roots.select(F.hex("digest").alias("root"))))
    return rows.join(roots, "tree").withColumn("subroot", F.lower("subroot")).withColumn("root", F.lower("root"))


def manifest(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root`` and ``way``, the leaf's siblings (left, right) level by level, for every row of ``docs``.

    Defined cases: a null field counts as ``-``, so a null text and an empty one differ; rows without a language have a tree of their
    own, the first; a null ``doc_id`` comes first in its tree; rows that repeat a ``doc_id`` stand in the order of their digests, and
    equal rows are leaves each; columns other than ``FIELDS`` are ignored, whatever their names; an empty table has no rows. ``steps`` changes no result.
    """
    trees, top = _trees(docs, None, steps)
    down = _down(trees, _to_roots(top), _descend(["doc_id", "tree", "digest"], steps), f"doc_id bigint, tree string, digest binary, {_WAY_SQL}")
    return _named(down, trees, top).select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "way")


def audit(docs: DataFrame, offered: Column, steps: int = STEPS) -> DataFrame:
    """Every row of ``docs`` checked with ``offered`` in place of its text: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root`` and ``verified``. Proofs are used and digested where they arise. Cases as for ``manifest``."""
    trees, top = _trees(docs, offered, steps)
    down = _down(trees, _to_roots(top), _checked(steps), "doc_id bigint, tree string, digest binary, proof string, folded string")
    told = _named(down, trees, top)
    return told.select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit(docs, tampered(F.col("doc_id"), F.col("text")))


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295))"
_UP = "SELECT {0}, level + 1, place // 8, max(n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM {1} WHERE n > 1 GROUP BY {0}, level, place // 8"
_BESIDE = "coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place {0} {1} >> (3 * t.level)), '')"
_WAYS = "SELECT d.doc_id, {k} + t.level AS l, " + _BESIDE.format("<", "{own}") + " AS a, " + _BESIDE.format(">", "{own}") + " AS b"
OP13_SQL = (
    "WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, " + _LEAF.format(text="text") + " AS leaf, "
    + _LEAF.format(text=f"CASE WHEN {_CRC} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")
    + " AS offered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents), "
    + "t AS (SELECT tree, 0 AS level, place, n, leaf AS digest FROM d UNION ALL " + _UP.format("tree", "t") + "), "
    + "u AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest FROM t WHERE n = 1), "
    + "v AS (SELECT 'top' AS top, 0 AS level, place, n, digest FROM u UNION ALL " + _UP.format("top", "v") + "), "
    + "w AS (" + _WAYS.format(k=0, own="d.place") + " FROM d JOIN t ON t.tree = d.tree AND t.n > 1 AND t.place // 8 = (d.place >> (3 * t.level)) // 8 GROUP BY d.doc_id, d.place, t.level UNION ALL "
    + _WAYS.format(k=100, own="u.place") + " FROM d JOIN u ON u.tree = d.tree JOIN v t ON t.n > 1 AND t.place // 8 = (u.place >> (3 * t.level)) // 8 GROUP BY d.doc_id, u.place, t.level), "
    + "s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS k FROM w), p AS (SELECT doc_id, sha256(coalesce(string_agg(a || b, '' ORDER BY k), '')) AS proof, max(k) AS k FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id), "
    + "f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, offered AS h FROM d UNION ALL SELECT f.doc_id, s.k, sha256(s.a || f.h || s.b) FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1) "
    + "SELECT d.doc_id, leaf, u.digest AS subroot, v.digest AS root, proof AS proof_sha256, h AS folded_root, h = v.digest AS verified "
    + "FROM d JOIN u USING (tree) JOIN v ON v.n = 1 JOIN p USING (doc_id) JOIN f ON f.doc_id = d.doc_id AND f.k = coalesce(p.k, 0)"
)
