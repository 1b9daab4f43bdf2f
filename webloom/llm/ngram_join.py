"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

1. Each text becomes a row of the incidence matrix: its sorted distinct n-gram hashes. Tiles of row blocks by column blocks
   (``tiles``) count the entries of every column. A column with one entry adds to no product, so a row
   goes on with its other columns only. Of rows with the same set within a row block only the first sends its columns.
2. With its columns in order of their counts (then of their hashes) two rows that qualify share a column among the first
   n - ceil(t * n) + 1 of either one. A row whose one-entry columns fill that prefix has no partner and is done. Rows
   with the same set are one class, found by a 128-bit digest, and one row goes on for each.
3. Of two rows that qualify, one at least has (1 - t) / (1 + t) of its columns or less to itself: it is a core row. Prefix
   columns meet in tiles again, by interval of sizes, and link every row to the smallest core row of each, so rows
   that differ from all others in too many columns make no links among themselves.
4. Rows that are connected by such links form a family: no pair outside a family can qualify. Families are cut into row
   blocks of bounded rows and columns. In a row block, overlap counts of one row with all others that are not yet in its
   component accumulate over its columns, rarest first; rows whose sizes cannot reach the threshold are left
   out, and so are those whose count so far plus the columns left stays below the bound.
5. Each row block also holds the family's first row, which ties the blocks of one large group of near
   copies together. What then is outside the largest component of its family is held against all
   blocks of the family, so no link is lost and copies are never paired with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import shared, words
from webloom.llm.components import components
from webloom.llm.tiles import NONE, ask

#: Rows of a row block, besides the family's first row, and their columns.
BLOCK, BLOCK_COLUMNS = 1024, 1 << 20
#: Parts that a family's rows are dealt to when they meet what is known of the family, so that a large one is no hot key.
SALTS = 32


def _intervals(num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """Lower ends of size intervals: two sizes that can qualify at num/den lie in one interval or in neighbouring ones."""
    low = [1]
    while low[-1] < most:
        low.append(low[-1] * den // num + 1)
    return np.array(low)


def _shingles(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of some rows at a time: hashes and their row."""
    data, offsets = words.strings(batch.column("text"))
    for lo, hi in words.row_chunks(offsets):
        hashes, before = words.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        key, row, _ = words.windows(hashes, before, width)
        count = np.diff(before)
        few = np.flatnonzero((count > 0) & (count < width))  # the whole sequence is the only shingle
        if len(few):
            short = [hashes[before[k] : before[k + 1]] for k in few]
            whole = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") for x in short], np.uint64)
            key, row = np.concatenate([key, whole]), np.concatenate([row, few])
        order = np.argsort(key)
        key, row = key[order], row[order]
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        yield slice(lo, hi), key[keep], row[keep]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _emit_rows(width: int):
    def emit(batch: pa.RecordBatch, seen: dict) -> Iterator[tuple]:
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
        for rows, key, row in _shingles(batch, width):
            bounds = np.searchsorted(row, np.arange(rows.stop - rows.start + 1))
            size, ok = np.diff(bounds), known[rows]
            metas, sends = [], np.zeros(len(size), bool)
            for k, one in enumerate(ids[rows].tolist()):
                own = _digest(key[bounds[k] : bounds[k + 1]]) if size[k] and ok[k] else b""
                sends[k] = bool(own) and own not in seen
                if own:
                    seen[own] = None
                metas.append(bytes([int(ok[k]) | 2 * int(sends[k])]) + one.to_bytes(8, "little", signed=True) + int(size[k]).to_bytes(8, "little") + own)
            yield metas, np.where(sends, size, 0), key[sends[row]], None

    return emit


def _finish_rows(num: int, den: int):
    def finish(block: int, metas: list[bytes], row: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, count, row))
        key, bounds = key[order], np.searchsorted(row[order], np.arange(len(metas) + 1))
        copies: dict[bytes, int] = {}
        for m in metas:
            if len(m) > 17:
                copies[m[17:]] = copies.get(m[17:], 0) + 1
        for lo in range(0, len(metas), 2048):
            out = []
            for k, m in enumerate(metas[lo : lo + 2048], lo):
                n, more = int.from_bytes(m[9:17], "little"), int(bounds[k + 1] - bounds[k])
                goes_on = bool(m[0] & 2) and more > 0 and n - -(-n * num // den) + 1 > n - more
                meets = goes_on or copies.get(m[17:], 0) > 1
                out.append((int.from_bytes(m[1:9], "little", signed=True) if m[0] & 1 else None, n, m[17:] or None, block, meets, key[bounds[k] : bounds[k + 1]].tobytes() if goes_on else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "digest", "tile", "meets", "columns"])

    return finish


def _emit_prefixes(num: int, den: int):
    low = _intervals(num, den)

    def emit(batch: pa.RecordBatch, seen: dict) -> Iterator[tuple]:
        metas, counts, keys, values = [], [], [], []
        for one, n, cell in zip(batch.column("doc_id").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("columns").to_pylist(), strict=True):
            own = np.frombuffer(cell, np.uint64)
            alone = n - len(own)
            own = own[: n - -(-n * num // den) + 1 - alone]
            at = int(np.searchsorted(low, n, "right"))
            own = np.unique(np.concatenate([words.mix(own ^ words.mix(np.array([space], np.uint64))) for space in (at - 1, at)]))
            metas.append(one.to_bytes(8, "little", signed=True))
            counts.append(len(own))
            keys.append(own)
            # Ids in order as unsigned numbers; NONE, the largest, is kept for rows that are no core.
            values.append(NONE if alone * (den + num) > n * (den - num) else np.uint64(min((one + (1 << 63)), (1 << 64) - 2)))
        yield metas, np.array(counts, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.array(values, np.uint64)

    return emit


def _finish_prefixes(block: int, metas: list[bytes], row: np.ndarray, key: np.ndarray, core: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = np.frombuffer(b"".join(metas), np.int64)[row]
    other = (core ^ np.uint64(1 << 63)).view(np.int64)
    pair = np.unique(np.stack([own, other], 1)[own != other], axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _row_blocks(table: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Components of one row block: (doc_id, root). ``side``: 0 is held against 1 and 2, and 2 against all."""
    table = table.drop_duplicates("doc_id")
    ids, side, label = (table[c].to_numpy() for c in ("doc_id", "side", "label"))
    sets = [np.frombuffer(x, np.uint64) for x in table["columns"]]
    n = len(sets)
    if n < 2:
        return pd.DataFrame({"doc_id": ids, "root": ids})
    size = table["n_shingles"].to_numpy()  # with the columns that no other row has
    held = np.array([len(x) for x in sets], np.int64)
    column, code, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), held)
    order = np.argsort(code, kind="stable")
    by_column, start = row[order], np.concatenate([[0], np.cumsum(freq)])
    first = np.concatenate([[0], np.cumsum(held)])
    _, comp = np.unique(label, return_inverse=True)
    comp = comp.astype(np.int64)
    place = np.arange(n)
    for k in np.flatnonzero(side != 1):
        if (comp == comp[0]).all():
            break
        can = (comp != comp[k]) & (size * den >= size[k] * num) & (size * num <= size[k] * den)
        can &= (side != 0) if side[k] == 0 else (side != 2) | (place > k)
        if not can.any():
            continue
        own = code[first[k] : first[k + 1]]
        own = own[np.argsort(freq[own], kind="stable")]
        need = -(-num * (size + size[k]) // (num + den))  # overlap at the threshold
        count, done = np.zeros(n, np.int64), 0
        for cut in np.array_split(own, max(1, len(own) // 64)):
            hit = np.concatenate([by_column[start[c] : start[c + 1]] for c in cut])
            count += np.bincount(hit, minlength=n)
            done += len(cut)
            can &= count + (len(own) - done) >= need
            if not can.any():
                break
        linked = np.flatnonzero(can & (count >= need))
        if len(linked):
            comp[np.isin(comp, comp[linked])] = comp[k]
    order = np.lexsort((ids, comp))
    root = np.empty(n, np.int64)
    head = np.flatnonzero(np.append(True, np.diff(comp[order]) != 0))
    root[order] = np.repeat(ids[order][head], np.diff(np.append(head, n)))
    return pd.DataFrame({"doc_id": ids, "root": root})


def _blocks(rows: str, columns: str) -> Column:
    """Row blocks for so many rows with so many columns."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(columns) / BLOCK_COLUMNS)).cast("int")


def _with_family(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the row of their family in ``facts``, which holds large families only (at most one for ``BLOCK`` rows)."""
    salt = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SALTS))
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", salt).join(spread, ["family", "salt"], how).drop("salt")


def _joined(rows: DataFrame, num: int, den: int, n_buckets: int) -> DataFrame:
    """(node, label) of the ``rows`` (doc_id, n_shingles, columns) that link with another; label is the smallest id that links reach."""
    edge = shared.keep(ask(rows, _emit_prefixes(num, den), "min", _finish_prefixes, "a long, b long", n_buckets))
    family = components(edge).toDF("doc_id", "family")
    here = rows.join(family, "doc_id").withColumn("held", F.length("columns") / 8)
    # Blocks of a family: rows are dealt by hash, into so many blocks as its size asks for.
    size = here.groupBy("family").agg(F.count("*").alias("rows"), F.sum("held").alias("held")).select("family", _blocks("rows", "held").alias("blocks"))
    here = _with_family(here, size.where("blocks > 1"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    here = shared.keep(here.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    lead = F.col("doc_id") == F.col("family")
    # The family's first row goes to each of its blocks.
    spread = here.withColumn("to", F.explode(F.when(lead & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    out, cols = "doc_id long, root long", ["doc_id", "n_shingles", "columns"]
    block = spread.select("family", "to", *cols, F.lit(2).alias("side"), F.col("doc_id").alias("label")).groupBy("family", "to")
    local = shared.keep(block.applyInPandas(lambda t: _row_blocks(t, num, den), out).distinct())
    big = here.where("blocks > 1")
    if big.isEmpty():
        return local.toDF("node", "label")
    link = local.where("doc_id <> root").toDF("a", "b")
    label = components(link).toDF("doc_id", "label")
    # What is outside its family's largest component meets all of the family's blocks.
    part = big.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    most = part.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"))
    part = shared.keep(_with_family(part, most.where("labels > 1"), "inner").withColumn("rest", F.col("label") != F.col("main")))
    rests = part.where("rest").groupBy("family").agg(F.count("*").alias("rows"), F.sum("held").alias("held")).select("family", _blocks("rows", "held").alias("rests"))
    part = _with_family(part, rests, "inner").withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("rests")).cast("int"))
    probe = part.where("rest").select("family", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *cols, F.lit(0).alias("side"), "label")
    held = part.select("family", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("group"), "block", *cols, F.lit(1).alias("side"), "label")
    cross = probe.unionByName(held).groupBy("family", "group", "block").applyInPandas(lambda t: _cross(t, num, den), out)
    return components(cross.where("doc_id <> root").distinct().toDF("a", "b").unionByName(link))


def ngram_classes(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest``, ``component_id`` for every row of ``docs``.

    A-Z are lower-cased; words are runs of anything but 0x20 and 0x09-0x0D; a set has the distinct
    ``width``-word shingles (the whole sequence if there are fewer words). Two documents link when
    ``den * |both| >= num * |either|``; ``component_id`` is the smallest ``doc_id`` that links reach.

    Defined cases: a null or wordless text has an empty set and links with nothing; equal sets are
    one class; a null ``doc_id`` gets its size and a null component; rows that repeat a ``doc_id``
    with one text are alike, and where they carry several texts each row has the size and the component of its own text; other columns are
    ignored; an empty table gives an empty one. Shingles are told by 64-bit hashes, sets by 128-bit digests. The rows of a
    partition must come in the same order when a lost task runs again, as those of files do.
    """
    docs = shared.plain(docs, doc_id="bigint", text="string")
    schema = "doc_id long, n_shingles long, digest binary, tile long, meets boolean, columns binary"
    n = shared.buckets(docs)
    # Written, so that the tiles' exchanges, the largest of all, can go before the next ones come.
    rows = shared.materialise(ask(docs, _emit_rows(width), "sum", _finish_rows(num, den), schema, n), "incidence-rows")
    some = rows.where("meets")
    # A class has as many rows with columns as there are row blocks with it; one of them goes on, by the class's smallest id.
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.expr("CASE WHEN columns IS NOT NULL THEN tile END")).alias("carrier"))
    classes = shared.keep(classes)
    carried = some.where("columns IS NOT NULL").join(classes, (some["digest"] == classes["digest"]) & (F.col("tile") == F.col("carrier")))
    linked = _joined(shared.keep(carried.select(F.col("rep").alias("doc_id"), "n_shingles", "columns")), num, den, n)
    label = classes.join(linked.toDF("rep", "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    # Members of a class meet it by row block: a popular set has no more rows for a key than a block has.
    label = some.select("digest", "tile").distinct().join(label, "digest")
    met = some.join(label, ["digest", "tile"])
    out = ["doc_id", "n_shingles", "digest", "component_id"]
    return met.select(*out).unionByName(rows.where("NOT meets").withColumn("component_id", F.col("doc_id")).select(*out))


def near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id`` and ``component_id`` of near copies: texts that share 80 of 100 of their distinct five-word shingles.

    The join of ``ngram_classes``, whose defined cases hold here too; three words and 90 of 100 are the contract of ``op9_ngram_join``.
    """
    return ngram_classes(docs, width, num, den).select("doc_id", "component_id")


def _cross(table: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Rows outside the main component against a block; a row that is on both sides counts as both."""
    table = table.sort_values(["doc_id", "side"], kind="stable")
    twice = table["doc_id"].duplicated(keep=False)
    table = table.assign(side=table["side"].where(~twice, 2)).drop_duplicates("doc_id")
    return _row_blocks(table.sort_values("side", kind="stable"), num, den)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 90 * (i.n + j.n - c)),
r AS (SELECT x AS f, y AS t FROM e UNION SELECT y, x FROM e UNION SELECT f, y FROM r JOIN (SELECT x, y FROM e UNION SELECT y, x FROM e) q ON r.t = q.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.t, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT f, min(t) AS t FROM r GROUP BY f) m ON m.f = d.doc_id
"""
