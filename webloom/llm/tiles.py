"""A keyed exchange over a sparse matrix that is cut into tiles: row blocks by column blocks.

A row block is what a map task holds at a time: some rows and their sorted distinct keys (columns). Each of its
keys is sent once, whatever number of its rows have it, with one value that sums its rows up; keys travel by column
block, as packed and compressed arrays. A column block brings equal keys together by a vectorised sort, combines their values,
and answers every row block that asked, not every row, so a key of a third of all rows costs one entry for each row
block. The answers meet the block's rows again, and ``finish`` turns both into the output.

Rows must come in the same order when a lost task runs again (a scan of files does that); a block that came back otherwise
is told by its stamp, and the job fails instead of giving wrong rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import words

#: Keys and rows of a row block.
KEYS, ROWS = 2_000_000, 1 << 17
TILE, ANSWER, BLOCK = 0, 1, 2
PACKED = "bucket long, kind byte, block long, stamp long, base long, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("block", pa.int64()), ("stamp", pa.int64()), ("base", pa.int64()), ("blob", pa.binary())])
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_CODEC = None


def _codec() -> pa.Codec:
    global _CODEC
    _CODEC = _CODEC or pa.Codec("zstd", 1)
    return _CODEC


def _steps(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    np.subtract(x[1:], x[:-1], out=out[1:])
    return out


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: np.ndarray, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[: n * size].reshape(size, n).T).view(kind).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    """64-bit arrays of one length."""
    raw = b"".join(map(_planes, arrays))
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def _unpack(blob: bytes, n_arrays: int) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_codec().decompress(memoryview(blob)[8:], size, asbytes=True), np.uint8)
    n = size // (8 * n_arrays)
    return [_unplanes(raw[8 * n * k :], np.uint64, n) for k in range(n_arrays)]


def _pack_block(metas: list[bytes], counts: np.ndarray, at: np.ndarray) -> bytes:
    """Rows of a block: what ``finish`` needs of each, and the places of its keys among the block's."""
    steps = _steps(at.astype(np.uint32))
    head = (np.cumsum(counts) - counts)[counts > 0]
    steps[head] = at[head]
    sizes = np.array([len(m) for m in metas], np.uint32)
    raw = b"".join([len(metas).to_bytes(8, "little"), len(at).to_bytes(8, "little"), _planes(sizes), _planes(counts.astype(np.uint32)), _planes(steps), *metas])
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def _unpack_block(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = _codec().decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, k = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    data = np.frombuffer(raw, np.uint8)[16:]
    sizes, counts = (_unplanes(data[4 * n * j :], np.uint32, n).astype(np.int64) for j in (0, 1))
    at = _unplanes(data[8 * n :], np.uint32, k).astype(np.int64)
    total = np.cumsum(at)
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[np.maximum(first - 1, 0)] if k else 0, 0)
    at = total - np.repeat(before, counts)
    ends = 16 + 8 * n + 4 * k + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], counts, at


def _row(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _dealt(block: int, n_buckets: int) -> int:
    return int(words.mix(np.array([block], np.uint64))[0] % np.uint64(n_buckets))


def _sender(emit: Callable[[pa.RecordBatch, dict], Iterable[tuple]], how: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 24, 0
        metas, counts, keys, values, n, seen = [], [], [], [], 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            count, key = np.concatenate(counts), np.concatenate(keys)
            own, at = np.unique(key, return_inverse=True)
            if how == "sum":
                value = np.bincount(at, minlength=len(own)).astype(np.uint64)
            else:
                value = np.full(len(own), NONE)
                np.minimum.at(value, at, np.repeat(np.concatenate(values), count))
            block, stamp = task | made, int(np.bitwise_xor.reduce(words.mix(own)).view(np.int64)) if len(own) else 0
            made += 1
            bucket = ((own >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)  # keys are sorted, so buckets are runs
            lo = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(own) else np.zeros(0, np.int64)
            hi = np.append(lo[1:], len(own))[: len(lo)]
            yield from _rows([(int(bucket[i]), TILE, block, stamp, int(i), _pack(_steps(own[i:j]), value[i:j])) for i, j in zip(lo, hi, strict=True)])
            yield _row(_dealt(block, n_buckets), BLOCK, block, stamp, 0, _pack_block(metas, count, at))
            for held in (metas, counts, keys, values):
                held.clear()
            seen.clear()

        for batch in batches:
            for meta, count, key, value in emit(batch, seen):
                metas += meta
                counts.append(count)
                keys.append(key)
                values.append(value)
                n += len(key)
                if n >= KEYS or len(metas) >= ROWS:
                    yield from flush()
                    n = 0
        if metas:
            yield from flush()

    return run


def _receiver(how: str, n_buckets: int):
    """Over a column block: combined values of the keys that several rows have (sum), or that have one at all (min)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, values = [], [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] != TILE:
                    yield _row(*row)
                    continue
                steps, value = _unpack(row[5], 2)
                held.append((*row[2:5], len(steps)))
                keys.append(np.cumsum(steps, dtype=np.uint64))
                values.append(value)
        if not held:
            return
        key, value = np.concatenate(keys), np.concatenate(values)
        keys.clear()
        values.clear()
        order = np.argsort(key)
        ordered = key[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total = (np.add if how == "sum" else np.minimum).reduceat(value[order], head)
        del ordered
        value[order] = np.repeat(total, np.diff(np.append(head, len(key))))
        told = value > 1 if how == "sum" else value != NONE
        lo = 0
        for block, stamp, base, n in held:
            at = np.flatnonzero(told[lo : lo + n])
            if len(at):
                yield _row(_dealt(block, n_buckets), ANSWER, block, stamp, 0, _pack(_steps((at + base).astype(np.uint64)), _steps(key[lo + at]), value[lo + at]))
            lo += n

    return run


def _gather(finish: Callable[..., Iterator[pa.RecordBatch]]):
    """Over whole row blocks, answers first: ``finish(block, metas, row, key, value)`` for the answered keys of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for _, kind, block, stamp, _, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == ANSWER:
                    told.append((block, stamp, blob))
                    continue
                if any(x[:2] != (block, stamp) for x in told):
                    raise RuntimeError("a partition's rows came in another order when it ran again; write them to a table first")
                metas, counts, at = _unpack_block(blob)
                parts = [_unpack(x[2], 3) for x in told]
                told.clear()
                place, key, value = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(3))
                lo = 0
                for p in parts:
                    hi = lo + len(p[0])
                    place[lo:hi], key[lo:hi] = np.cumsum(p[0], dtype=np.uint64), np.cumsum(p[1], dtype=np.uint64)
                    lo = hi
                answer = np.full(int(max(at.max(initial=-1), -1)) + 1, -1, np.int64)
                answer[place.astype(np.int64)] = np.arange(len(place))
                found = answer[at]
                row = np.repeat(np.arange(len(metas)), counts)[found >= 0]
                found = found[found >= 0]
                yield from finish(block, metas, row, key[found], value[found])

    return run


def ask(rows: DataFrame, emit: Callable, how: str, finish: Callable, schema: str, n_buckets: int) -> DataFrame:
    """What ``finish`` yields for every row block of ``rows``.

    ``emit(batch, seen)`` yields (metas, counts, keys, values) of some rows: bytes for ``finish``, how many keys each row has,
    their sorted distinct 64-bit keys one row after the other, and for ``min`` a number for each row; ``seen`` is a
    dictionary that lasts for one row block. ``how``: ``sum`` answers each key that two or more rows have with
    their number, ``min`` with the smallest number of its rows, unless all are ``NONE``.
    """
    deal = lambda df: df.repartitionById(n_buckets, F.col("bucket").cast("int"))
    sent = deal(rows.mapInArrow(_sender(emit, how, n_buckets), PACKED))
    told = deal(sent.mapInArrow(_receiver(how, n_buckets), PACKED))
    return told.sortWithinPartitions("block", "kind").mapInArrow(_gather(finish), schema)
