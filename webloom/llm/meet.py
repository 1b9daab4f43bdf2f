"""A keyed exchange that finds which rows share a 64-bit key, without a hot task.

Rows are (key, id). Every map task first combines its own rows: a key that several local
ids share is answered at once, and only the key's smallest local id travels on, so however
many rows a key has, each map task sends it once. Rows travel as packed, compressed arrays by
bucket of the key; a bucket is met by a vectorised sort. Answers travel alike, by bucket of the id.

Answers are (id, values), the values being 64-bit numbers:

``shared``: to every id of a key that has two or more ids: the key
``later``:  to every id of a key but the smallest: the key
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 1_500_000
_CODEC = None
PACKED = "bucket long, kind byte, n int, blob binary"
ANSWER = "id long, payload binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("n", pa.int32()), ("blob", pa.binary())])


def _codec() -> pa.Codec:
    global _CODEC
    _CODEC = _CODEC or pa.Codec("zstd", 1)
    return _CODEC


def pack(key: np.ndarray, ident: np.ndarray) -> bytes:
    """Sorted by key: differences of keys and ids, byte planes, compressed."""
    step = np.empty_like(key)
    step[0] = key[0]
    np.subtract(key[1:], key[:-1], out=step[1:])
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in (step, ident.view(np.uint64) - np.uint64(0))]
    return _codec().compress(b"".join(p.tobytes() for p in planes), asbytes=True)


def unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(_codec().decompress(blob, 16 * n, asbytes=True), np.uint8).reshape(2, 8, n)
    step, ident = (np.ascontiguousarray(raw[i].T).view(np.uint64).ravel() for i in (0, 1))
    return np.cumsum(step, dtype=np.uint64), ident.view(np.int64)


def combine(key: np.ndarray, ident: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest id; ids and values of the answers."""
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    head = np.empty(len(key), bool)
    head[:1] = True
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    least = np.repeat(ident[at], np.diff(np.append(at, len(key))))
    later = ident != least
    if mode == "shared":
        told = np.repeat(np.logical_or.reduceat(later, at), np.diff(np.append(at, len(key)))) if len(at) else later
    else:
        told = later
    return key[at], ident[at], ident[told], key[told]


def answers(ident: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One (id, values) for each id, without repeats."""
    if not len(ident):
        return
    order = np.lexsort((value, ident))
    ident, value = ident[order], value[order]
    keep = np.ones(len(ident), bool)
    keep[1:] = (ident[1:] != ident[:-1]) | (value[1:] != value[:-1])
    ident, value = ident[keep], np.ascontiguousarray(value[keep])
    at = np.flatnonzero(np.append(True, ident[1:] != ident[:-1]))
    for lo, hi in zip(at, np.append(at[1:], len(ident)), strict=True):
        yield int(ident[lo]), value[lo:hi].tobytes()


def _answer_rows(ident: np.ndarray, value: np.ndarray, n_buckets: int) -> tuple[list, list, list, list]:
    """Packed answers by bucket of the id."""
    if not len(ident):
        return [], [], [], []
    name = ident.view(np.uint64)
    bucket = (name ^ (name >> np.uint64(17)) ^ (name >> np.uint64(31))) % np.uint64(n_buckets)
    order = np.lexsort((value, name, bucket))
    bucket, name, value = bucket[order], name[order], value[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    to = np.append(at[1:], len(name))
    return bucket[at].astype(np.int64).tolist(), [1] * len(at), (to - at).tolist(), [pack(name[i:j], value[i:j].view(np.int64)) for i, j in zip(at, to, strict=True)]


def _batches(cols: tuple[list, list, list, list], limit: int = 4096) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(cols[0]), limit):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + limit], f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def sender(emit: Callable[[pa.RecordBatch], Iterable[tuple]], mode: str, n_buckets: int):
    """For mapInArrow. ``emit`` yields (keys, ids), or (None, rows of kind 2 as bytes) to pass on."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, ident = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        key, ident, told, value = combine(key, ident, mode)
        bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)  # keys are sorted, so buckets are runs
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        to = np.append(at[1:], len(key))
        yield from _batches(([int(b) for b in bucket[at]], [0] * len(at), [int(x) for x in to - at], [pack(key[i:j], ident[i:j]) for i, j in zip(at, to, strict=True)]), 64)
        yield from _batches(_answer_rows(told, value, n_buckets), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, ident in emit(batch):
                if key is None:
                    yield from _batches(ident)
                elif len(key):
                    held.append((key, ident))
                    n += len(key)
                    if n >= FLUSH:
                        yield from flush(held)
                        held, n = [], 0
        if held:
            yield from flush(held)

    return run


def receiver(mode: str, n_buckets: int):
    """For mapInArrow over the rows of whole buckets: packed answers; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, told, n_told = None, [], [], 0

        def close() -> int:
            if not held:
                return 0
            key, ident = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            _, _, who, value = combine(key, ident, mode)
            if len(who):
                told.append((who, value))
            return len(who)

        def tell() -> Iterator[pa.RecordBatch]:
            if told:
                yield from _batches(_answer_rows(*(np.concatenate([x[i] for x in told]) for i in (0, 1)), n_buckets), 64)
                told.clear()

        for batch in batches:
            through = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == 0:
                    if row[0] != now:
                        n_told += close()
                        now = row[0]
                        if n_told >= FLUSH:
                            yield from tell()
                            n_told = 0
                    held.append(unpack(row[3], row[2]))
                else:
                    through.append(row)
            if through:
                yield from _batches(tuple(map(list, zip(*through, strict=True))))
        close()
        yield from tell()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the answers of whole buckets: one row for each id, and the rows of kind 2."""
    now, held = None, []

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 4096):
            ids, payload = zip(*rows[lo : lo + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payload, pa.binary())], names=["id", "payload"])

    def close() -> list[tuple]:
        if not held:
            return []
        name, value = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        held.clear()
        return list(answers(name.view(np.int64), value.view(np.uint64)))

    for batch in batches:
        through = []
        for bucket, kind, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 2:
                through.append((None, blob))
                continue
            if bucket != now:
                yield from out(close())
                now = bucket
            held.append(unpack(blob, n))
        yield from out(through)
    yield from out(close())


def meet(rows: DataFrame, emit: Callable, mode: str, n_buckets: int) -> DataFrame:
    """(id, payload) for what ``emit`` yields from the batches of ``rows``: one row for each id with an answer, and
    one without an id for each row that is passed on."""
    # A bucket is a partition: as many packed rows as map tasks times buckets, and none meets by chance.
    deal = lambda df: df.repartitionById(n_buckets, F.col("bucket").cast("int"))
    sent = deal(rows.mapInArrow(sender(emit, mode, n_buckets), PACKED))
    told = deal(sent.mapInArrow(receiver(mode, n_buckets), PACKED))
    return told.mapInArrow(_gather, ANSWER)
