"""Hierarchical multi-length packing into power-of-two windows.

Each document's ids (its text's, then the end id) are cut into full long windows; what is left over is routed to
the smallest tier that holds it. A pool of leftovers is packed from the longest tier down: its
largest piece opens a window of its tier, the gap takes the largest piece of a shorter tier that fits, again and
again, and where none fits a longer one is cut to fill the gap exactly. Pieces that cannot fill a window
wait for the next pool; a task's last ones are cut into windows of smaller powers of two. So no window is
padded. Windows of one length form step groups of equal token counts; the last two groups of a task and length share
what is left evenly.

Packing is a map over the input's partitions: no exchange, and memory follows the pool.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import shared

WINDOW, LEAST = 1024, 128
#: Ids of leftovers that are packed together, and ids of a step group.
POOL, GROUP = 1 << 19, 32 * WINDOW
END = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])

_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")
_SPECIAL = "<|endoftext|>"
#: White space and other runs of so many characters are left to the tokenizers library.
_LONG_RUN = 256
_SPACES = re.compile(r"\s{%d}" % _LONG_RUN)


def _simple(text: str) -> bool:
    """Whether both libraries give the same ids: ASCII and Latin letters, no special token, no long run."""
    return not (_OTHER.search(text) or _SPECIAL in text or _SPACES.search(text) or max(map(len, text.split()), default=0) >= _LONG_RUN)


@functools.cache
def encoder(vocabulary: str, ranks: str | None) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizers library's file ``vocabulary``.

    ``ranks`` is the same vocabulary for tiktoken, which is several times as fast; it takes the texts in
    ASCII and Latin letters without the special token, where both split alike. Its splitter gives up on runs of a
    hundred thousand characters, so texts with long runs are left to the other too.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(vocabulary)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    return lambda text: fast(text) if _simple(text) else exact(text)


class _Groups:
    """Step groups of windows of one length: full ones as they come, and the last two of even sizes.

    Windows below the shortest tier count as that tier's.
    """

    def __init__(self, task: int) -> None:
        self.task, self.held, self.ids, self.made = task, {}, {}, {}

    def add(self, size: int, window: list[tuple]) -> list[tuple]:
        """Rows of the groups that are settled now."""
        tier = max(size, LEAST)
        self.held.setdefault(tier, []).append((size, window))
        self.ids[tier] = self.ids.get(tier, 0) + size
        return self._cut(tier, GROUP) if self.ids[tier] >= 2 * GROUP else []

    def _cut(self, tier: int, ids: int) -> list[tuple]:
        n = self.made.get(tier, 0)
        self.made[tier] = n + 1
        group, rows, k, taken = self.task | (tier.bit_length() << 34) | n, [], 0, 0
        while k < len(self.held[tier]) and taken < ids:
            size, window = self.held[tier][k]
            rows += [(*row, group) for row in window]
            taken, k = taken + size, k + 1
        del self.held[tier][:k]
        self.ids[tier] -= taken
        return rows

    def rest(self) -> Iterator[list[tuple]]:
        for tier in self.held:
            if self.ids[tier] > GROUP:
                yield self._cut(tier, self.ids[tier] // 2)
            if self.held[tier]:
                yield self._cut(tier, GROUP)


class _Pool:
    """Pieces (document, its ids, start, length), by length."""

    def __init__(self) -> None:
        self.by = [[] for _ in range(WINDOW + 1)]
        self.has = 0  # bit n: there is a piece of length n
        self.total = 0

    def put(self, doc: tuple, start: int, length: int) -> None:
        self.by[length].append((doc, start))
        self.has |= 1 << length
        self.total += length

    def take(self, length: int) -> tuple:
        doc, start = self.by[length].pop()
        if not self.by[length]:
            self.has ^= 1 << length
        self.total -= length
        return doc, start, length

    def cut(self, length: int, size: int) -> tuple:
        doc, start, _ = self.take(length)
        self.put(doc, start + size, length - size)
        return doc, start, size

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple]]]:
        while self.total:
            longest = self.has.bit_length() - 1
            size = max(1 << (longest - 1).bit_length(), LEAST)
            if self.total < size:
                if not last:
                    return
                size = 1 << (self.total.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                fits = self.has & ((2 << gap) - 1)
                if fits:
                    piece = self.take(fits.bit_length() - 1)
                else:
                    above = self.has >> (gap + 1)
                    piece = self.cut(gap + (above & -above).bit_length(), gap)
                pieces.append(piece)
                gap -= piece[2]
            yield size, pieces


def _pack(vocabulary: str | None, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is None:
            import public_tokenizers

            ids_of = encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            ids_of = encoder(vocabulary, ranks)
        task, pool, rows, made, held = TaskContext.get().partitionId() << 40, _Pool(), [], 0, 0
        groups = _Groups(task)

        def add(size: int, pieces: list[tuple]) -> None:
            nonlocal made, held
            at, window = 0, []
            for (doc_id, ids), start, length in pieces:
                window.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), task | made, at, size))
                at += length
            made += 1
            held += size
            rows.extend(groups.add(size, window))

        def out() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(ids_of(text) if text else ()), END], np.dtype("<u4"))
                doc, full = (doc_id, ids), len(ids) // WINDOW * WINDOW
                for start in range(0, full, WINDOW):
                    add(WINDOW, [(doc, start, WINDOW)])
                    if held >= POOL and rows:
                        yield out()
                if full < len(ids):
                    if full:  # a leftover needs no hold on the rest
                        doc = (doc_id, _Tail(ids[full:].copy(), full))
                    pool.put(doc, full, len(ids) - full)
                if pool.total >= POOL:
                    for window in pool.windows(False):
                        add(*window)
                if held >= POOL and rows:
                    yield out()
        for window in pool.windows(True):
            add(*window)
        for settled in groups.rest():
            rows.extend(settled)
        if rows:
            yield out()

    return run


class _Tail:
    """The last ids of a document, by their place in all of it."""

    def __init__(self, ids: np.ndarray, before: int) -> None:
        self.ids, self.before = ids, before

    def __len__(self) -> int:
        return self.before + len(self.ids)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.ids[part.start - self.before : part.stop - self.before]


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian),
    ``doc_tokens``, ``sequence_id``, ``offset``, ``tier`` (the window's length) and ``step_group``.

    Each id of each document lies in exactly one piece, and every sequence fills its power of two, 1,024 at
    most. ``vocabulary``: a file of the tokenizers library (None: the public byte-level BPE), ``ranks``: the
    same for tiktoken, if there is one.

    Defined cases: a null or empty text has the end id only; a null ``doc_id`` stays null; rows that
    repeat a ``doc_id`` are packed each on its own; other columns are ignored; an empty table gives an
    empty one. A task's sequence ids begin with its partition, so they are unique, and the same
    when the task runs again over the same rows in the same order.
    """
    rows = shared.plain(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(_pack(vocabulary, ranks), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
