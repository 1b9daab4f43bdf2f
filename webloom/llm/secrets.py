"""Secret scans with a recursive decoding worklist.

Each text is layer 0. A layer is scanned by the base patterns; then the encoded runs in it (percent escapes,
Unicode and hex escapes, base64 in one line or over many, compressed data inside base64, percent escapes or compressed data) are decoded into new layers, which go on
the worklist, until nothing new comes: a layer that was seen before (cycle) is not put on it again.
Each layer keeps where its characters come from, so what is found in it is mapped back to the text: through escapes
character by character, through base64 and compression to the encoded run.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import re
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import shared

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more is the same as a longest run that has 32.
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Between lines of one encoded run, and its last line, whatever its length.
_LINE_END = re.compile(r"\r?\n[ \t]*")
_TAIL = re.compile(r"\r?\n[ \t]*((?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
#: Percent escapes with the characters that need none.
_QUOTED = re.compile(r"(?<![A-Za-z0-9_.~/-])[A-Za-z0-9_.~/-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~/-]*+)++")
#: Bytes that are inflated and read at a time.
INFLATE, READ, STEP = 8 << 20, 1 << 20, 4 << 10
#: Bytes from which on data that break off were packed data, and not bytes that looked like it.
DAMAGED = 64 << 10
#: What matches and encoded runs are made of. Data are cut behind another byte, and are no text that matters without 14 such bytes in a
#: row, the least that a match has. RUN: bytes of a run that is cut anywhere, with an overlap.
_IN = rb"A-Za-z0-9+/_.=\-\"' :%\\{}&#;~"
_BREAK, _LONG = re.compile(rb"[^%s]" % _IN), re.compile(rb"[%s]{14}" % _IN)
_WIDE = re.compile(rb"(?P<le>(?:[%s]\0){14})|(?P<be>(?:\0[%s]){14})" % (_IN, _IN))
RUN, OVERLAP = 64 << 20, 4096
#: Where gzip or zlib data may begin within other bytes.
_HEADS = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class _Layer:
    """A text with the place in layer 0 of each of its characters, or of all of it.

    Places are kept by segment: (first character here, first place there, end there), the end being -1 where the characters
    go along one by one, else that of the escape which all of the segment's characters come from.
    """

    def __init__(self, text: str, segments: list[tuple[int, int, int]], whole: tuple[int, int] | None) -> None:
        self.text, self.segments, self.whole = text, segments, whole
        self.first = [x[0] for x in segments]

    def _segment(self, at: int) -> int:
        return bisect.bisect_right(self.first, at) - 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        first, place, stop = self.segments[self._segment(start)]
        start_there = place if stop >= 0 else place + start - first
        last = max(start, end - 1)
        first, place, stop = self.segments[self._segment(last)]
        return start_there, stop if stop >= 0 else place + last - first + 1

    def part(self, start: int, end: int, to: int) -> Iterator[tuple[int, int, int]]:
        """The segments of some of the characters, as they lie from ``to`` on."""
        k = self._segment(start)
        while k < len(self.segments) and self.segments[k][0] < end:
            first, place, stop = self.segments[k]
            ahead = max(0, start - first)
            yield to + first + ahead - start, place + (ahead if stop < 0 else 0), stop
            k += 1


def _unescaped(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """``layer`` with the matches of a pattern replaced by what they stand for."""
    text, parts, segments, at, to = layer.text, [], [], 0, 0
    for m in pattern.finditer(text):
        out = decode(m)
        if out is None:
            continue
        parts += [text[at : m.start()], out]
        if not layer.whole:
            if at < m.start():
                segments += layer.part(at, m.start(), to)
            if out:
                segments.append((to + m.start() - at, *layer.span(m.start(), m.end())))
        to += m.start() - at + len(out)
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    if not layer.whole and at < len(text):
        segments += layer.part(at, len(text), to)
    return _Layer("".join(parts), segments, layer.whole)


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    digits, base = next((g, 10 if k == 4 else 16) for k, g in enumerate(m.groups(), 1) if g)
    code = int(digits, base)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _packed(raw: bytes) -> bool:
    """Whether bytes begin as gzip or zlib data do."""
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _header(raw: bytes) -> tuple[int, int] | None:
    """Bytes of the head and of the checksum behind gzip or zlib data, or None where none begin."""
    if raw[:2] == b"\x1f\x8b":
        if len(raw) < 10 or raw[2] != 8:
            return None
        flags, at = raw[3], 10
        if flags & 4:
            at += 2 + int.from_bytes(raw[at : at + 2], "little")
        for bit in (8, 16):  # a name, a comment
            if flags & bit:
                at = raw.find(b"\0", at) + 1
                if not at:
                    return None
        return at + (flags & 2), 8
    return (2, 4) if _packed(raw) and not raw[1] & 32 else None


def _pieces(machine, source: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """What deflated data from ``at`` on hold, in pieces, each with the place behind what was read for it; ends where they end or break off.

    Checksums don't count, and little is read at a time: what comes before damage is told.
    """
    while at < len(source) and not machine.eof:
        step, at = source[at : at + STEP], at + STEP
        while step:
            try:
                piece = machine.decompress(step, INFLATE)
            except zlib.error:
                return
            step = machine.unconsumed_tail
            yield piece, min(at, len(source)) - len(step) - len(machine.unused_data)
            if machine.eof:
                return


def _packed_end(raw: bytes, start: int) -> tuple[int, bool]:
    """Where packed data that begin at ``start`` end or break off (``start`` if they hold nothing), and whether they are whole."""
    head = _header(raw[start : start + STEP])
    if head is None:
        return start, False
    machine, end, some = zlib.decompressobj(-15), start, False
    for piece, at in _pieces(machine, raw, start + head[0]):
        some = some or bool(piece)
        end = at
    return (min(len(raw), end + head[1]), True) if machine.eof else (end if some else start, False)


def _inflated(source: BinaryIO) -> Iterator[tuple[bytes, bool]]:
    """What gzip or zlib data hold, member after member, in pieces, and whether a piece begins a member; what follows them is the last."""
    rest = source.read(READ)
    while rest and (head := _header(rest)):
        machine, begins, at = zlib.decompressobj(-15), True, head[0]
        while True:
            for piece, end in _pieces(machine, rest, at):
                at = end
                if piece:
                    yield piece, begins
                    begins = False
            if machine.eof or not (more := source.read(READ)) or at < len(rest):
                break
            rest, at = more, 0
        if not machine.eof:
            return  # cut off or damaged: nothing tells what follows
        rest = rest[at:]
        while len(rest) < head[1] + 18 and (more := source.read(READ)):
            rest += more
        rest = rest[head[1] :].lstrip(b"\0")
        while not rest and (rest := source.read(READ)):
            rest = rest.lstrip(b"\0")
    while rest:  # no further member, so plain
        yield rest, True
        rest = source.read(READ)


def _plain(raw: bytes) -> Iterator[bytes]:
    """The bytes and, as long as data begin as gzip or zlib, what those hold, in pieces that are cut between runs.

    Packed data in packed data wait in files beyond some size; data that were seen before (cycle) are not read again.
    """
    yield raw
    work: list[BinaryIO] = [io.BytesIO(raw)] if _packed(raw) else []
    seen = {hashlib.sha256(raw).digest()}
    while work:
        carry, whole, member, first = b"", None, None, True
        nested = []
        with work.pop() as source:
            for piece, begins in _inflated(source):
                if begins:
                    member = None
                    if _packed(piece):  # a member by itself, and what all members hold together
                        nested.append(member := [tempfile.SpooledTemporaryFile(INFLATE), hashlib.sha256()])  # noqa: SIM115
                        if first:
                            whole, member = member, None
                for one in (whole, member):
                    if one:
                        one[0].write(piece)
                        one[1].update(piece)
                first = False
                piece = carry + piece
                cut, at = 0, len(piece)
                while at and not cut:
                    at = max(0, at - OVERLAP)
                    cut = max((m.end() for m in _BREAK.finditer(piece, at, at + OVERLAP)), default=0)
                if cut:
                    yield piece[:cut]
                    carry = piece[cut:]
                elif len(piece) >= RUN:
                    yield piece
                    carry = piece[-OVERLAP:]
                else:
                    carry = piece
            if carry:
                yield carry
        for file, digest in nested:
            if digest.digest() in seen:
                file.close()
                continue
            seen.add(digest.digest())
            file.seek(0)
            work.append(file)


def _texts(raw: bytes) -> Iterator[str]:
    """Bytes, and what they hold packed, as texts; whether one is a secret is left to the patterns."""
    for piece in _plain(raw):
        if _LONG.search(piece):
            yield piece.decode("utf-8", "replace")
        for start, kind in {(m.start() % 2, m.lastgroup) for m in _WIDE.finditer(piece)} if b"\0" in piece else ():
            yield piece[start:].decode(f"utf-16-{kind}", "replace")


def _whole(raw: bytes) -> bool:
    """Whether bytes are all text, or packed data from their beginning."""
    try:
        if _packed(raw[:3]):
            return _packed_end(raw, 0)[1]
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _inner(raw: bytes) -> Iterator[str]:
    """Texts of decoded bytes, and of packed data that begin somewhere in them; the search goes on behind data that were whole."""
    yield from _texts(raw)
    at = max(1, _packed_end(raw, 0)[0])
    while m := _HEADS.search(raw, at):
        end, whole = _packed_end(raw, m.start())
        if end > m.start():
            yield from _texts(raw[m.start() : end])
        # What breaks off soon only looked like packed data, and what it ran over may hold some.
        at = end if whole or end - m.start() > DAMAGED else m.start() + 1


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of base64 that goes on over line ends, with the last, shorter line and without it."""
    begin, parts, stop = 0, [], -1
    for m in [*_BASE64.finditer(text), None]:
        if parts and (m is None or parts[-1][-1] == "=" or not _LINE_END.fullmatch(text, stop, m.start())):
            tail = _TAIL.match(text, stop) if parts[-1][-1] != "=" else None
            if len(parts) > 1:
                yield begin, stop, "".join(parts)
            if tail and len(tail[1]) < len(parts[0]):
                yield begin, tail.end(1), "".join(parts) + tail[1]
            parts = []
        if m is not None:
            if not parts:
                begin = m.start()
            parts.append(m[0])
            stop = m.end()


def _decoded(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text and (out := _unescaped(layer, _PERCENT, _percent)):
        yield out
    if "%" in text:
        for m in _QUOTED.finditer(text):
            raw = unquote_to_bytes(m[0])
            if b"\0" in raw or _packed(raw[:3]) or _HEADS.search(raw):
                for inner in _inner(raw):
                    yield _Layer(inner, [], layer.span(m.start(), m.end()))
    if ("\\" in text or "&#" in text) and (out := _unescaped(layer, _UNICODE, _escape)):
        yield out
    runs = ((m.start(), m.end(), m[0]) for m in _BASE64.finditer(text))
    for start, end, run in chain(runs, _wrapped(text) if "\n" in text else ()):
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        # What is glued on in front (a path, a name) shifts the groups of four characters.
        for ahead in range(4):
            own = body[ahead:]
            own = own[:-1] if len(own) % 4 == 1 else own
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
            for inner in _inner(raw):
                yield _Layer(inner, [], layer.span(start, end))
            if _whole(raw):
                break


def scan_layers(text: str) -> list[tuple[int, int, str]]:
    """Base spans of the text and those of its decoded layers, mapped to the text, by start and kind."""
    base = scan(text)
    found, kept = set(base), {k: [(s, e) for s, e, kind in base if kind == k] for k in KINDS}  # of a kind they don't overlap
    name = lambda x: (hashlib.sha256(x.text.encode("utf-8", "surrogatepass")).digest(), x.whole)
    # The worklist holds what each layer still has to give, not the layers: one of each depth is in memory.
    root = _Layer(text, [(0, 0, -1)], None)
    work, seen = [_decoded(root)], {name(root)}
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if (own := name(inner)) in seen:
            continue
        seen.add(own)
        work.append(_decoded(inner))
        for start, end, kind in scan(inner.text):
            one = inner.span(start, end)
            # Escapes leave the rest of a text as it was: what the base has there is not told twice.
            k = bisect.bisect_right(kept[kind], (one[0], len(text))) - 1
            if k < 0 or kept[kind][k][1] < one[1]:
                found.add((*one, kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SCHEMA = "doc_id long, base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda xs: [{"kind": k, "start": s, "end": e} for s, e, k in xs]
    for batch in batches:
        base, spans = [], []
        for text in batch.column(1).to_pylist():
            base.append(as_rows(scan(text or "")))
            spans.append(as_rows(scan_layers(text or "")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(spans, span)], names=["doc_id", "base", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` with ``base`` and all ``spans`` (kind, start, end in code points), each by start and then kind.

    Defined cases: a null text has no spans; a null ``doc_id`` and repeated rows each get their row; other columns
    are ignored; an empty table gives an empty one. Spans of decoded layers that lie within a base span of
    their kind are that span. Inflated data are read to their end, in pieces.
    """
    rows = shared.plain(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(_scan, SCHEMA)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

