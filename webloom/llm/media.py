"""Media columns: ISO base media containers, walked without decoding payloads.

``parse`` walks the nested boxes of a container, decodes each track's sample tables (stsz/stz2, stsc,
stco/co64, stts, stss) and gives the codec, the duration and the byte ranges of its samples and keyframes;
fragmented files (moof/traf/trun, with the defaults of trex and tfhd) too. Payload bytes are never read for that, only addressed. ``mux`` writes a
container with one track of 8-bit samples, which stores any bytes losslessly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import shared

#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
RATE, CHUNK = 8000, 65536
#: The largest number of a column; files may claim more.
MOST = (1 << 63) - 1
TRACK = "struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,media_bytes:bigint,keyframes:bigint,key_ranges:array<struct<at:bigint,length:bigint>>,ranges:array<struct<at:bigint,length:bigint>>>"


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range; a broken size ends at the range's end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield bytes(kind), at + head, min(end, at + size)
        at += size


def walk(data: memoryview, at: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """Every box with its path, parents first; iterative over siblings, as deep as boxes nest, 32 at most."""
    for kind, start, stop in boxes(data, at, end):
        here = (*path, kind)
        yield here, start, stop
        if kind in CONTAINERS and len(here) < 32:
            yield from walk(data, start + CONTAINERS[kind], stop, here)


def _full(data: memoryview, at: int) -> tuple[int, int]:
    word = struct.unpack_from(">I", data, at)[0]
    return word >> 24, word & 0xFFFFFF


def _table(data: memoryview, at: int, end: int, kind: str, columns: int) -> np.ndarray:
    """Rows of a counted table; a count beyond the box is cut to what is there."""
    size = np.dtype(kind).itemsize * columns
    n = min(struct.unpack_from(">I", data, at)[0], max(0, end - at - 4) // size)
    return np.frombuffer(data, kind, n * columns, at + 4).reshape(n, columns).astype(np.int64)


class _Track:
    def __init__(self) -> None:
        self.id = self.timescale = self.duration = 0
        self.handler = self.codec = ""
        self.size, self.fixed, self.n = None, 0, 0
        self.to_chunk = self.chunk = self.times = self.sync = None
        self.runs: list[tuple[int, int, int, bool, int]] = []  # place, size and number of alike samples, keyframes or not, duration of each

    def read(self, data: memoryview, kind: bytes, at: int, end: int) -> None:
        if kind == b"tkhd":
            version, _ = _full(data, at)
            self.id = struct.unpack_from(">I", data, at + (20 if version else 12))[0]
        elif kind == b"mdhd":
            version, _ = _full(data, at)
            self.timescale, self.duration = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
        elif kind == b"hdlr":
            self.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            for name, _, _ in boxes(data, at + 8, end):
                self.codec = name.decode("latin-1")
                break
        elif kind == b"stsz":
            self.fixed, self.n = struct.unpack_from(">II", data, at + 4)
            if not self.fixed:
                self.size = _table(data, at + 8, end, ">u4", 1)[:, 0]
                self.n = len(self.size)
        elif kind == b"stz2":
            width, self.n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            raw = np.frombuffer(data[at + 12 : end], np.uint8)
            raw = np.stack([raw >> 4, raw & 15], 1).ravel() if width == 4 else raw.view(">u2") if width == 16 else raw
            self.size = raw[: self.n].astype(np.int64)
            self.n = len(self.size)
        elif kind == b"stsc":
            self.to_chunk = _table(data, at + 4, end, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            self.chunk = _table(data, at + 4, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]  # places beyond MOST come out negative
        elif kind == b"stts":
            self.times = _table(data, at + 4, end, ">u4", 2)
        elif kind == b"stss":
            self.sync = _table(data, at + 4, end, ">u4", 1)[:, 0]

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks lie and the samples before each of them; memory follows the tables, whatever counts they claim."""
        if self.chunk is None or self.to_chunk is None or not len(self.to_chunk):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        first = np.minimum.accumulate((self.to_chunk[:, 0] - 1).clip(0, len(self.chunk))[::-1])[::-1]
        per = np.repeat(self.to_chunk[:, 1], np.diff(np.append(first, len(self.chunk))))
        chunk = self.chunk[len(self.chunk) - len(per) :]
        return chunk, np.concatenate([[0], np.cumsum(np.minimum(per, self.n))]).clip(max=self.n)

    def ranges(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
        """(place, length) of all samples and of the keyframes, in order, and how many keyframes there are."""
        chunk, before = self.chunks()
        n = int(before[-1])
        if self.size is not None:
            ahead = np.concatenate([[0], np.cumsum(self.size[:n])])
        else:
            ahead = None  # equal sizes are worked out, not kept
        upto = lambda k: ahead[k] if ahead is not None else k * self.fixed
        whole = list(zip(chunk.tolist(), (upto(before[1:]) - upto(before[:-1])).tolist(), strict=True))
        if self.sync is None:
            return whole, whole, self.n
        key = np.unique(self.sync) - 1
        key = key[(key >= 0) & (key < n)]
        home = np.searchsorted(before, key, "right") - 1
        at = chunk[home] + upto(key) - upto(before[home])
        return whole, list(zip(at.tolist(), (upto(key + 1) - upto(key)).tolist(), strict=True)), len(key)

    def as_row(self) -> dict:
        whole, keys, n_keys = self.ranges()
        duration, n = self.duration, self.n
        unknown = duration in (0xFFFFFFFF, (1 << 64) - 1)
        if self.runs:
            n += sum(r[2] for r in self.runs)
            n_keys += sum(r[2] for r in self.runs if r[3])
            # The header's duration tells of samples in tables only, of all, or is unknown (all bits set).
            told = 0 if self.times is None else sum(a * b for a, b in self.times.tolist())
            duration = max(0 if unknown else duration, told + sum(r[2] * r[4] for r in self.runs))
            whole = whole + [(r[0], r[1] * r[2]) for r in self.runs]
            keys = keys + [(r[0], r[1] * r[2]) for r in self.runs if r[3]]
        most = lambda x: min(x, MOST)
        return {
            "track_id": self.id, "handler": self.handler, "codec": self.codec, "timescale": self.timescale, "duration": most(duration),
            "samples": most(n), "media_bytes": most(sum(length for _, length in whole)), "keyframes": most(n_keys), "key_ranges": _merged(keys), "ranges": _merged(whole),
        }


def _merged(parts: list[tuple[int, int]]) -> list[dict]:
    """Ranges in sample order, those that touch as one, empty ones left out."""
    out: list[dict] = []
    for at, length in parts:
        if length <= 0 or at < 0 or at > MOST:
            continue
        if out and out[-1]["at"] + out[-1]["length"] == at:
            out[-1]["length"] = min(out[-1]["length"] + length, MOST)
        else:
            out.append({"at": at, "length": min(length, MOST)})
    return out


def _run(data: memoryview, at: int, end: int, base: int, next_at: int, default: tuple[int, int, int], track: _Track) -> int:
    """Samples of a trun box, with the traf's default duration, size and flags; gives where the next run's samples begin.

    Samples without fields of their own are alike, so they are kept as one entry, whatever number the box claims.
    """
    _, flags = _full(data, at)
    n, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
    if flags & 1:
        next_at, at = base + struct.unpack_from(">i", data, at)[0], at + 4
    first = None
    if flags & 4:
        first, at = struct.unpack_from(">I", data, at)[0], at + 4
    place, width = {}, 0
    for field in (0x100, 0x200, 0x400, 0x800):
        if flags & field:
            place[field], width = width, width + 4
    alike = not set(place) & {0x100, 0x200, 0x400}
    if width:
        n = min(n, max(0, end - at) // width)
    done = 0
    while done < n:
        own = [struct.unpack_from(">I", data, at + place[field])[0] if field in place else d for field, d in zip((0x100, 0x200, 0x400), default, strict=True)]
        if not done and first is not None and 0x400 not in place:
            own[2] = first
        count = n - done if alike and (done or first is None) else 1
        track.runs.append((next_at, own[1], count, not own[2] & 0x10000, own[0]))
        next_at, at, done = next_at + own[1] * count, at + width, done + count
    return next_at


def parse(payload: bytes | memoryview | None) -> tuple[str | None, list[dict]]:
    """Brand and tracks of a container; null or foreign bytes give no track."""
    data, tracks, brand, now, moof = memoryview(payload or b""), [], None, None, 0
    by_id: dict[int, _Track] = {}
    trex: dict[int, tuple[int, int, int]] = {}  # default duration, size and flags of a track's fragments
    base, next_at, default = 0, 0, (0, 0, 0)
    try:
        for path, at, end in walk(data, 0, len(data)):
            kind = path[-1]
            if kind == b"ftyp" and len(path) == 1:
                brand = bytes(data[at : at + 4]).decode("latin-1")
            elif path[:2] == (b"moov", b"trak"):
                if kind == b"trak":
                    tracks.append(now := _Track())
                else:
                    now.read(data, kind, at, end)
                    if kind == b"tkhd":
                        by_id[now.id] = now
            elif kind == b"trex":
                number, _, *more = struct.unpack_from(">5I", data, at + 4)
                trex[number] = tuple(more)
            elif kind == b"moof":
                moof = next_at = at - (16 if bytes(data[max(0, at - 16) : at - 8]) == b"\0\0\0\1moof" else 8)
            elif kind == b"tfhd":
                _, flags = _full(data, at)
                number, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
                now = by_id.get(number, _Track())
                # Unless the moof is named, data begin where those of the traf before it end.
                base = moof if flags & 0x20000 else next_at
                if flags & 1:
                    base, at = struct.unpack_from(">Q", data, at)[0], at + 8
                next_at, at = base, at + 4 * bool(flags & 2)
                own = list(trex.get(number, (0, 0, 0)))
                for k, field in enumerate((8, 0x10, 0x20)):
                    if flags & field:
                        own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
                default = tuple(own)
            elif kind == b"trun" and now is not None:
                next_at = _run(data, at, end, base, next_at, default, now)
        return brand, [t.as_row() for t in tracks]
    except (struct.error, ValueError, IndexError):  # a broken table: what is not a container has no tracks
        return brand, []


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mux(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """A container with one sound track whose 8-bit samples are the bytes of ``payload``, in chunks."""
    n, chunks = len(payload), -(-len(payload) // chunk)
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    rest = n - (chunks - 1) * chunk
    runs = [(1, chunk if chunks > 1 else rest, 1)] + ([(chunks, rest, 1)] if chunks > 1 and rest != chunk else [])

    def head(offset: int) -> bytes:
        entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
        wide = offset + n >= 1 << 32
        table = _box(
            b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), _box(b"stts", struct.pack(">IIII", 0, 1, n, 1)),
            _box(b"stsc", struct.pack(">II", 0, len(runs)), *[struct.pack(">III", *r) for r in runs]), _box(b"stsz", struct.pack(">III", 0, 1, n)),
            _box(b"co64" if wide else b"stco", struct.pack(">II", 0, chunks), (offset + chunk * np.arange(chunks)).astype(">u8" if wide else ">u4").tobytes()),
        )
        info = _box(b"minf", _box(b"smhd", struct.pack(">IHH", 0, 0, 0)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), table)
        media = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, rate, n, 0x55C4, 0)), _box(b"hdlr", struct.pack(">II4s12xB", 0, 0, b"soun", 0)), info)
        track = _box(b"trak", _box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, n, 0, 0, 0x100, 0), unity, struct.pack(">II", 0, 0)), media)
        movie = _box(b"moov", _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, rate, n, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2)), track)
        return _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ") + movie

    start = len(head(0)) + (16 if n + 8 >= 1 << 32 else 8)
    front = head(start)
    return front + (struct.pack(">I4sQ", 1, b"mdat", n + 16) if n + 8 >= 1 << 32 else struct.pack(">I4s", n + 8, b"mdat")) + payload


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))
    track = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("media_bytes", pa.int64()), ("keyframes", pa.int64()), ("key_ranges", kinds), ("ranges", kinds)])
    for batch in batches:
        found = [parse(memoryview(x.as_buffer()) if x.is_valid else None) for x in batch.column("media")]  # no copies
        more = [pa.array([b for b, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(track))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "brand", "tracks"])


def media_columns(media: DataFrame) -> DataFrame:
    """``key``, ``media`` with ``brand`` and ``tracks`` (codec, durations, samples, keyframe and sample byte ranges).

    ``media`` must have the columns ``key`` and ``media`` (binary); others are ignored, whatever their names.
    Defined cases: null or empty bytes, and bytes that are no container or have a broken sample table, give no tracks;
    a box that ends after its parent is cut there; repeated rows each get their row; an empty table gives
    an empty one.
    """
    rows = media.select("key", F.col("media").cast("binary").alias("media"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, media binary, brand string, tracks array<{TRACK}>"
    return rows.mapInArrow(_columns, schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as stored media, some megabytes at a time."""
    schema = pa.schema([("key", pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())])), ("media", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            rows.append(({"doc_id": doc_id, "n_bytes": len(raw)}, mux(padded)))
            held += len(padded)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as a container: ``key``, ``media``."""
    rows = shared.plain(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(_store, "key struct<doc_id:bigint,n_bytes:bigint>, media binary")


def digest(found: DataFrame) -> DataFrame:
    """What the query returns of each stored text: its payload is cut from the media by the first track's ranges."""
    t = F.col("tracks")[0]
    payload = F.aggregate(t["ranges"], F.lit(b""), lambda a, r: F.concat(a, F.substring(F.col("media"), (r["at"] + 1).cast("int"), r["length"].cast("int"))))
    text = lambda c: c.cast("string")
    first = t["key_ranges"][0]
    feature = F.concat(
        F.lit("codec="), F.trim(t["codec"]), F.lit(";handler="), t["handler"], F.lit(";timescale="), text(t["timescale"]), F.lit(";duration="), text(t["duration"]), F.lit(";samples="), text(t["samples"]),
        F.lit(";keyframes="), text(t["keyframes"]), F.lit(";ranges="), text(F.size(t["key_ranges"])), F.lit(";first="), text(first["at"]), F.lit("+"), text(first["length"]),
    )
    rows = found.select("key", "media", payload.alias("payload"), feature.alias("feature"))
    return rows.select(
        "key.doc_id", "key.n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(media_columns(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
