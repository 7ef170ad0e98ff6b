"""Media columns: ISO media containers in a binary column.

Each text becomes an audio track of unsigned 8-bit samples: `ftyp`, `moov` (with its sample tables) and `mdat`. One access unit is
64 bytes; every SYNC-th is a sync sample. The containers are written as a table, read back, and walked box by box: the codec,
the duration and the byte ranges of the keyframes come from the sample tables alone.

Nulls and edges: a null text is the empty text, whose payload is 64 zero bytes. Equal texts give equal containers. Repeated rows
each get a row, a null doc_id stays null, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import map_rows, saved

UNIT = 64
RATE = 8000
#: Access units from one sync sample to the next, and in a chunk.
SYNC = 64
CHUNK = 256


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(text: bytes) -> bytes:
    """The container of a text's padded bytes. 64-bit chunk offsets and durations, so length is not bounded by the format."""
    payload = text + bytes(-len(text) % UNIT if text else UNIT)
    units = len(payload) // UNIT
    chunks, last = divmod(units, CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        runs = ([(1, CHUNK, 1)] if chunks else []) + ([(chunks + 1, last, 1)] if last else [])
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        sync = range(1, units + 1, SYNC)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64", struct.pack(f">I{chunks + bool(last)}Q", chunks + bool(last), *(first + i * CHUNK * UNIT for i in range(chunks + bool(last))))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text samples\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(0)) + head
    mdat = struct.pack(">I", len(payload) + 8) + b"mdat" if head == 8 else struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", len(payload) + 16)
    return b"".join((ftyp, moov(first), mdat, payload))


def walk(data: bytes, at: int = 0, end: int | None = None, path: str = ""):
    """Yields (path, start of body, end of body) of every box, nested ones too."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, stop
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf"):
            yield from walk(data, body, stop, name)
        at = stop


def read_tables(data: bytes) -> dict:
    """Codec, time scale, duration, and each sample's byte range, from the boxes; the payload is not read."""
    box = {name.rpartition("/")[2]: (a, b) for name, a, b in walk(data)}

    def numbers(kind: str, form: str, skip: int = 8):
        a, _ = box[kind]
        n = struct.unpack_from(">I", data, a + 4)[0]
        return [x[0] if len(form) == 1 else x for x in struct.iter_unpack(f">{form}", data[a + skip : a + skip + n * struct.calcsize(f">{form}")])]

    a, _ = box["stsd"]
    codec = data[a + 12 : a + 16].decode("latin-1")
    a, _ = box["mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = box["stsz"]
    fixed, count = struct.unpack_from(">II", data, a + 4)
    sizes = [fixed] * count if fixed else [x[0] for x in struct.iter_unpack(">I", data[a + 12 : a + 12 + 4 * count])]
    offsets = numbers("co64", "Q") if "co64" in box else numbers("stco", "I")
    runs, ranges, sample = numbers("stsc", "III"), [], 0
    for i, (first, per, _) in enumerate(runs):
        for chunk in range(first, runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1):
            at = offsets[chunk - 1]
            for size in sizes[sample : sample + per]:
                ranges.append((at, size))
                at += size
            sample += per
    return {"codec": codec, "scale": scale, "duration": duration, "samples": ranges, "sync": numbers("stss", "I") if "stss" in box else list(range(1, len(ranges) + 1))}


def _features(data: bytes, n_bytes: int) -> dict:
    got = read_tables(data)
    ranges = got["samples"]
    keys = [ranges[i - 1] for i in got["sync"]]
    joined: list[list[int]] = []
    for at, size in ranges:
        if joined and sum(joined[-1]) == at:
            joined[-1][1] += size
        else:
            joined.append([at, size])
    payload = b"".join(data[a : a + n] for a, n in joined)
    tables = zlib.crc32(struct.pack(f">{2 * len(keys)}Q", *(x for k in keys for x in k)))
    return {
        "n_bytes": n_bytes,
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": f"codec={got['codec'].strip()};rate={got['scale']};duration={got['duration']};samples={len(ranges)};keyframes={len(keys)};ranges={tables:08x}",
        "codec": got["codec"].strip(),
        "duration_s": got["duration"] / got["scale"],
        "keyframe_start": [a for a, _ in keys],
        "keyframe_bytes": [n for _, n in keys],
    }


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the container of every text."""

    def make():
        def work(batch):
            texts = [x or b"" for x in batch["text "]]
            return {"doc_id": batch["doc_id"], "n_bytes": list(map(len, texts)), "media": list(map(write_container, texts))}

        return work

    return map_rows(docs.select("doc_id", F.col(text).alias("text ")), "doc_id bigint, n_bytes bigint, media binary", make, binary=("text ",))


def describe(media: DataFrame) -> DataFrame:
    """Reads containers back: digests of the payload and the container, and what the sample tables say."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframe_start array<bigint>, keyframe_bytes array<bigint>"

    def make():
        def work(batch):
            rows = [_features(m, n) for m, n in zip(batch["media"], batch["n_bytes"], strict=True)]
            names = schema.replace(",", "").split()[2::2]
            return {"doc_id": batch["doc_id"]} | {k: [r[k] for r in rows] for k in names}

        return work

    return map_rows(media.select("doc_id", "n_bytes", "media"), schema, make)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text as a container in a table, reads that table back and describes it."""
    return describe(saved(encode(docs), "media"))
