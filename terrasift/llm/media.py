"""Media columns: sniffing signatures, checking structure, carving embedded media.

An Aho-Corasick automaton finds every magic number in one pass over the bytes. A hit counts only
if the format's validator can follow the structure from there; the validator also says where the
medium ends, which is what lets it be carved out of surrounding bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import others

# Magic numbers of the formats.
MAGIC = {
    "bmp": b"BM",
    "gif": b"GIF87a",
    "gif89": b"GIF89a",
    "gzip": b"\x1f\x8b\x08",
    "jpeg": b"\xff\xd8\xff",
    "pdf": b"%PDF-",
    "png": b"\x89PNG\r\n\x1a\n",
    "riff": b"RIFF",
    "zip": b"PK\x03\x04",
}


class Ahead:
    """First place of a marker from some place on; asked in rising order, the bytes are searched once a marker."""

    def __init__(self, b: bytes):
        self.b = b
        self.found: dict[bytes, tuple[int, int]] = {}

    def find(self, marker: bytes, at: int) -> int:
        since, place = self.found.get(marker, (0, -2))
        if place == -2 or at < since or -1 < place < at:
            place = self.b.find(marker, at)
            self.found[marker] = at, place
        return place


def _png(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    p = at + 8
    while p + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, p)
        end = p + 12 + size
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if b[p + 4 : p + 8] == b"IEND":
            return "image/png", end - at
        p = end
    return None


def _gif(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    frames = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return ("image/gif", p + 1 - at) if frames else None
        if kind == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
            frames += 1
        elif kind == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        (size,) = struct.unpack_from(">H", b, p + 2)
        if size < 2 or mark < 0xC0:
            return None
        p += 2 + size
        if mark == 0xDA:
            end = ahead.find(b"\xff\xd9", p)
            return ("image/jpeg", end + 2 - at) if end >= 0 else None
    return None


def _riff(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    end, form = at + 8 + struct.unpack_from("<I", b, at + 4)[0], b[at + 8 : at + 12]
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(form)
    if kind is None or end > len(b):
        return None
    p = at + 12
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return (kind, end - at) if p == end else None


def _bmp(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    fits = zero == 0 and header in (12, 40, 108, 124) and 14 + header <= start <= size <= len(b) - at
    return ("image/bmp", size) if fits else None


def _gzip(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    p, step = at, 1 << 16
    try:
        while not inflate.eof and p < len(b):
            inflate.decompress(b[p : p + step])
            p += step
    except zlib.error:
        return None
    return ("application/gzip", min(p, len(b)) - len(inflate.unused_data) - at) if inflate.eof else None


def _zip(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    end = ahead.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start = struct.unpack_from("<II", b, end + 12)
    if start + size != end - at or b[at + start : at + start + 4] not in (b"PK\x01\x02", b"PK\x05\x06"):
        return None
    return "application/zip", end + 22 + struct.unpack_from("<H", b, end + 20)[0] - at


def _pdf(b: bytes, at: int, ahead: Ahead) -> tuple[str, int] | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    end = ahead.find(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if -1 < ahead.find(b"startxref", at) < end else None


VALIDATORS: dict[str, Callable[[bytes, int, Ahead], tuple[str, int] | None]] = {
    "bmp": _bmp, "gif": _gif, "gif89": _gif, "gzip": _gzip, "jpeg": _jpeg, "pdf": _pdf, "png": _png, "riff": _riff, "zip": _zip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (name, len(magic)))
    found.make_automaton()
    return found


def sniff(b: bytes, machine: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium, outermost first; hits inside a found medium are skipped."""
    found, covered, ahead = [], 0, Ahead(b)
    for last, (name, size) in machine.iter(b.decode("latin-1")):
        at = last + 1 - size
        if at >= covered and (hit := VALIDATORS[name](b, at, ahead)):
            found.append((hit[0], at, hit[1]))
            covered = at + hit[1]
    return found


def sniff_media(df: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """Adds ``media_type``, ``type_corrected`` and ``media_parts`` to a table with a binary column.

    ``media_type`` is the type of a medium that starts at byte 0, else the declared type, else
    application/octet-stream; ``type_corrected`` says that it differs from the declared one.
    ``media_parts`` lists type, offset, length and carved bytes of each valid medium. Null and empty
    contents have no parts. Columns of these three names are replaced.
    """
    kept = others(df.columns, ("media_type", "type_corrected", "media_parts"))
    if declared is not None and declared not in kept:
        raise ValueError(f"no column {declared}")
    part = "array<struct<type: string, start: bigint, length: bigint, content: binary>>"
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    schema = f"{kinds}, media_type string, type_corrected boolean, media_parts {part}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        part_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            types, corrected, parts = [], [], []
            said = batch.column(kept.index(declared)).to_pylist() if declared else [None] * len(batch)
            for value, told in zip(batch.column(kept.index(content)), said, strict=True):
                b = value.as_py() or b""
                found = sniff(b, machine)
                kind = found[0][0] if found and found[0][1] == 0 else told or "application/octet-stream"
                types.append(kind)
                corrected.append(told is not None and kind != told)
                parts.append([{"type": t, "start": s, "length": n, "content": b[s : s + n]} for t, s, n in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(corrected, pa.bool_()), pa.array(parts, part_type)], [*kept, "media_type", "type_corrected", "media_parts"])

    return df.select(*kept).mapInArrow(run, schema)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as unsigned 8-bit mono samples of a WAV file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    rest = b"WAVE" + form + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(rest)) + rest


def wav_samples(medium: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    p = 12
    while p + 8 <= len(medium):
        size = struct.unpack_from("<I", medium, p + 4)[0]
        if medium[p : p + 4] == b"data":
            return medium[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def text_media(df: DataFrame, text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Every text stored as a WAV medium, sniffed, carved, read back and described.

    The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples. The
    stored bytes are declared as ``declared``; sniffing corrects that. Null texts count as empty (one
    block of zeros). Returns the other columns and n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature (type, whether the type was corrected, media found inside the
    samples, zero samples, mean sample, and sample changes of sign about the middle, per block of 64).
    Other columns of these names are replaced. Repeated rows give repeated rows.
    """
    import numpy as np

    new = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    rest = others(df.columns, (text, *new))
    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(len(rest)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                stored = wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                (kind, at, size), *_ = sniff(stored, machine)
                payload = wav_samples(stored[at : at + size])
                inner = sniff(payload, machine)
                samples = np.frombuffer(payload, np.uint8)
                high = samples > 127
                feature = f"{kind};corrected={int(kind != declared)};inside={len(inner)};zeros={int((samples == 0).sum())};mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};turns={int((high[1:] != high[:-1]).sum()) * 64000 // len(samples)}"
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * len(new)
            types = [pa.int64() if k == "bigint" else pa.string() for k in new.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*rest, *new])

    return df.select(*rest, text).mapInArrow(run, ", ".join([*kinds, *(f"{k} {t}" for k, t in new.items())]))
