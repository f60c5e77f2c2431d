"""Media columns: sniff what stored bytes really are, and carve what they hold.

An Aho-Corasick automaton finds every magic number in one pass; a format's
validator then follows its structure from there and gives its exact length, or
refuses it. The format at offset 0 that spans the bytes corrects the declared
type; other confirmed ones are embedded media and are carved out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from shardloom.llm.common import name_package

OCTETS = "application/octet-stream"


class Found(NamedTuple):
    type: str
    start: int
    length: int


def _riff(b: bytes, at: int) -> int | None:
    """Walk the chunks; sizes must fill the form exactly, a wave needs fmt before data."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    form, pos, names = b[at + 8 : at + 12], at + 12, []
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while pos + 8 <= end:
        names.append(b[pos : pos + 4])
        n = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + n + (n & 1)
    if pos != end or not names:
        return None
    if form == b"WAVE" and (names[0] != b"fmt " or b"data" not in names):
        return None
    return end - at


def _riff_type(b: bytes, at: int) -> str:
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp"}.get(b[at + 8 : at + 12], "video/avi")


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return pos - at
    return None


def _blocks(b: bytes, pos: int) -> int | None:
    """End of a run of length-prefixed GIF sub-blocks."""
    while pos < len(b):
        n = b[pos]
        pos += 1 + n
        if n == 0:
            return pos
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            nxt = _blocks(b, pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            nxt = _blocks(b, pos + 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 128 else 0))
        else:
            return None
        if nxt is None:
            return None
        pos = nxt
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scan = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or not 0xC0 <= mark <= 0xFE or mark == 0xD8:
            return None
        pos += 2 + n
        if mark == 0xDA:
            scan = True
            while True:  # entropy-coded data: up to a marker that is no stuffing or restart
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if b[pos + 1] == 0xD9:
                return pos + 2 - at if scan else None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, _, offset, head = struct.unpack_from("<IIII", b, at + 2)
    if head not in (12, 40, 52, 56, 108, 124) or not 14 + head <= offset <= size <= len(b) - at:
        return None
    return size


def _gzip(b: bytes, at: int, step: int = 1 << 16) -> int | None:
    """Unpack to the end of the stream, a piece at a time."""
    d, pos = zlib.decompressobj(31), at
    try:
        while not d.eof:
            if d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            elif pos < len(b):
                piece = b[pos : pos + step]
                pos += len(piece)
                d.decompress(piece, 1 << 20)
            elif not d.decompress(b"", 1 << 20):
                return None
    except zlib.error:
        return None
    return pos - len(d.unused_data) - at


@lru_cache(maxsize=1)
def _archives(b: bytes) -> dict[int, int]:
    """Start and end of every run of bytes whose end record's directory lies right before it; of a start the first."""
    out: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if end + 22 + note <= len(b):
            out.setdefault(end - offset - size, end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


def _zip(b: bytes, at: int) -> int | None:
    end = _archives(b).get(at)
    return end and end - at


def _pdf(b: bytes, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    return end + 5 - at


def _ogg(b: bytes, at: int) -> int | None:
    """Pages one after another, the last with the end flag."""
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b):
        k = b[pos + 26]
        last = b[pos + 5] & 4
        pos += 27 + k + sum(b[pos + 27 : pos + 27 + k])
        if pos > len(b):
            return None
        if last:
            return pos - at
    return None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks from STREAMINFO on; frames have no length, so it reaches to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        head = struct.unpack_from(">I", b, pos)[0]
        n = head & 0xFFFFFF
        if first and (head >> 24 & 127 or n != 34):
            return None
        pos, first = pos + 4 + n, False
        if head >> 31:
            return len(b) - at if pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] >> 1 == 0x7C else None
    return None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes from ftyp (whose size stands before the magic) while their names are printable."""
    pos, names = at, []
    while pos + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if not (name.isalnum() and 8 <= n <= len(b) - pos):
            break
        names.append(name)
        pos += n
    return pos - at if b"moov" in names or b"mdat" in names else None


# Magic numbers, by media type, with the distance from the start of the file.
MAGIC: list[tuple[bytes, int, str, Callable[[bytes, int], int | None]]] = [
    (b"RIFF", 0, "riff", _riff),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
]


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(MAGIC):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(blob: bytes) -> list[Found]:
    """Confirmed media in order of their start. A zip's or an ogg's inner magics are its own parts."""
    out: list[Found] = []
    own: dict[str, int] = {}
    for last, k in _automaton().iter(blob.decode("latin-1")):
        magic, back, kind, check = MAGIC[k]
        at = last - len(magic) + 1 - back
        if at < own.get(kind, 0) or at < 0:
            continue
        n = check(blob, at)
        if n:
            out.append(Found(_riff_type(blob, at) if kind == "riff" else kind, at, n))
            if kind in ("application/zip", "audio/ogg"):
                own[kind] = at + n
    return sorted(out, key=lambda f: f.start)


def inspect(blob: bytes, declared: str | None) -> tuple[str, list[Found]]:
    """The corrected type and the embedded media.

    The type is that of a confirmed format at 0 that spans the bytes; else the
    declared one, unless it is a format that is validated here and was not
    confirmed (then unknown).
    """
    found = sniff(blob)
    whole = next((f for f in found if f.start == 0 and f.length == len(blob)), None)
    known = {m[2] for m in MAGIC} | {"audio/wav", "image/webp", "video/avi"}
    kind = whole.type if whole else OCTETS if declared is None or declared in known else declared
    return kind, [f for f in found if f is not whole]


def to_wave(samples: bytes, rate: int = 16000) -> bytes:
    """Bytes as 8-bit samples of one channel, losslessly; an odd number gets the pad byte the format asks for."""
    pad = b"\0" * (len(samples) & 1)
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    size = 4 + 8 + len(fmt) + 8 + len(samples) + len(pad)
    return b"".join((b"RIFF", struct.pack("<I", size), b"WAVEfmt ", struct.pack("<I", len(fmt)), fmt, b"data", struct.pack("<I", len(samples)), samples, pad))


def from_wave(blob: bytes) -> bytes:
    """The samples of a wave, found by walking its chunks."""
    pos = 12
    while pos + 8 <= len(blob):
        name, n = struct.unpack_from("<4sI", blob, pos)
        if name == b"data":
            return blob[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def payload_of(text: str | None, unit: int = 576) -> bytes:
    """UTF-8 of a text with bytes 255 up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


_PARTS = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))


def media_column(df: DataFrame, blob_col: str, declared_col: str | None = None, carve: bool = True) -> DataFrame:
    """``df`` with columns media_type, corrected (boolean) and embedded (type, start, length, bytes).

    A null blob has null results; an empty one is unknown; columns of ``df``
    that are named like a result are replaced; repeated rows are answered each.
    """
    name_package(df.sparkSession)
    new = ("media_type", "corrected", "embedded")
    df = df.drop(*(c for c in df.columns if c in new))
    names = df.columns
    at, say = names.index(blob_col), names.index(declared_col) if declared_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, fixed, parts = [], [], []
            for i, blob in enumerate(b.column(at)):
                raw, said = blob.as_py(), b.column(say)[i].as_py() if say is not None else None
                if raw is None:
                    kinds.append(None), fixed.append(None), parts.append(None)
                    continue
                kind, inner = inspect(raw, said)
                kinds.append(kind)
                fixed.append(kind != said)
                parts.append([{"type": f.type, "start": f.start, "length": f.length, "bytes": raw[f.start : f.start + f.length] if carve else None} for f in inner])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(parts, _PARTS)], names=[*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, media_type string, corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint,bytes:binary>>")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (binary) of every text: its padded UTF-8 stored as a wave's samples.

    Null and empty texts have no bytes and a payload of padding. Very long texts are
    stored whole; repeated rows and null ids are answered each; an empty table
    gives no rows; other columns are not read.
    """
    name_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                ids, texts = b.column(0).slice(i, 64), b.column(1).slice(i, 64).to_pylist()
                n = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([to_wave(payload_of(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def stored_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of media read back; the payload is carved from where the sniffer found the wave.

    ``feature`` names the type found and corrected, the samples, their mean and
    spread, and each embedded format with its place. A null medium has null digests
    and feature; one that is no wave is refused. Repeated rows are answered each.
    """
    import hashlib

    name_package(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for blob in b.column(2):
                raw = blob.as_py()
                if raw is None:
                    for col in rows:
                        col.append(None)
                    continue
                kind, inner = inspect(raw, OCTETS)
                if kind != "audio/wav":
                    raise ValueError("stored media is no wave")
                data = from_wave(raw)
                x = np.frombuffer(data, dtype=np.uint8)
                held = ",".join(f"{f.type}@{f.start}+{f.length}" for f in inner)
                feature = f"{kind};declared={OCTETS};samples={len(data)};mean={x.mean():.4f};std={x.std():.4f};embedded={held}"
                for col, v in zip(rows, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
