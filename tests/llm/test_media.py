import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from shardloom.llm import media


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "again")
    return f.getvalue()


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04JF\xff\xda\0\x04\0\0\x11\xff\0\x22\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 14 + 40 + 4, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"


def test_carves_every_embedded_format():
    parts = [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("application/gzip", gzip.compress(b"x" * 50)), ("application/zip", zipped()), ("audio/wav", media.to_wave(b"abc"))]
    blob, want = b"junk BM RIFF PK\3\4 ", []
    for kind, raw in parts:
        want.append((kind, len(blob), len(raw)))
        blob += raw + b" filler "
    got = [tuple(f) for f in media.sniff(blob)]
    assert [g for g in got if g in want] == want and len(got) == len(want)


def test_damage_is_refused():
    bad = bytearray(png())
    bad[20] ^= 1
    assert media.sniff(bytes(bad)) == [] and media.sniff(png()[:-3]) == [] and media.sniff(media.to_wave(b"abcd")[:-1]) == []


def test_wave_is_lossless_and_standard():
    for raw in (b"", b"\xff", bytes(range(256)) * 9):
        w = media.to_wave(raw)
        assert media.from_wave(w) == raw and media.inspect(w, None)[0] == "audio/wav"
        if raw:
            with wave.open(io.BytesIO(w)) as f:
                assert f.readframes(f.getnframes()) == raw and f.getsampwidth() == 1


def test_column(spark):
    rows = [(1, "image/jpeg", png(), "x"), (2, None, None, "x"), (3, "text/plain", b"hello", "x"), (4, "image/png", b"no", "x"), (4, "image/png", b"", "x")]
    df = spark.createDataFrame(rows, "doc_id long, said string, blob binary, media_type string")
    got = [(r.doc_id, r.media_type, r.corrected) for r in media.media_column(df, "blob", "said").collect()]
    assert got == [(1, "image/png", True), (2, None, None), (3, "text/plain", False), (4, media.OCTETS, True), (4, media.OCTETS, True)]


def test_digest_round_trip(spark):
    texts = [None, "", "é" * 288, "x" * 577, "GIF89a text BM", "y" * 200000, "x" * 577]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.stored_digest(media.text_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pay[-32:]) and r.media_sha256 == hashlib.sha256(media.to_wave(pay)).hexdigest()
    assert got[3].feature == got[6].feature
    assert media.stored_digest(media.text_media(df.limit(0))).count() == 0


def test_a_null_medium_has_null_digests(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 0, media.to_wave(b"\xff" * 576))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.stored_digest(df).collect()}
    assert got[1].n_bytes == 3 and got[1].payload_sha256 is None and got[1].feature is None and got[2].payload_bytes == 576
