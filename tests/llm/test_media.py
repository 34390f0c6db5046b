import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from sparkloom.llm.media import UNKNOWN, carve, correct_type, digest, media_digests, sniff, sniffed, store_wav

SCHEMA = "doc_id long, text string"


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xda" + struct.pack(">H", 2) + b"data\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHH", 1, 1, 1, 24) + bytes(24) + bytes(4)
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"
WHOLE = {"image/png": png(), "application/zip": archive(), "application/gzip": gzip.compress(b"x" * 100), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "audio/wav": store_wav(b"ab")}


def test_each_format_is_found_carved_and_corrected():
    for kind, data in WHOLE.items():
        assert correct_type("text/plain", data) == (kind, True), kind
        held = b"..." + data + b"tail"
        assert (kind, 3, data) in list(carve(held)), kind


def test_broken_structure_is_refused():
    for kind, data in WHOLE.items():
        assert not [x for x in sniff(data[: len(data) - (9 if kind != "application/pdf" else 2)]) if x.kind == kind], kind
    assert sniff(b"GIF89a is a text, %PDF- too, BM, RIFF and PK\x03\x04") == []
    assert correct_type("text/plain", b"hi") == ("text/plain", False) and correct_type("image/png", b"hi") == (UNKNOWN, True)


def test_round_trip(spark):
    texts = [None, "", "a", "é𝄞" * 100, "x" * 64, "RIFF BM GIF89a", "y" * 300_000, "a"]
    rows = {r["doc_id"]: r for r in media_digests(spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 as m")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        with wave.open(io.BytesIO(store_wav(payload))) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert (r["media_bytes"], r["media_sha256"]) == (len(store_wav(payload)), hashlib.sha256(store_wav(payload)).hexdigest())
    assert rows[2][1:] == rows[7][1:] and digest(None) == digest("")
    assert media_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_column_of_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b".." + png()), "image/gif"), (2, None, None), (3, bytearray(GIF), "image/gif")], "id long, body binary, type string")
    got = {r["id"]: r["media"] for r in sniffed(df, "body", "type").collect()}
    assert got[1]["spans"][0]["start"] == 2 and got[3]["kind"] == "image/gif" and not got[3]["corrected"] and got[2]["kind"] == UNKNOWN
