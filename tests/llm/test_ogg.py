import hashlib
import zlib

import pytest

from graphloom.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_crc():
    for x in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.crc(x) == slow_crc(x)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 4096, 4097, 8192, 65025, 65088, 300_000, 1_300_000])
def test_round_trip(n):
    payload = ogg.pad(bytes(i * 7 % 251 for i in range(n)))
    assert len(payload) % 64 == 0 and payload
    got, feature = ogg.read(ogg.write(payload))
    assert got == payload
    assert f"seconds={max(sum(map(len, [payload[i:i + 4096] for i in range(0, len(payload), 4096)][k::2])) for k in (0, 1)) / 8000:.6f}" in feature


def test_damage_is_found():
    media = bytearray(ogg.write(bytes(range(64)) * 3000))
    for at in (5, 30, 100, 70_000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            ogg.read(bytes(bad))
    with pytest.raises(ValueError):
        ogg.read(bytes(media[:-10]))


def test_whole_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (None, "y", "x"), (-3, "z" * 400_000, None), (-4, "y", None)], docs.schema))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = ogg.digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = text[r.doc_id]
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    by = {r.doc_id: r for r in rows}
    assert (by[None].media_sha256, by[None].feature) == (by[-4].media_sha256, by[-4].feature)
    assert ogg.digest(docs.limit(0)).count() == 0


def test_signal_of_the_samples():
    packets = [[b"\x80\x81\x00", b"", b"\x7f\xff"], [bytes([128, 127, 128])]]
    # around 128: 0 1 -128 | -1 127 and 0 -1 0
    assert ogg.signal(packets) == f"energy={1 + 128 * 128 + 1 + 127 * 127},1;peak=128,1;crossings=2,2"
    one, two = ogg.read(ogg.write(ogg.pad(b"a" * 640)))[1], ogg.read(ogg.write(ogg.pad(b"ab" * 320)))[1]
    assert one != two
