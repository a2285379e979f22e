"""Ogg as a media column: texts as 8-bit samples in logical streams, and a reader that checks and demultiplexes.

Writing: the payload's blocks go round robin to `STREAMS` logical streams, one packet a block; packets
are laced into pages of at most 255 segments, and the streams' pages are interleaved. Reading: page
checksums and sequence numbers are verified, lacing values give back the packets (also across pages),
serial numbers part the streams, and granule positions (samples so far) give the timestamps.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, text_bytes

RATE = 8000  # samples a second
STREAMS = 2
BLOCK = 4096  # bytes of a packet
SEGMENTS = 255  # of a page
ALIGN = 64
MAGIC = b"GLPCM8\x00\x01"
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04C11DB7, not reflected, from 0), by way of the reflected one on reversed bits."""
    x = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % ALIGN or (0 if text else ALIGN))


def _pages(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """The pages of one stream; ends: the granule position after each packet. The first packet has its own page."""
    out: list[bytes] = []

    def page(laces: bytes, body: bytes, granule: int, flags: int) -> None:
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, len(out), 0, len(laces)) + laces
        raw = head + body
        out.append(raw[:22] + crc(raw).to_bytes(4, "little") + raw[26:])

    page(bytes([len(packets[0])]), packets[0], 0, 2)
    laces, parts, granule, continued = bytearray(), [], -1, False
    for packet, end in zip(packets[1:], ends[1:], strict=True):
        need = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while need:
            room = SEGMENTS - len(laces)
            take, need = need[:room], need[room:]
            size = sum(take)
            laces += bytes(take)
            parts.append(packet[at : at + size])
            at += size
            if not need:
                granule = end
            if len(laces) == SEGMENTS:
                page(bytes(laces), b"".join(parts), granule, int(continued))
                laces, parts, granule, continued = bytearray(), [], -1, bool(need)
    page(bytes(laces), b"".join(parts), granule if laces else (ends[-1] if len(packets) > 1 else 0), 4 | int(continued))
    return out


def write(payload: bytes) -> bytes:
    """An Ogg file that holds the payload's bytes as samples."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    streams = []
    for k in range(STREAMS):
        own = blocks[k::STREAMS]
        head = MAGIC + struct.pack("<IHHQ", RATE, k, STREAMS, sum(map(len, own)))
        ends, total = [0], 0
        for b in own:
            total += len(b)
            ends.append(total)
        streams.append(_pages(0x47000000 + k, [head, *own], ends))
    longest = max(map(len, streams))
    return b"".join(s[i] for i in range(longest) for s in streams if i < len(s))


def read(media: bytes) -> tuple[bytes, str]:
    """The payload of a file of write() and its features; ValueError for a damaged file."""
    at, n_pages = 0, 0
    streams: dict[int, dict] = {}
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError("a page header is cut off")
        magic, version, flags, granule, serial, seq, check, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        laces = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        raw = media[at:end]
        if len(laces) < n or end > len(media) or crc(raw[:22] + bytes(4) + raw[26:]) != check:
            raise ValueError(f"the checksum of the page at {at} is wrong")
        s = streams.setdefault(serial, {"seq": 0, "packets": [], "open": [], "granule": 0, "times": [], "end": False})
        if seq != s["seq"] or s["end"] or bool(flags & 2) != (seq == 0) or bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"the page at {at} is out of order")
        body = 27 + n
        for lace in laces:
            s["open"].append(raw[body : body + lace])
            body += lace
            if lace < 255:
                s["packets"].append(b"".join(s["open"]))
                s["open"] = []
        if granule >= 0:
            if granule < s["granule"]:
                raise ValueError("granule positions go back")
            s["granule"] = granule
            s["times"].append(granule / RATE)
        s["seq"], s["end"] = seq + 1, bool(flags & 4)
        at, n_pages = end, n_pages + 1
    order = {}
    for s in streams.values():
        if s["open"] or not s["end"] or not s["packets"] or not s["packets"][0].startswith(MAGIC):
            raise ValueError("a stream is cut off or unknown")
        rate, k, of, total = struct.unpack_from("<IHHQ", s["packets"][0], len(MAGIC))
        if s["granule"] != total or sum(map(len, s["packets"][1:])) != total:
            raise ValueError("a stream has not the samples it claims")
        order[k] = s
    if not order or sorted(order) != list(range(of)):
        raise ValueError("a stream is missing")
    bodies = [order[k]["packets"][1:] for k in range(of)]
    payload = b"".join(b[i] for i in range(max(map(len, bodies))) for b in bodies if i < len(b))
    ends = ",".join(f"{order[k]['granule']}" for k in range(of))
    feature = f"pages={n_pages};packets={sum(map(len, bodies))};granules={ends};seconds={max(order[k]['times'][-1] for k in range(of)):.6f};rate={rate}"
    return payload, f"{feature};{signal(bodies)}"


def signal(streams: list[list[bytes]]) -> str:
    """What the decoded samples of each stream are like: energy (sum of squares), peak and zero crossings around the level 128."""
    found = []
    for packets in streams:
        energy = peak = crossings = 0
        last = None
        for p in packets:
            x = np.frombuffer(p, np.uint8).astype(np.int32) - 128
            if not len(x):
                continue
            energy += int((x.astype(np.int64) ** 2).sum())
            peak = max(peak, int(np.abs(x).max()))
            below = x < 0
            crossings += int((below[1:] != below[:-1]).sum()) + int(last is not None and last != below[0])
            last = below[-1]
        found.append((energy, peak, crossings))
    return ";".join(f"{name}={','.join(str(f[k]) for f in found)}" for k, name in enumerate(("energy", "peak", "crossings")))


def store(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, padded with zero bytes to a positive multiple of 64, as an Ogg file.

    Null texts count as empty; n_bytes is the length without padding. Rows with a null or repeated id
    are kept as they are; other columns are dropped; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(files: DataFrame) -> DataFrame:
    """`files` (doc_id, n_bytes, media) with the payload read back and its features; a damaged file fails the job."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read(x) for x in text_bytes(batch, "media")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], [*batch.schema.names, "payload", "feature"]
            )

    return files.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def digest(docs: DataFrame) -> DataFrame:
    """The digests of every document's stored and reread media."""
    return load(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{ALIGN}, {ALIGN})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
