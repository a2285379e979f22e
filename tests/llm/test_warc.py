import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import warc


def expected(rows):
    main = {}
    for pid, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and pid is not None:
            main[raw] = max(main.get(raw, pid), pid)
    out = []
    for pid, html in rows:
        raw = (html or "").encode()
        again = pid is not None and raw in main and main[raw] != pid
        out.append((pid, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", main[raw] if again else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted((tuple(r) for r in warc.digest(pages).collect()), key=str)
    assert got == expected([(r.page_id, r.html) for r in pages.collect()])


def test_hostile_and_odd_rows(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, inner), (2, inner * 40), (3, inner * 40), (4, None), (5, ""), (6, "\r\n\r\n"), (7, "é" * 600), (9, "é" * 600), (8, "é" * 600), (9, "é" * 600), (10, "x" * 999), (11, "x" * 999), (None, "y"), (12, "WARC/1.0\r\n"), (13, "z" * 300_000)]
    pages = spark.createDataFrame([(p, f"http://a/{p}\r\nWARC/1.0", h, 1, "q") for p, h in rows], "page_id long, url string, html string, main long, payload string")
    got = sorted((tuple(r) for r in warc.digest(pages).collect()), key=str)
    assert got == expected(rows)
    path = warc.write(pages.coalesce(1), str(tmp_path / "w"))
    full = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).collect() if r.record_type == "response"}
    assert full[2 if 2 in full else 3] == inner * 40 and full[1] == inner and full[13] == "z" * 300_000
    assert warc.digest(pages.limit(0)).count() == 0
    assert warc.digest(pages.withColumn("url", F.lit(None).cast("string"))).count() == len(rows)


def by_hand(data: bytes) -> list[int]:
    """Offsets of the records of a file, one after another."""
    at, out = 0, []
    while at < len(data):
        out.append(at)
        stop = data.index(b"\r\n\r\n", at)
        size = next(int(x.split(b":")[1]) for x in data[at:stop].split(b"\r\n") if x.lower().startswith(b"content-length"))
        at = stop + 4 + size + 4
    return out


@pytest.mark.parametrize("split", [97, 1000])
def test_splits_anywhere(spark, tmp_path, split):
    """Files cut into splits at any byte, with magic, whole records and line ends inside payloads."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(k, "x" * (k % 7) + ("\r\n" * (k % 4)) + (inner * (k % 3) if k % 2 else "\r\n\r\n" + inner) + "\r\n" * (k % 5)) for k in range(40)]
    rows += [(100, "\r\n\r\n" + inner * 30), (101, "\r\n\r\nWARC/1.1 no header\r\n\r\nWARC/1."), (102, "\r\n\r\n")]
    path = warc.write(spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert got == dict(rows)
    (file,) = (tmp_path / "w").glob("part-*")
    assert len(by_hand(file.read_bytes())) == len(rows)


def test_damage_fails(spark, tmp_path):
    path = warc.write(spark.createDataFrame([(k, "u", "text " * 20) for k in range(9)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    (tmp_path / "w" / f".{file.name}.crc").unlink()
    for bad in (data[:-40], data[40:], data.replace(b"Content-Length: 100", b"Content-Length: 101", 1), data.replace(b"text text", b"tert text", 1)):
        file.write_bytes(bad)
        with pytest.raises(Exception, match="chain|damaged|missing"):
            warc.read(spark, path).collect()


def test_many_copies_go_through_the_filter(spark):
    rows = [(k, "u", "z" * (1000 + k % 50)) for k in range(2000)] + [(5000 + k, "u", f"{k} " * 600) for k in range(50)]
    got = sorted((tuple(r) for r in warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == expected([(p, h) for p, _, h in rows])


def test_chain():
    here, after = np.array([0, 5, 10, 12, 30]), np.array([10, 7, 30, 30, 40])
    assert warc.reached(here, after, 0).tolist() == [True, False, True, False, True]
    assert warc.reached(here, after, 12).tolist() == [False, False, False, True, True]
    assert not warc.reached(here, after, -1).any()
    assert warc.exits(here, after, 40).tolist() == [40, -1, 40, 40, 40]
    assert warc.exits(here, after, 30).tolist() == [30, -1, 30, 30, 40]
    none = np.array([], np.int64)
    assert warc.exits(none, none, 9).tolist() == [] == warc.reached(none, none, 0).tolist()
