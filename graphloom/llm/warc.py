"""WARC archives: a writer with revisit records and a reader that trusts only chains of record boundaries.

The archives are written by Spark's text writer: a row is a record, the line separator the two line
ends after a block, so files land wherever Spark can write. Reading splits a file wherever Spark does:

1. tasks cut their splits at a line feed and the magic, and emit for each such candidate header that parses
   the offset of its successor (header, Content-Length, two line ends), and where the chain of successors
   leaves the split (pointer jumping within the task);
2. running sums of the splits' bytes make offsets absolute, and pointer jumping over the candidates that chains from
   other splits lead to finds the one at which the chain from the file's start enters each split;
3. from there tasks mark what the chain reaches; a candidate it passes over is magic inside a payload;
4. the splits are read again: a record that ends where its piece ends is done, and only pieces of records
   that hold rejected magic are brought together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import new_path, prepare, sieve, stage

LEAST = 1000  # bytes of a payload that later copies revisit
END = b"\r\n\r\n"
#: Where Spark's reader parts a file. It stands in no valid header, and no end of it begins it anew, so that no
#: failed match hides one.
CUT = b"\nWARC/1."
TAIL = END[:-1]  # what a piece holds of a record's two line ends
_HEAD = re.compile(rb"(?:WARC/1\.)?[01]((?:\r\n[^\r\n]+)*)\r\n\r(\n|\Z)")
_FIELD = re.compile(rb"\r\n([!#-'*+.0-9A-Z^_`a-z|~-]+):[ \t]*([^\r\n]*)")
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_types(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """`pages` with sha1, payload_bytes and `main`: the largest page_id of the payload's copies where they count as such.

    Copies have equal SHA-1, SHA-256 and length. Digests are counted without the payloads; of the rows, only those
    whose digest may have copies (by a filter of fixed size) go through a join, the others stay where they are.
    A hot payload only meets a partial maximum and a join that can be split.
    """
    rows = pages.withColumn("_raw", F.col(payload).cast("binary"))
    rows = rows.withColumn("sha1", F.sha1("_raw")).withColumn("payload_bytes", F.length("_raw").cast("long"))
    rows = rows.withColumn("_key", F.when(F.col("payload_bytes") >= LEAST, F.sha2("_raw", 256))).drop("_raw")
    copies = rows.filter("_key is not null").groupBy("_key", "sha1").agg(F.max("page_id").alias("main"), F.count("*").alias("_n"))
    copies = stage(copies.filter("_n > 1 and main is not null").select("_key", "sha1", "main"), "copies")
    rows = sieve(rows, copies, "_key", "_may")
    rare = rows.filter("not _may").drop("_key", "_may").withColumn("main", F.lit(None).cast(copies.schema["main"].dataType))
    return rare.unionByName(rows.filter("_may").drop("_may").join(copies, ["_key", "sha1"], "left").drop("_key"))


def write(pages: DataFrame, path: str) -> str:
    """Write one record for each row of `pages` (page_id, url, html) below `path`; returns `path`.

    Null html is an empty payload, a null url an empty target. Of rows with equal payloads of at least
    1000 bytes that with the largest page_id is a response, the others (also repeated rows of another
    id) are revisits of it; all others, and rows with a null id, are responses. Line ends in a url
    become spaces. Other columns are ignored; an empty table writes an archive without records.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = record_types(rows)
    again = F.col("main").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("main"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    eol = "\r\n"
    head = F.concat(
        F.lit("WARC/1.1" + eol + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(eol + "WARC-Record-ID: "), uri(F.col("page_id")),
        F.lit(eol + "WARC-Date: 2024-01-01T00:00:00Z" + eol + "WARC-Target-URI: "), F.col("url"),
        F.lit(eol + "Content-Type: text/html; charset=utf-8" + eol + "WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(eol + "WARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(again, F.concat(F.lit(eol + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + eol + "WARC-Refers-To: "), uri(F.col("main")))).otherwise(""),
        F.lit(eol + "Content-Length: "), F.when(again, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit(eol + eol),
    )
    value = F.concat(head, F.when(again, "").otherwise(F.col("payload")))
    rows.select(value.alias("value")).write.option("lineSep", END.decode()).text(path)
    return path


def header(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, begin, size) of the record that a piece begins with (its magic may be cut off); None if there is none.

    Where the block begins with magic, the cut has taken the header's last line feed."""
    m = _HEAD.match(piece)
    if not m:
        return None
    fields, at = {}, 0
    for f in _FIELD.finditer(m[1]):
        if f.start() != at:
            return None
        at = f.end()
        fields[f[1].decode().lower()] = f[2].decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if at != len(m[1]) or "warc-type" not in fields or not (size.isascii() and size.isdigit()):
        return None
    return fields, m.end() + (0 if m[2] else 1), int(size)


def exits(here: np.ndarray, after: np.ndarray, stop: int) -> np.ndarray:
    """Where the chain from each candidate leaves [0, stop), by pointer jumping; -1 if it meets no boundary on the way. here is sorted."""
    n = len(here)
    out = after >= stop
    to = np.searchsorted(here, after)
    hit = ~out & (to < n) & (here[np.minimum(to, n - 1)] == after) if n else out
    to = np.where(hit, to, np.arange(n))  # an end points to itself
    while True:
        jumped = to[to]
        if (jumped == to).all():
            return np.where(out[to], after[to], -1)
        to = jumped


def reached(here: np.ndarray, after: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates the chain from the one at `entry` reaches, by pointer jumping: every round doubles the stride."""
    n = len(here)
    to = np.searchsorted(here, after)
    to = np.append(np.where((to < n) & (here[np.minimum(to, n - 1)] == after), to, n), n)
    mark = np.zeros(n + 1, bool)
    mark[:n] = here == entry
    while True:
        more = mark.copy()
        more[to[mark]] = True
        jumped = to[to]
        if (more == mark).all() and (jumped == to).all():
            return mark[:n]
        mark, to = more, jumped


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, total, value): the pieces of the files below path between cuts, in the order of each split."""
    text = spark.read.option("lineSep", CUT.decode()).option("pathGlobFilter", "part-*").text(path)
    m = "_metadata."
    return text.select(F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("block"), F.col(m + "file_size").alias("total"), F.col("value").cast("binary").alias("value"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, total, at, data) of each piece; at: its offset from the split's first piece."""
    key, at = None, 0
    for batch in batches:
        file, block, total = (batch.column(k).to_pylist() for k in range(3))
        for k, value in enumerate(batch.column(3)):
            if (file[k], block[k]) != key:
                key, at = (file[k], block[k]), 0
            data = value.as_buffer().to_pybytes()
            yield (*key, total[k], at, data)
            at += len(data) + len(CUT)


PIECES = "file string, block long, total long, at long, after long, away long, stop long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over pieces -> PIECES, offsets from the split's first piece; the row at -1 holds the split's bytes in `stop`.

    after: the successor, -1 if the piece begins with no header; away: where the chain leaves the split, -1 if it
    breaks off; stop: where the piece ends.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def close(key, rows, size) -> pa.RecordBatch:
        # No piece begins in the last bytes of the split's size; in a file's last split the chain ends there.
        here, after, stop = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        cols = [np.append(here, -1), np.append(after, -1), np.append(exits(here, after, size - 1), -1), np.append(stop, size)]
        return pa.RecordBatch.from_arrays([pa.array([x] * (len(rows) + 1)) for x in key] + [pa.array(c) for c in cols], names)

    key, rows, size = None, [], 0
    for file, block, total, at, data in _walk(batches):
        if (file, block, total) != key:
            if key:
                yield close(key, rows, size)
            key, rows = (file, block, total), []
        found = header(data)
        rows.append((at, at + found[1] + found[2] + len(TAIL) + len(CUT) if found else -1, at + len(data)))
        size = at + len(data) + len(CUT)
    if key:
        yield close(key, rows, size)


def _odd(table: pa.Table) -> pa.Table:
    """The pieces of one split that are not a record each: magic that the chain passes over, and records that hold such."""
    order = np.argsort(table["at"].to_numpy())
    at, after, stop, entry, base, total = (table[c].to_numpy()[order] for c in ("at", "after", "stop", "entry", "base", "total"))
    own = reached(at, after, int(entry[0]))
    last = base + stop == total  # the file's last piece ends with the block's two line ends
    rows = np.flatnonzero(~own | (after - len(CUT) != stop - last))
    pick = table.select(["file", "block"]).take(pa.array(rows))
    return pick.append_column("at", pa.array(at[rows])).append_column("here", pa.array(base[rows] + at[rows])).append_column("own", pa.array(own[rows]))


def chains(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, here, owner): pieces of the files below path that are not a record each, with the place in the
    file of the record they belong to. A file whose chain of records does not end at its end fails the job."""
    pieces = stage(_pieces(spark, path).mapInArrow(_candidates, PIECES), "pieces")
    run = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.filter("at < 0").select("file", "block", "total", F.col("stop").alias("size"))
    sizes = stage(sizes.select("*", F.coalesce(F.sum("size").over(run), F.lit(0)).cast("long").alias("base")), "splits")
    lost = sizes.groupBy("file", "total").agg(F.sum("size").alias("size")).filter(f"size <> total + {len(CUT)}")
    if broken := lost.select("file").head(3):
        raise ValueError(f"bytes are missing between the splits of {[r.file for r in broken]}")
    found = pieces.filter("at >= 0").drop("total", "stop").join(sizes.drop("size"), ["file", "block"])
    found = found.select("file", "block", "total", (F.col("base") + F.col("at")).alias("here"), F.when(F.col("away") >= 0, F.col("base") + F.col("away")).alias("away"))
    # The nodes are the files' first pieces and those that some chain enters a split by.
    aims = found.filter("away is not null").select("file", F.col("away").alias("here")).distinct()
    nodes = stage(found.join(aims.unionByName(found.filter("here = 0").select("file", "here")).distinct(), ["file", "here"], "left_semi"), "nodes")
    jump = nodes.filter("away is not null").select("file", "here", F.col("away").alias("to"))
    jump = jump.join(nodes.select("file", F.col("here").alias("to")), ["file", "to"], "left_semi")
    mark = nodes.filter("here = 0").select("file", "here")
    while True:
        more = mark.join(jump, ["file", "here"]).select("file", F.col("to").alias("here"))
        mark = stage(mark.unionByName(more).distinct(), "marks")
        jump = stage(jump.join(jump.select("file", F.col("here").alias("to"), F.col("to").alias("_far")), ["file", "to"]).select("file", "here", F.col("_far").alias("to")), "jumps")
        if not jump.head(1):
            break
    ends = sizes.select("file", "total").distinct().join(nodes.join(mark, ["file", "here"], "left_semi").select("file", "away"), "file", "left")
    ends = ends.groupBy("file").agg(F.max(F.coalesce(F.col("away") == F.col("total") + len(CUT) - 1, F.lit(False))).alias("ok"))
    if broken := ends.filter("not ok").select("file").head(3):
        raise ValueError(f"the chain of records does not end at the end of {[r.file for r in broken]}")
    entry = nodes.join(mark, ["file", "here"], "left_semi").select("file", "block", F.col("here").alias("_e"))
    whole = pieces.filter("at >= 0").join(sizes.select("file", "block", "base"), ["file", "block"]).join(entry, ["file", "block"], "left")
    whole = whole.select("file", "block", "total", "at", "after", "stop", "base", F.coalesce(F.col("_e") - F.col("base"), F.lit(-1)).alias("entry"))
    odd = whole.groupBy("file", "block").applyInArrow(_odd, "file string, block long, at long, here long, own boolean")
    before = Window.partitionBy("file").orderBy("here").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stage(odd.select("file", "block", "at", "here", F.last(F.when(F.col("own"), F.col("here")), ignorenulls=True).over(before).alias("owner")), "odd")


def _number(uri: str) -> int | None:
    digits = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _record(data: bytes, with_payload: bool) -> tuple:
    """The OUT row of a whole record; its two line ends may follow."""
    f, begin, size = header(data)
    block = data[begin : begin + size]
    kind, digest = f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:")
    length = int(f.get("warc-payload-length", size))
    if len(block) != size or data[begin + size :] not in (TAIL, END) or kind == "response" and (size != length or hashlib.sha1(block).hexdigest() != (digest or hashlib.sha1(block).hexdigest())):
        raise ValueError(f"the payload of {f.get('warc-record-id')} is damaged")
    refers = _number(f["warc-refers-to"]) if "warc-refers-to" in f else None
    return _number(f.get("warc-record-id", "")), length, digest or hashlib.sha1(block).hexdigest(), kind, refers, f.get("warc-target-uri", ""), block if with_payload else None


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _tables(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    """Batches of rows, by number and by the bytes that size() tells of a row."""
    held, room = [], 4 << 20
    for row in rows:
        held.append(row)
        room -= size(row) + 200
        if room < 0 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, room = [], 4 << 20
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records below `path`: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload).

    Payloads of responses are checked against their digests; a revisit's block is empty, its length and
    digest are those of the full payload. A file whose chain of records breaks off fails the job. Files may be
    larger than a task: they are read by splits, which must not change between the two passes.
    """
    prepare(spark)
    odd = chains(spark, path)
    names = [x.split()[0] for x in OUT.split(", ")]

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tables((_record(d, with_payload) for *_, d in _walk(batches)), _TYPES, names, lambda r: len(r[6] or b""))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((file, block, at, d) for file, block, _, at, d in _walk(batches))
        yield from _tables(rows, [pa.string(), pa.int64(), pa.int64(), pa.binary()], ["file", "block", "at", "value"], lambda r: len(r[3]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tables((_record(x.as_buffer().to_pybytes(), with_payload) for b in batches for x in b.column(0)), _TYPES, names, lambda r: len(r[6] or b""))

    pieces = _pieces(spark, path)
    if not odd.head(1):  # every piece is a record
        return pieces.mapInArrow(direct, OUT)
    pieces = pieces.mapInArrow(placed, "file string, block long, at long, value binary").join(odd, ["file", "block", "at"], "left")
    parts = pieces.filter("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("here", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda x: x["value"].cast("string")), CUT.decode()).cast("binary").alias("value"))
    return pieces.filter("owner is null").select("value").unionByName(joined).mapInArrow(whole, OUT)


def digest(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and return a row a record."""
    spark = prepare(pages.sparkSession)
    path = write(pages, new_path(spark, "warc"))
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
