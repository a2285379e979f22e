"""Repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts elsewhere in the corpus. Two equal
strings of that length hold the same minimiser (the least hash of a `GRAM`-byte string within), at the
same place; so occurrences of minimisers are the anchors at which strings can be compared:

1. anchors whose gram occurs once are done with (counts by partial aggregation);
2. anchors whose whole context, all bytes a string around them may reach, occurs again cover it;
3. of the others, one occurrence of each context is sorted: mergesort of the suffixes that begin at the
   anchor, and of the reversed prefixes that end there, where a comparison finds the common extension by
   binary search on prefix polynomial hashes; the neighbours' common extensions are verified byte by
   byte. They give, for each offset, classes of equal left and right parts, and a window repeats if its
   pair of classes does. Anchors with more contexts than a task holds are dealt first: windows with l to h
   bytes left of the anchor can only be equal if the last l bytes left and the first bytes right that all of
   them have are, so contexts meet within such a range by these bytes, and ranges are halved until groups fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_i64, pieces, prepare, stage, text_bytes

LENGTH = 200
GRAM = 50
CROWD = 20_000  # contexts that are sorted together; groups with more are dealt by the bytes their windows share
SPAN = 1 << 20
_rng = np.random.default_rng(424242)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SPAN + 4096)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PI, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Prefix polynomial hashes (modulo 2^64, random byte values) of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power(len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sum[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[begin]) * self.down[begin]


def _slide(a: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every w neighbours, in linear time."""
    m = len(a) - w + 1
    b = np.concatenate([a, np.full(-len(a) % w, a[-1], a.dtype)]).reshape(-1, w)
    before = f.accumulate(b, axis=1).ravel()
    after = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[:m], before[w - 1 : w - 1 + m])


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, context hashes) of the minimisers of all strings of `length` bytes."""
    n = len(text)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64)
    h = Hashes(np.frombuffer(text, np.uint8))
    p = np.arange(n - gram + 1)
    g = mix(h.of(p, p + gram))
    w = length - gram + 1
    low = _slide(g, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((edge, low, edge)), w, np.maximum) == g)
    begin, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    shape = (at - begin).astype(np.uint64) * np.uint64(length + 1) + (end - at).astype(np.uint64)
    return at, g[at], mix(h.of(begin, end) ^ mix(shape + np.uint64(1)))


def _anchor_rows(length: int, gram: int):
    """mapInArrow: (tid, text) -> (g, c, loc, tid, pos); loc stands for the place (tid, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, texts = batch.column(0).to_numpy(zero_copy_only=False), text_bytes(batch)
            for lo, hi in pieces(texts, SPAN):
                got = [anchors(t, length, gram) for t in texts[lo:hi]]
                tid = np.repeat(tids[lo:hi], [len(x[0]) for x in got])
                pos, g, c = (np.concatenate([x[k] for x in got]) for k in range(3))
                loc = mix(tid.view(np.uint64) ^ mix(pos.astype(np.uint64) + np.uint64(7)))
                yield pa.RecordBatch.from_arrays([pa.array(as_i64(g)), pa.array(as_i64(c)), pa.array(as_i64(loc)), pa.array(tid), pa.array(pos.astype(np.int32))], ["g", "c", "loc", "tid", "pos"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (a, tid, text) -> (a, tid, z): texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press(t) for t in text_bytes(batch)], pa.binary())], ["a", "tid", "z"])


def _contexts(length: int, gram: int):
    """mapInArrow: (z, places: array of (pos, g, loc)) -> (g, loc, tid, pos, left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        reach = length - gram
        for batch in batches:
            out: list[tuple] = []
            for tid, z, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = unpack(z) if len(z) else b""
                for x in places:
                    p = x["pos"]
                    out.append((x["g"], x["loc"], tid, p, text[max(p - reach, 0) : p], text[p + gram : p + length]))
            for lo in range(0, len(out), 20_000):
                cols = list(zip(*out[lo : lo + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["g", "loc", "tid", "pos", "left", "right"])

    return run


class Suffixes:
    """Strings in one buffer, sorted within their groups by mergesort with hash comparisons."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        self.buf = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.group = group
        self.hash = Hashes(self.buf)
        self.most = int(self.size.max(initial=0))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common prefix of strings i and j, by binary search on prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.begin[i], self.begin[j]
        for _ in range(self.most.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i comes before j: by group, then bytes; a prefix comes first."""
        e = self.extension(i, j)
        x, y = self.begin[i] + e, self.begin[j] + e
        top = max(len(self.buf) - 1, 0)
        end_i, end_j = e >= self.size[i], e >= self.size[j]
        byte = self.buf[np.minimum(x, top)] < self.buf[np.minimum(y, top)] if len(self.buf) else np.zeros(len(i), bool)
        inside = np.where(end_i | end_j, end_i & ~end_j, byte)
        return np.where(self.group[i] != self.group[j], self.group[i] < self.group[j], inside)

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort; all merges of a level are done at once by searching each side in the other."""
        n = len(self.size)
        order = np.argsort(self.group, kind="stable")
        width = 1
        while width < n:
            k = np.arange(n)
            block = k // (2 * width) * (2 * width)
            edge = np.minimum(block + width, n - 1)
            # Only the group that both runs hold has to be merged; all else is in place.
            g = self.group[order]
            k = k[(block + width < n) & (g[edge - 1] == g[edge]) & (g == g[edge])]
            if len(k):
                block, own = block[k], order[k]
                right = k - block >= width
                lo = np.where(right, block, np.minimum(block + width, n))
                hi = np.where(right, np.minimum(block + width, n), np.minimum(block + 2 * width, n))
                base = lo.copy()
                for _ in range(width.bit_length()):
                    open_ = lo < hi
                    mid = (lo + hi) >> 1
                    probe = order[np.minimum(mid, n - 1)]
                    # Of equal strings the left run's come first.
                    first, second = np.where(right, own, probe), np.where(right, probe, own)
                    go = (self.less(first, second) ^ right) & open_
                    lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
                merged = order.copy()
                merged[np.where(right, k - width, k) + (lo - base)] = own
                order = merged
            width *= 2
        return order

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): the sorted order and each string's verified extension with its predecessor, -1 across groups."""
        n = len(self.size)
        order = self.sort()
        if n < 2:
            return order, np.full(n, -1)
        i, j = order[:-1], order[1:]
        e = self.extension(i, j)
        e = self._verified(i, j, e)
        if e is None:  # a hash collision: sort by the bytes themselves
            raw = self.buf.tobytes()
            part = lambda x: raw[self.begin[x] : self.begin[x] + self.size[x]]
            order = np.array(sorted(range(n), key=lambda x: (self.group[x], part(x))))
            i, j = order[:-1], order[1:]
            e = np.array([_common(part(x), part(y)) for x, y in zip(i, j, strict=True)])
        return order, np.concatenate(([-1], np.where(self.group[i] == self.group[j], e, -1)))

    def _verified(self, i: np.ndarray, j: np.ndarray, e: np.ndarray) -> np.ndarray | None:
        """e where its bytes are equal and the order is right byte by byte; None if any is not."""
        step = np.arange(max(self.most, 1))
        top = max(len(self.buf) - 1, 0)
        for lo in range(0, len(i), 4096):
            a, b, c = i[lo : lo + 4096], j[lo : lo + 4096], e[lo : lo + 4096]
            if not len(self.buf):
                continue
            x = self.buf[np.minimum(self.begin[a][:, None] + step, top)]
            y = self.buf[np.minimum(self.begin[b][:, None] + step, top)]
            if ((x != y) & (step < c[:, None])).any():
                return None
        return e


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes], reach: int, low=0, high=None) -> tuple[np.ndarray, np.ndarray]:
    """For contexts around anchors, the least and the largest left part of a window that another context
    of the group also has (-1, -1: none). A window is l bytes left and reach - l bytes right of the anchor;
    low and high bound the l that are looked at, for each context or for all."""
    n = len(left)
    high = reach if high is None else high
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return least, most
    sides = []
    for s in ([x[::-1] for x in left], right):
        suf = Suffixes(s, group)
        order, common = suf.classes()
        sides.append((suf.size, order, common))
    (lsize, lorder, lcommon), (rsize, rorder, rcommon) = sides
    lclass, rclass = np.empty(n, np.int64), np.empty(n, np.int64)
    for part in range(reach + 1):
        ok = np.flatnonzero((lsize >= part) & (rsize >= reach - part) & (low <= part) & (part <= high))
        if len(ok) < 2:
            continue
        lclass[lorder] = np.cumsum(lcommon < part)
        rclass[rorder] = np.cumsum(rcommon < reach - part)
        key = lclass[ok] * (n + 1) + rclass[ok]
        rank = np.argsort(key, kind="stable")
        same = key[rank][1:] == key[rank][:-1]
        hit = ok[rank[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[hit] = np.where(least[hit] < 0, part, least[hit])
        most[hit] = part
    return least, most


def _sorted_groups(length: int, gram: int, crowd: int):
    """mapInArrow over partitions sorted by g and loc: (g, loc, tid, pos, left, right, l, h) -> intervals
    (tid, start, stop) of repeated windows. A place that comes twice counts once."""
    reach = length - gram

    def close(rows: list[tuple]) -> pa.RecordBatch:
        group, tid, pos, low, high = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 6, 7))
        least, most = repeated_windows(group, [r[4] for r in rows], [r[5] for r in rows], reach, low, high)
        hit = least >= 0
        tid, pos, least, most = tid[hit], pos[hit], least[hit], most[hit]
        return pa.RecordBatch.from_arrays([pa.array(tid), pa.array((pos - most).astype(np.int32)), pa.array((pos - least + length).astype(np.int32))], ["tid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue
                if len(held) >= crowd and row[0] != held[-1][0]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    return run


def _dealt(crowded: DataFrame, reach: int, crowd: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Contexts (g, loc, tid, pos, left, right, l, h) of groups with more than `crowd` of them, dealt to groups that fit.

    Returns tables of groups of 2 to `crowd` contexts, and the (tid, start) of windows in groups that do not get
    smaller: there l = h, so that all have the same window; it is compared as a whole by Spark's aggregation.
    """
    fit, same = [], None
    part = crowded
    while True:
        half = F.explode(F.expr("filter(array(struct(l, (l + h) div 2 as h), struct((l + h) div 2 + 1 as l, h)), x -> x.l <= x.h)"))
        part = part.select("g", "loc", "tid", "pos", "left", "right", half.alias("x"))
        part = part.select("g", "loc", "tid", "pos", "left", "right", F.col("x.l").cast("int").alias("l"), F.col("x.h").cast("int").alias("h"))
        part = part.filter(f"octet_length(`left`) >= l and octet_length(`right`) >= {reach} - h")
        shared = F.expr(f"xxhash64(g, l, h, substring(`left`, -l, l), substring(`right`, 1, {reach} - h))")
        part = stage(part.withColumn("g", shared), "dealt")
        size = stage(part.groupBy("g").agg(F.count("*").alias("m"), F.first(F.col("l") == F.col("h")).alias("single")).filter("m > 1"), "sizes")
        fit.append(part.join(size.filter(F.col("m") <= crowd).select("g"), "g", "left_semi"))
        alike = part.join(size.filter((F.col("m") > crowd) & F.col("single")).select("g"), "g", "left_semi")
        alike = alike.select("loc", "tid", (F.col("pos") - F.col("l")).alias("start"), "g", F.expr(f"concat(substring(`left`, -l, l), substring(`right`, 1, {reach} - l))").alias("w"))
        twice = alike.groupBy("g", "w").agg(F.min("loc").alias("lo"), F.max("loc").alias("hi")).filter("lo <> hi").select("g", "w")
        alike = alike.join(twice, ["g", "w"], "left_semi").select("tid", "start")
        same = alike if same is None else same.unionByName(alike)
        more = size.filter((F.col("m") > crowd) & ~F.col("single")).select("g")
        if not more.take(1):
            return fit, same
        part = part.join(more, "g", "left_semi")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, z, whole, spans) -> the kept bytes and what was removed."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows: list[tuple] = []
        for doc, z, whole, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = unpack(z) if len(z) else b""
            runs: list[list[int]] = [[0, len(text)]] if whole else []
            for x in sorted((s["start"], s["stop"]) for s in spans or () if not whole):
                if runs and x[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], x[1])
                else:
                    runs.append(list(x))
            at, kept = 0, []
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((doc, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        for lo in range(0, len(rows), 64):
            cols = list(zip(*rows[lo : lo + 64], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _told(text: str = "text") -> Column:
    """64 bits of a text, of which most texts are told."""
    return F.xxhash64(text, F.octet_length(text))


def _named(src: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(src with tid, a name of its own for every text; the names of the texts that several rows have: (tid, rep, whole)).

    A name has 64 bits. Where a second hash tells that two texts share one, which some pairs of ten thousand million do, the second gives
    their names.
    """
    long_ = src.filter(F.octet_length("text") >= length)

    def found(tid: Column) -> DataFrame:
        own = long_.select(tid.alias("tid"), F.xxhash64(F.lit(7), "text").alias("two"), "doc_id").groupBy("tid")
        own = own.agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.min("two").alias("lo"), F.max("two").alias("hi"))
        return stage(own.filter("n > 1").select("tid", "rep", F.lit(True).alias("whole"), (F.col("lo") != F.col("hi")).alias("shared")), "copies")

    tid = _told()
    copies = found(tid)
    if shared := [r.tid for r in copies.filter("shared").select("tid").collect()]:
        tid = F.when(tid.isin(shared), F.xxhash64("text", F.lit(7))).otherwise(tid)
        copies = found(tid)
        if copies.filter("shared").limit(1).count():
            raise RuntimeError("texts share their names")
    return src.select("doc_id", tid.alias("tid"), "text"), copies.drop("shared")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Documents without the bytes that a repeated string of `length` bytes covers.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept holds the bytes
    that stay, which may cut a character. Null texts count as empty; texts shorter than `length` stay
    whole. A text that several rows have (also rows with equal or null ids) repeats itself wholly.
    Other columns are ignored; an empty table gives an empty result. `crowd` bounds what a task sorts, not
    what is compared: larger groups are dealt. Texts are told by 128 bits of hashes, places by 64, contexts that
    repeat as a whole by two hashes; all other windows are compared byte by byte.
    """
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    src, copies = _named(src, length)
    long_ = src.filter(F.octet_length("text") >= length)
    place = long_.select("tid", "text").mapInArrow(_anchor_rows(length, gram), "g long, c long, loc long, tid long, pos int")
    twice = place.groupBy("g").agg(F.min("loc").alias("lo"), F.max("loc").alias("hi")).filter("lo <> hi").select("g")
    twice = stage(twice, "grams", release=True)
    place = stage(place.join(twice, "g"), "places", release=True)
    # Contexts: how often each occurs (n = 2: more than once), and how many a gram has.
    ctx = place.groupBy("g", "c").agg(F.min(F.struct("loc", "tid", "pos")).alias("x"), F.max("loc").alias("hi"))
    ctx = stage(ctx.select("g", "c", "x.*", (F.col("hi") != F.col("x.loc")).alias("again")), "contexts", release=True)
    full = ctx.filter("again").select("g", "c")
    covered = place.join(full, ["g", "c"], "left_semi").select("tid", "pos").distinct()
    crowds = ctx.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    wanted = ctx.join(crowds, "g").select("tid", F.struct("pos", "g", "loc", "m").alias("p"))
    wanted = wanted.groupBy("tid").agg(F.collect_list("p").alias("places"))
    wanted = wanted.join(copies.select("tid", "rep"), "tid", "left")
    texts = src.select(F.col("doc_id").alias("a"), "tid", "text").mapInArrow(_packed, "a long, tid long, z binary")
    # Of a text's copies that with the smallest id gives the contexts (all of them if none has an id).
    first = texts.join(wanted, "tid").filter("rep is null or a <=> rep").select("tid", "z", "places")
    near = first.mapInArrow(_contexts(length, gram), "g long, loc long, tid long, pos int, left binary, right binary")
    near = stage(near, "near", release=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = length - gram
    near = near.select("g", "loc", "tid", "pos", "left", "right", F.lit(0).alias("l"), F.lit(reach).alias("h"))
    large = stage(crowds.filter(F.col("m") > crowd).select("g"), "crowds")
    groups, spans = near, None
    if large.take(1):
        fit, same = _dealt(near.join(large, "g", "left_semi").dropDuplicates(["g", "loc"]), reach, crowd)
        groups = near.join(large, "g", "left_anti")
        for part in fit:
            groups = groups.unionByName(part)
        spans = same.select("tid", "start", (F.col("start") + length).alias("stop")).distinct()
    groups = groups.repartition(n, "g").sortWithinPartitions("g", "loc")
    found = groups.mapInArrow(_sorted_groups(length, gram, crowd), "tid long, start int, stop int")
    found = found if spans is None else found.unionByName(spans)
    covered = covered.select("tid", F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("start"), (F.col("pos") + length).alias("stop"))
    spans = found.unionByName(covered).groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = stage(spans.join(copies.drop("rep"), "tid", "full"), "intervals", release=True)
    out = texts.join(spans, "tid", "left").select(F.col("a").alias("doc_id"), "z", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
