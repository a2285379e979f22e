"""Near-duplicates by MinHash with tensored banding; candidates are confirmed on full shingle sets.

Two small collections of `m` band values each (2 hashes a band) are computed; a table key joins one
band of the first with one of the second, so m * m tables of 4 hashes cost 4 * m hashes, about the
square root of the plain cost, and keys are made only of band values that two documents share. Documents that share a key are candidates. An exact filter then drops
candidates too many of whose shingles occur in no other candidate; the rest meet in groups that are
confirmed on full sets in bounded blocks, so no link between candidates is lost, whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_i64, components, drop, list_array, pieces, prepare, sieve, stage, text_bytes, trim

WIDTH = 5
BANDS = 8
SPAN = 1 << 20  # bytes of text handled at once by a task

_rng = np.random.default_rng(20240601)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _odd(256)
_BYTE[_SPACE] = 0
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLOT = _odd(WIDTH)
_HASH_MUL = _odd(4 * 64)
_HASH_XOR = _odd(4 * 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SPAN + (1 << 18))
        up, down = np.full(size, _P, np.uint64), np.full(size, _PI, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, concatenated and sorted per text, and len(texts) + 1 offsets.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D; texts of one to four
    words have one shingle, their whole sequence; texts without words have none.
    """
    buf = b"\n".join(t.lower() for t in texts) + b"\n"
    arr = np.frombuffer(buf, np.uint8)
    up, down = _power(len(arr))
    space = _SPACE[arr]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, edges)
    if len(starts):
        ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        word = np.add.reduceat(_BYTE[arr] * up[: len(arr)], starts) * down[starts]
        word = mix(word + (ends - starts).astype(np.uint64) * _SLOT[0])
    else:
        word = np.zeros(0, np.uint64)
    n = len(word)
    if n >= WIDTH:
        m = n - WIDTH + 1
        full = word[:m] * _SLOT[0]
        for k in range(1, WIDTH):
            full += word[k : m + k] * _SLOT[k]
        full = mix(full)
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= WIDTH:
            s = np.sort(full[lo : hi - WIDTH + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            s = mix((word[lo:hi] * _SLOT[: hi - lo]).sum(keepdims=True) + np.uint64(int(hi - lo)))
        else:
            continue
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _fingerprint(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each (non-empty) set: two mixed sums of different mixes of its members, and its size."""
    size = np.diff(at).astype(np.uint64)
    one = np.add.reduceat(mix(s ^ _SLOT[1]), at[:-1])
    two = np.add.reduceat(mix(s * _SLOT[2]), at[:-1])
    return mix(mix(one) + size), mix(two * _SLOT[3] + size)


def _nonempty(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    has = np.flatnonzero(np.diff(at))
    return has, np.concatenate((at[has], [len(s)]))


def signatures(bands: int):
    """mapInArrow: (doc_id, text, t1, t2) -> (doc_id, n, f1, f2, bands, t1, t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            ids, t1, t2 = (batch.column(k) for k in (0, 2, 3))
            for lo, hi in pieces(texts, SPAN):
                s, at = shingle_sets(texts[lo:hi])
                has, sub = _nonempty(s, at)
                f1, f2 = np.zeros((2, hi - lo), np.uint64)
                both = np.zeros((hi - lo, 2 * bands), np.uint64)
                if len(has):
                    f1[has], f2[has] = _fingerprint(s, sub)
                    for j in range(2 * bands):
                        for h in (2 * j, 2 * j + 1):
                            low = np.minimum.reduceat(mix_light(s, h), sub[:-1])
                            both[has, j] = both[has, j] * _SLOT[4] + low
                flat = np.arange(0, (hi - lo) * 2 * bands + 1, 2 * bands)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(as_i64(f1)), pa.array(as_i64(f2)), list_array(as_i64(both.ravel()), flat, pa.int64()), t1.slice(lo, hi - lo), t2.slice(lo, hi - lo)],
                    ["doc_id", "n", "f1", "f2", "bands", "t1", "t2"],
                )
        trim()

    return run


def mix_light(s: np.ndarray, h: int) -> np.ndarray:
    """One hash function of the family, over shingle hashes that are already mixed."""
    v = (s ^ _HASH_XOR[h]) * _HASH_MUL[h]
    return (v ^ (v >> np.uint64(29))) * _HASH_MUL[(h + 97) % 256]


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (text, fp, f1, f2) -> (fp, sh), of the rows whose set has that name."""
    for batch in batches:
        texts = text_bytes(batch)
        fp, f1, f2 = (batch.column(k).to_numpy() for k in (1, 2, 3))
        for lo, hi in pieces(texts, SPAN):
            s, at = shingle_sets(texts[lo:hi])
            has, sub = _nonempty(s, at)
            if len(has):
                one, two = (as_i64(f) for f in _fingerprint(s, sub))
                own = np.flatnonzero((one == f1[lo + has]) & (two == f2[lo + has]))
                sets = list_array(as_i64(s), sub, pa.int64()).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(fp[lo + has][own]), sets], ["fp", "sh"])
    trim()


class Forest:
    """Union-find over positions; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def confirm(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between rows of one block.

    side: rows of chunk 0 meet all rows, rows of chunk 1 only those of chunk 0 (0 and 1 alike when
    both are the same chunk). Overlaps are counted over an inverted index of the block's shingles.
    """
    n = len(node)
    forest = Forest(n)
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(node[0]), int(node[1]))] if 100 * inter >= percent * (len(sets[0]) + len(sets[1]) - inter) else []
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(new) - 1
    holders = owner[order]
    begin = np.append(np.flatnonzero(new), len(flat))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(side == 0):
        t = token[at[i] : at[i + 1]]
        t = t[np.argsort(begin[t + 1] - begin[t], kind="stable")]  # rare shingles first
        # Two sets that are similar enough share one of the first (1 - percent/100) * size + 1.
        head = t[: len(t) - (percent * len(t) + 99) // 100 + 1]
        near = np.unique(np.concatenate([holders[begin[x] : begin[x + 1]] for x in head]))
        near = near[(near > i) | ((near < i) & (side[near] == 1))]
        near = near[(100 * sizes[near] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[near])]
        for j in near:
            if forest.root(int(i)) != forest.root(int(j)):
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= percent * (sizes[i] + sizes[j] - inter):
                    forest.join(int(i), int(j))
    return [(int(node[r]), int(node[i])) for i in range(n) if (r := forest.root(i)) != i]


def confirm_blocks(percent: int):
    """mapInArrow over partitions sorted by block: (g, ci, cj, c, fp, sh) -> confirmed links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                node = np.array([h[1] for h in held])
                side = np.array([0 if h[0] == key[1] else 1 for h in held])
                links.extend(confirm(node, side, [h[2] for h in held], percent))

        for batch in batches:
            g, ci, cj, c, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            sh = batch.column(5)
            flat, at = sh.values.to_numpy(zero_copy_only=False), sh.offsets.to_numpy()
            for i in range(len(g)):
                k = (g[i], ci[i], cj[i])
                if k != key:
                    close()
                    held, key = [], k
                held.append((c[i], fp[i], flat[at[i] : at[i + 1]].view(np.uint64).copy()))
            if len(links) > 4096:
                yield _links(links)
                links = []
        close()
        yield _links(links)
        held.clear()
        trim()

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of percent / 100 or more over 5-word shingles.

    Returns (doc_id, n_shingles, component_id, kept) for every row. Null and wordless texts have no
    shingles and stand alone; rows with a null id are compared with nothing: component_id is null and
    kept is true. Repeated rows share a class; other columns of `docs` are ignored. An empty table
    gives an empty result. `bands` sets the recall: a pair at 0.85 shares a key with probability
    0.9999 (8 bands, 64 tables). No cap on the members of a key or group.
    """
    return _classes(docs, percent, bands, block, id_col, text_col).drop("t1", "t2")


def _named(text_col: str) -> list[Column]:
    """128 bits of a row's text, null or not."""
    return [F.xxhash64(text_col).alias("t1"), F.xxhash64(text_col, F.lit(7)).alias("t2")]


def _classes(docs: DataFrame, percent: int, bands: int, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates() with t1, t2, the name of the row's text."""
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = stage(src.select("*", *_named("text")).mapInArrow(signatures(bands), "doc_id long, n long, f1 long, f2 long, bands array<long>, t1 long, t2 long"), "sig")
    # Equal sets (128 bits of hashes) are one node; numbers are given once, where the table is written.
    reps = sig.filter("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("x"))
    reps = stage(reps.select(F.monotonically_increasing_id().alias("fp"), "f1", "f2", "x.*"), "reps")
    # A key joins two band values, so that only values of two nodes or more can be part of a key of two.
    vals = reps.select("fp", F.posexplode("bands").alias("j", "v")).select("fp", F.expr("shiftleft(xxhash64(j, v), 8) | j").alias("v"))
    common = vals.groupBy("v").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("v")
    some = stage(vals.join(common, "v").groupBy("fp").agg(F.collect_list("v").alias("vs")), "values", release=True)  # 2 * bands a node at most
    keys = some.select("fp", "vs", F.explode(F.expr(f"filter(vs, v -> (v & 255) < {bands})")).alias("one"))
    keys = keys.select("fp", F.explode(F.expr(f"transform(filter(vs, v -> (v & 255) >= {bands}), two -> xxhash64(one, two))")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("key")
    met = stage(keys.join(shared, "key"), "met", release=True)
    drop(some)
    cand = stage(met.select("fp").distinct().join(reps.select("fp", "f1", "f2", "doc_id", "n"), "fp"), "cand", release=True)
    # Texts of other documents stay where they are; what the filter lets pass meets the candidates by id and name.
    texts = sieve(src, cand, "doc_id", "may").filter("may").drop("may").join(cand.select("doc_id", "fp", "f1", "f2"), "doc_id")
    sets = stage(texts.select("text", "fp", "f1", "f2").mapInArrow(sets_of, "fp long, sh array<long>"), "sets", release=True)
    # Shingles that one candidate alone has can be in no overlap; half of the hash is enough to prove it.
    lone = sets.select("fp", F.explode("sh").alias("s")).groupBy(F.expr("cast(s & 4294967295 as bigint)").alias("s")).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    lone = lone.filter("lo = hi").groupBy(F.col("lo").alias("fp")).agg(F.count("*").alias("lone"))
    alive = stage(cand.join(lone, "fp", "left").filter(f"100 * (n - coalesce(lone, 0)) >= {percent} * n").select("fp"), "alive", release=True)
    left = met.join(alive, "fp", "left_semi")
    hubs = left.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("key", "a")
    groups = components(left.join(hubs, "key").select("a", F.col("fp").alias("b")))
    sized = groups.groupBy("comp").agg(F.count("*").alias("size"))
    placed = groups.join(sized, "comp").select(
        F.col("comp").alias("g"), F.col("node").alias("fp"), F.expr(f"cast(ceil(size / {block}D) as int)").alias("k")
    )
    placed = placed.withColumn("c", F.expr("cast(pmod(xxhash64(fp), k) as int)"))
    blocks = placed.select("g", "fp", "c", F.explode(F.expr("sequence(0, k - 1)")).alias("o"))
    blocks = blocks.select("fp", "g", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"), "c")
    blocks = blocks.join(sets, "fp").select("g", "ci", "cj", "c", "fp", "sh")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = blocks.repartition(n, "g", "ci", "cj").sortWithinPartitions("g", "ci", "cj").mapInArrow(confirm_blocks(percent), "a long, b long")
    comp = components(stage(links, "confirmed", release=True)).select(F.col("node").alias("fp"), "comp")
    for done in (met, sets, alive):
        drop(done)
    # Classes are named over nodes, so that the rows meet one small table and a hot class only its own nodes.
    named = stage(reps.select("fp", "f1", "f2", "doc_id").join(comp, "fp"), "linked")
    first = named.groupBy("comp").agg(F.min("doc_id").alias("first"))
    named = stage(named.join(first, "comp").select("f1", "f2", "first"), "classes")
    low = reps.select("f1", "f2", "doc_id").join(named, ["f1", "f2"], "left")
    low = stage(low.select("f1", "f2", F.coalesce("first", "doc_id").alias("component_id")), "named")
    rows = sig.filter("n > 0 and doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2", "t1", "t2")
    linked = rows.join(low, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id", "t1", "t2")
    alone = sig.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "t1", "t2")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80, bands: int = 9) -> DataFrame:
    """The documents without near copies of others: of each class the row(s) with the smallest doc_id stay.

    Rows are told by id and text, so that of rows with one id only those go whose own text is a near copy. Rows
    without an id or without words stay.
    """
    gone = _classes(docs, percent, bands).filter("not kept").select(F.col("doc_id").alias("id"), "t1", "t2").distinct()
    t1, t2 = _named("text")
    same = (docs["doc_id"].cast("long") == gone["id"]) & (t1 == gone["t1"]) & (t2 == gone["t2"])
    return docs.join(gone, same, "left_anti")
