"""Byte-level BPE by tree reduction: halves are encoded on their own, neighbours joined at the seam.

A token list is the BPE encoding of its bytes exactly if every two neighbouring tokens are the
encoding of their joined bytes. Two encoded halves are therefore joined by encoding a window of
tokens around the seam anew and growing it until both pairs at its ends have that property: the
tokens outside can then not change. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, text_bytes, trim

LEAF = 12  # bytes that are encoded at once
IDS_LEAF = 512  # ids that are decoded at once
LOSSLESS = "surrogateescape"  # bytes that are not UTF-8 stay as they are
CACHE = 250_000  # distinct matches whose ids a worker remembers; then it starts anew
CACHE_BYTES = 48  # longer matches are not remembered
NONE = 1 << 32  # above all ranks


class Bpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        size = max(self.rank.values(), default=-1) + 1
        self.token = [b""] * size
        for t, r in self.rank.items():
            self.token[r] = t
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.two = [[self.rank.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def direct(self, piece: bytes) -> list[int]:
        """Merge the neighbouring pair of lowest rank, leftmost first, until none is a token."""
        rank = self.rank
        if len(piece) <= 1 or piece in rank:
            return [rank[piece]] if piece else []
        if len(piece) > 48:
            return self._heap(piece)
        at = list(range(len(piece) + 1))  # where parts begin
        two = self.two
        pairs = [two[a][b] for a, b in pairwise(piece)]  # the rank of each part joined with the next
        while pairs and (best := min(pairs)) < NONE:
            i = pairs.index(best)
            del at[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank.get(piece[at[i - 1] : at[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = rank.get(piece[at[i] : at[i + 2]], NONE)
        return [rank[piece[i:j]] for i, j in pairwise(at)]

    def _heap(self, piece: bytes) -> list[int]:
        """The same for long pieces, with a heap of candidate pairs over a linked list."""
        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at i; 0 if none does
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := rank.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := rank.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self.direct(self.token[a] + self.token[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            mid = self.direct(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            ok_left = i == len(left) or self.stable(left[-i - 1], mid[0])
            ok_right = j == len(right) or self.stable(mid[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF or piece in self.rank:
            return self.direct(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode(errors=LOSSLESS)
        ids = self.tree(raw)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHE_BYTES:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        known, make = self.known.get, self._piece
        return b"".join([known(p) or make(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        return self._decode(np.frombuffer(packed, "<u4"))

    def _decode(self, ids: np.ndarray) -> bytes:
        """The halves' bytes, concatenated up the tree; a leaf's are gathered from the table of all tokens."""
        if len(ids) > IDS_LEAF:
            half = len(ids) // 2
            return self._decode(ids[:half]) + self._decode(ids[half:])
        if not len(ids):
            return b""
        size = self.length[ids]
        done = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - (done - size), size) + np.arange(done[-1])].tobytes()


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One instance a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _mapped(df: DataFrame, source: str, names: tuple[str, ...], make) -> DataFrame:
    """df with binary columns that make() computes from a column's bytes, batch by batch; columns of those names are replaced."""
    df = df.drop(*[n for n in names if n in df.columns and n != source])
    schema = df.select("*", *[F.lit(None).cast("binary").alias(n) for n in names]).schema
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(text_bytes(batch, batch.schema.names[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, pa.binary()) for m in made]], schema.names)
        trim()

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with `ids`: the packed ids (binary, 4 bytes each, little endian) of every whole text.

    Each match of `pattern` is encoded separately; special tokens are ordinary text. Null and empty
    texts give empty ids; bytes that are not UTF-8 are matched as characters of no class and encoded as they are; an existing column `ids_col` is replaced. `ids_array` unpacks them.
    """
    prepare(docs.sparkSession)

    def make(texts: list[bytes]) -> list[list[bytes]]:
        bpe = load(path, pattern)
        return [[bpe.encode(t.decode(errors=LOSSLESS)) for t in texts]]

    return _mapped(docs, text_col, (ids_col,), make)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with `decoded`: the bytes (binary) of the packed ids; null ids give no bytes."""
    prepare(df.sparkSession)

    def make(ids: list[bytes]) -> list[list[bytes]]:
        bpe = load(path, pattern)
        return [[bpe.decode(x) for x in ids]]

    return _mapped(df, ids_col, (out_col,), make)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids` and `decoded` as encode() and then decode() give them, by one worker instead of two."""
    prepare(docs.sparkSession)

    def make(texts: list[bytes]) -> list[list[bytes]]:
        bpe = load(path, pattern)
        ids = [bpe.encode(t.decode(errors=LOSSLESS)) for t in texts]
        return [ids, [bpe.decode(x) for x in ids]]

    return _mapped(docs, text_col, ("ids", "decoded"), make)


def ids_array(ids_col: str = "ids"):
    """A column expression: the packed ids as array<int>."""
    eight = f"regexp_extract_all(hex({ids_col}), '.{{8}}', 0)"
    part = "concat(" + ", ".join(f"substring(h, {k}, 2)" for k in (7, 5, 3, 1)) + ")"
    return F.expr(f"transform({eight}, h -> cast(conv({part}, 16, 10) as int))")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, through round_trip()."""
    both = round_trip(docs.select("doc_id", "text"), path, pattern)
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
