"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector; an n-gram's vector is the product of its letters' vectors,
each rotated by its place; a text's vector is the sum over its n-grams, a language's prototype the
sum over its texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces, prepare, text_bytes

DIM = 512
SYMBOLS = 4096  # letter vectors; code points share one modulo this
SPAN = 1 << 19  # bytes of text whose trigrams are counted at once
CELLS = 1 << 22  # counts held at once
CODES = 1 << 14  # trigrams whose vectors are held at once
_rng = np.random.default_rng(77)
_LETTERS = _rng.integers(0, 2, (SYMBOLS, DIM), dtype=np.int8) * np.int8(2) - np.int8(1)
_tables: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, else 1 + (lower-cased code point mod (SYMBOLS - 1))."""
    if not _tables:
        t = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = 1 + ord(low[0]) % (SYMBOLS - 1)
        _tables.append(t)
    return _tables[0]


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams a << 24 | b << 12 | c."""
    a, b, c = codes >> 24, (codes >> 12) & 4095, codes & 4095
    return (np.roll(_LETTERS, 2, 1)[a] * np.roll(_LETTERS, 1, 1)[b] * _LETTERS[c]).astype(np.float32)


def profiles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, codes, letters): how often each text has each trigram of letters and word ends; whether it has a letter.

    Bytes that are not UTF-8 are no letters."""
    owner, place, codes, letters = _trigrams(texts)
    return _dense(owner, place, len(texts), len(codes)), codes, letters


def _dense(owner: np.ndarray, place: np.ndarray, texts: int, n: int) -> np.ndarray:
    return np.bincount(owner * n + place, minlength=texts * n).reshape(texts, n).astype(np.float32)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, codes, letters): of each trigram in the texts its text and its place among the codes."""
    wide = [t.decode(errors="replace").encode("utf-32-le") for t in texts]
    sizes = np.array([len(w) // 4 + 2 for w in wide], np.int64)  # with a word end before and after
    end = bytes(4)
    sym = _symbol_table()[np.frombuffer(b"".join([end + w + end for w in wide]), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = (sym != 0) | np.concatenate(([True], sym[:-1] != 0)) | np.concatenate(([True], doc[1:] != doc[:-1]))
    sym, doc = sym[keep].astype(np.int64), doc[keep]
    letters = np.bincount(doc[sym != 0], minlength=len(texts)) > 0
    if len(sym) < 3:
        return *np.zeros((3, 0), np.int64), letters
    used = np.flatnonzero(np.bincount(sym, minlength=SYMBOLS))
    small = np.zeros(SYMBOLS, np.int64)
    small[used] = np.arange(len(used))
    s, k = small[sym], len(used)
    code = (s[:-2] * k + s[1:-1]) * k + s[2:]
    owner = doc[:-2]
    ok = (owner == doc[2:]) & (sym[1:-1] != 0)
    code, owner = code[ok], owner[ok]
    if k**3 <= 1 << 22:
        there = np.flatnonzero(np.bincount(code, minlength=k**3))
        rank = np.zeros(k**3, np.int32)
        rank[there] = np.arange(len(there))
        place = rank[code]
    else:
        there, place = np.unique(code, return_inverse=True)
    codes = used[there // (k * k)] << 24 | used[there // k % k] << 12 | used[there % k]
    return owner, place, codes, letters


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about SPAN bytes that end with white space, so that no trigram is cut; a longer word stays whole."""
    at = 0
    while len(text) - at > SPAN:
        end = min((x for x in (text.find(c, at + SPAN) for c in (b" ", b"\n")) if x >= 0), default=-1) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def bundles(texts: list[bytes], kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(v, letters): the summed vectors of the texts of each kind, and whether a text has a letter.

    Memory is bounded by SPAN bytes of text, CELLS counts and CODES trigram vectors at a time.
    """
    v, letters = np.zeros((kinds, DIM), np.float32), np.zeros(len(texts), bool)
    parts = [(i, x) for i, t in enumerate(texts) for x in _slices(t)]
    for lo, hi in pieces([x for _, x in parts], SPAN):
        of = np.array([i for i, _ in parts[lo:hi]])
        owner, place, codes, has = _trigrams([x for _, x in parts[lo:hi]])
        letters[of[has]] = True
        there, rows = np.unique(kind[of], return_inverse=True)
        owner = rows[owner]
        step = max(1, min(CODES, CELLS // max(len(there), 1)))
        if len(codes) > step:
            rank = np.argsort(place, kind="stable")
            owner, place = owner[rank], place[rank]
        for at in range(0, len(codes), step):
            a, b = np.searchsorted(place, (at, at + step)) if len(codes) > step else (0, len(place))
            n = min(step, len(codes) - at)
            v[there] += _dense(owner[a:b], place[a:b] - at, len(there), n) @ vectors_of(codes[at : at + n])
    return v, letters


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, text) -> one partial prototype (lang, v) for each language of the partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = text_bytes(batch), np.array(batch.column(0).to_pylist(), object)
        names = sorted(set(langs))
        kind = np.array([names.index(x) for x in langs], np.int64)
        for name, v in zip(names, bundles(texts, kind, len(names))[0].astype(np.float64), strict=True):
            total[name] = total.get(name, 0) + v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])


def learn(rows: DataFrame) -> dict[str, list[float]]:
    """Prototypes of the languages in `rows` (lang, text), from all of them; rows with a null are left out.

    Tasks bundle their rows, Spark sums the bundles; the driver gets one vector of DIM numbers a language.
    """
    prepare(rows.sparkSession)
    part = rows.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_bundle, "lang string, v array<double>")
    summed = part.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    out: dict[str, list[float]] = {}
    for r in summed.groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(pos, x))), p -> p.x)").alias("v")).collect():
        out[r.lang] = list(r.v)
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, list[float]]) -> DataFrame:
    """(doc_id, lang_pred, score): the nearest prototype of every whole text and the cosine, from 0 to 1.

    `und` and 0 for null texts, texts without a letter, or where nothing was learned; of equal
    cosines the first language by name wins. Rows with null or repeated ids stay as they are.
    """
    prepare(docs.sparkSession)
    names = sorted(prototypes)
    proto = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIM)
    size = np.linalg.norm(proto, axis=1)
    proto = (proto / np.where(size, size, 1)[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            if names:
                v, letters = bundles(texts, np.arange(len(texts)), len(texts))
                cos = v @ proto.T / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                top = cos.argmax(1)
                best = np.where(letters, top, -1)
                score = np.where(letters, np.clip(cos[np.arange(len(texts)), top], 0, 1), 0).astype(np.float64)
            pred = [names[b] if b >= 0 else "und" for b in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(col: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, mod 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from all rows outside the held-out fold, predict for all."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull())
    out = predict(docs, learn(rows.select("lang", "text")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
