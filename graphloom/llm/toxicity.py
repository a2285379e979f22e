"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its embedding (words the training sample knows) and the mean embedding of its
characters' 3- to 5-grams. Two gated recurrences read the words from either side, attention pools the
states of every window of words, and a logistic unit scores it. A word's state is what the recurrences make of
the `REACH` words before it and itself, and of those after it and itself, in training and in scoring, wherever in
a text the word stands; all words are read in step. So all windows share the states of their words: a window's
softmax over its words is a difference of running sums. A window starts
at every word; a text's score is the calibrated score of its worst window. Training follows from labels of
whole texts: of a toxic text the worst window stands for it, of a clean one its worst windows do, first
by word odds, then by the network itself.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces, prepare, text_bytes, trim

WINDOW = 32  # words; a window starts at every word
REACH = 4  # words before a word, and after it, that its state depends on
CHUNK = 2048  # words whose states are computed at once
SHUT = 60.0  # a gate input that keeps a state exactly as it is
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 12, 8, 8, 8
WORDS, BUCKETS = 8192, 1 << 16  # known words; buckets of character n-grams (16 bits)
GRAMS, HEADS = (3, 4, 5), (6, 7, 8)  # bytes of character n-grams, and of beginnings of words
#: The bounded sample of labelled rows that the network is fitted on: rows of each label, bytes of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 3000, 5000, 8192
SHRINK = 10  # texts without evidence that count with those of a bucket
THRESHOLD = 0.3
SPAN = 1 << 19
PART = 20_000  # words handled at once while fitting
MEMORY = 80_000  # words whose inputs a worker remembers
_TABLE = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squash(x: np.ndarray, by: float) -> None:
    """1 / (1 + exp(by * x)), in place; exp is the fastest of numpy's functions here."""
    x *= by
    with np.errstate(over="ignore"):  # of an infinite one becomes 0
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of the character n-grams and the beginnings of every word with its ends marked."""
    buf = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    at = np.concatenate(([0], np.cumsum(size)))
    left = np.repeat(at[1:], size) - np.arange(at[-1])  # bytes to the word's end
    found, owner = [], []
    base = np.repeat(np.arange(len(words)), size)
    for n in (*GRAMS, *HEADS):
        # n-grams start anywhere, heads where the word does
        begin = np.arange(max(len(buf) - n + 1, 0)) if n in GRAMS else at[:-1]
        begin = begin[left[begin] >= n]
        h = np.full(len(begin), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + buf[begin + k] * np.uint64(0x9E3779B97F4A7C15)
        found.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(BUCKETS))
        owner.append(base[begin])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def window_starts(sizes: np.ndarray) -> np.ndarray:
    """Which words of texts of these sizes, one after another, start a window: all up to the last whole one, or the first."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    return place <= np.repeat(np.maximum(sizes - WINDOW, 0), sizes)


def lines(begin: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, mask) of `width` words from each `begin` with REACH words before and after; only places in [low, high) count."""
    at = begin[:, None] + np.arange(-REACH, width + REACH)
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, at, low[:, None]), inside


class Net:
    """The network's parameters, its forward pass and gradients."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, k=None: (r.normal(size=s) * (k or s[0] ** -0.5)).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": f(WORDS + 1, WORD_DIM, k=0.3), "char": f(BUCKETS, CHAR_DIM, k=0.6), "att": f(2 * h, ATTEND), "att_b": np.zeros(ATTEND, np.float32),
                  "att_v": f(ATTEND), "out": f(2 * h), "out_b": np.full(1, -1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * h), f"u{side}": f(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.vocab: dict[bytes, int] = {}
        self.scale = (1.0, 0.0)  # calibration of the worst window's logit
        self.constant: float | None = None  # a score for all, where there is nothing to learn

    def chars(self, words: list[bytes]) -> np.ndarray:
        b, at = gram_buckets(words)
        return np.add.reduceat(self.p["char"][b], at[:-1]) / np.diff(at)[:, None]

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """What enters for each word: its embedding and that of its characters."""
        known = np.array([self.vocab.get(w, 0) for w in words])
        return np.concatenate((self.p["word"][known], self.chars(words)), 1, dtype=np.float32)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The gates' inputs of both directions for each word."""
        return self.gates(self.vectors(words))

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]), 1).astype(np.float32)

    def read(self, gates: np.ndarray, side: str, n: int = 1, keep: list | None = None) -> np.ndarray:
        """The states of the places in the middle, from the side "f" or "b": gates (3 * HIDDEN, (width + 2 * REACH) * n) -> (HIDDEN, width * n).

        Places follow one another, with n lines at each. Places outside a text have gates of SHUT and change no state. keep: gets
        what the gradient needs.
        """
        h, u = HIDDEN, np.ascontiguousarray(self.p[f"u{side}"].T)
        size = gates.shape[1] - 2 * REACH * n
        s = np.zeros((h, size), gates.dtype)
        hu, zr, c = np.zeros((3 * h, size), gates.dtype), np.empty((2 * h, size), gates.dtype), np.empty((h, size), gates.dtype)
        np.clip(gates, -SHUT, SHUT, out=gates)
        for t in range(REACH + 1):
            at = (t if side == "f" else 2 * REACH - t) * n
            x = gates[:, at : at + size]
            if t:  # the first word meets no state
                np.matmul(u, s, out=hu)
            np.add(x[: 2 * h], hu[: 2 * h], out=zr)
            squash(zr, -1)
            z, r = zr[:h], zr[h:]
            np.multiply(r, hu[2 * h :], out=c)
            c += x[2 * h :]
            squash(c, -2)  # tanh is a stretched sigmoid
            c *= 2
            c -= 1
            if keep is not None:
                keep.append((at, s.copy(), z.copy(), r.copy(), c.copy(), hu[2 * h :].copy()))
            c -= s
            np.subtract(1, z, out=z)
            c *= z
            s += c
        return s

    def attend(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        return a, a @ self.p["att_v"]

    def loss(self, known, chars, mask, y) -> tuple[float, dict, np.ndarray]:
        """Mean cross entropy of windows with the words around them, gradients of the dense parameters, and of the inputs."""
        p, h, n = self.p, HIDDEN, len(y)
        x = np.concatenate((p["word"][known], chars), 2)
        shut = ~mask.astype(bool)
        g, keep, sides = [], [[], []], []
        for k, side in enumerate("fb"):
            own = x @ p[f"x{side}"] + p[f"b{side}"]
            own[shut] = SHUT
            g.append(np.ascontiguousarray(own.transpose(2, 1, 0)).reshape(3 * h, -1))
            sides.append(self.read(g[k], side, n, keep[k]).reshape(h, -1, n).transpose(2, 1, 0))
        states = np.concatenate(sides, 2)
        inside = mask[:, REACH:-REACH]
        a, e = self.attend(states)
        e = np.exp(e - e.max(1, keepdims=True)) * inside
        w = e / e.sum(1, keepdims=True)
        pooled = (w[:, :, None] * states).sum(1)
        q = sigmoid(pooled @ p["out"] + p["out_b"][0])
        loss = -np.mean(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))
        d = {}
        dl = ((q - y) / n).astype(np.float32)
        d["out"], d["out_b"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * p["out"]
        ds = w[:, :, None] * dp[:, None]
        dw = (states * dp[:, None]).sum(2)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        d["att_v"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        d["att"], d["att_b"] = np.einsum("ntd,nta->da", states, da), da.sum((0, 1))
        ds += da @ p["att"].T
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, dg, du = p[f"u{side}"], np.zeros_like(g[k]), np.zeros_like(p[f"u{side}"])
            carry = ds[:, :, k * h : (k + 1) * h].transpose(2, 1, 0).reshape(h, -1)
            for at, s, z, r, c, hc in reversed(keep[k]):
                dc = carry * (1 - z) * (1 - c * c)
                dz = -carry * (c - s) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dh = np.concatenate((dz, dr, dc * r))
                du += s @ dh.T
                dg[:, at : at + s.shape[1]] += np.concatenate((dz, dr, dc))
                carry = carry * z + u @ dh
            dg = dg.reshape(3 * h, -1, n).transpose(2, 1, 0)
            d[f"u{side}"] = du
            d[f"x{side}"], d[f"b{side}"] = np.einsum("ntd,ntg->dg", x, dg, optimize=True), dg.sum((0, 1))
            dx += dg @ p[f"x{side}"].T
        return float(loss), d, dx

    def logits(self, halves: tuple[np.ndarray, np.ndarray], idx: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logit of the window that starts at each word of texts of `sizes` words, given as rows idx of a table
        of inputs(); -inf at words near a text's end that start none."""
        n = len(idx)
        at = np.concatenate(([0], np.cumsum(sizes)))
        # REACH shut places before each text and behind the last keep the texts apart.
        place = np.arange(n) + REACH * (1 + np.repeat(np.arange(len(sizes)), sizes))
        rows = np.full(n + REACH * (len(sizes) + 1), -1)
        rows[place] = idx
        weight, value = np.zeros(len(rows)), np.zeros(len(rows))
        for lo in range(0, len(rows) - 2 * REACH, CHUNK):
            own = rows[lo : lo + CHUNK + 2 * REACH]
            sides = []
            for side, table in zip("fb", halves, strict=True):
                gates = table[own]
                gates[own < 0] = SHUT
                sides.append(self.read(np.ascontiguousarray(gates.T), side))
            states = np.concatenate(sides).T
            there = slice(lo + REACH, lo + REACH + len(states))
            weight[there] = np.exp(self.attend(states)[1].astype(np.float64))
            value[there] = weight[there] * (states @ self.p["out"])
        weight, value = (np.concatenate(([0.0], np.cumsum(v[place]))) for v in (weight, value))
        stop = np.minimum(np.arange(n) + WINDOW, np.repeat(at[1:], sizes))
        out = (value[stop] - value[:n]) / (weight[stop] - weight[:n]) + float(self.p["out_b"][0])
        return np.where(window_starts(sizes), out, -np.inf)


def _halves(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of the two directions, each contiguous."""
    w = 3 * HIDDEN
    return np.ascontiguousarray(table[:, :w]), np.ascontiguousarray(table[:, w:])


def _best(score: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first place of the largest score of each text that has one over -inf."""
    most = np.maximum.reduceat(score, begin)
    hit = np.flatnonzero((score == most[owner]) & (score > -np.inf))
    return hit[np.unique(owner[hit], return_index=True)[1]]


def fit(texts: list[bytes], labels: list[int], rounds: int = 3, epochs: int = 3, seed: int = 11) -> Net:
    """A network for the labels of whole texts; a constant score where only one label is given."""
    net = Net(seed)
    y = np.array(labels, np.float32)
    row: dict[bytes, int] = {}
    split, keep = [], []
    for i, text in enumerate(texts):  # words become rows at once; the driver has little memory
        own = np.array([row.setdefault(w, len(row)) for w in words_of(text)], np.int32)
        if len(own):
            split.append(own)
            keep.append(i)
    y = y[keep]
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    names = list(row)
    del row, texts
    sizes = np.array([len(x) for x in split])
    idx = np.concatenate(split)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = window_starts(sizes)
    seen = np.bincount(idx, minlength=len(names))
    common = sorted(np.flatnonzero(seen >= 3).tolist(), key=lambda i: (-seen[i], names[i]))[:WORDS]
    net.vocab = {names[i]: k + 1 for k, i in enumerate(common)}
    known = np.zeros(len(names), np.int32)
    known[common] = np.arange(1, len(common) + 1)
    # The driver has little memory: words, and later texts, are taken in parts.
    grams, lens = [], []
    for lo in range(0, len(names), PART):
        b, edges = gram_buckets(names[lo : lo + PART])
        grams.append(b.astype(np.uint16))
        lens.append(np.diff(edges))
    grams, lens = np.concatenate(grams), np.concatenate(lens)
    at = np.concatenate(([0], np.cumsum(lens)))
    # Odds by n-gram bucket, over texts, shrunk towards none where texts are few: where training starts from.
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, label in zip(split, y, strict=True):
        (pos if label > 0 else neg)[np.unique(_take(grams, at, np.unique(own)))] += 1
    del split
    base = y.mean()
    rate = (pos + SHRINK * base) / (pos + neg + SHRINK)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    net.p["char"][:, 0] = odds  # the first coordinate of a bucket starts there, the others at random
    by_word = np.concatenate([np.add.reduceat(odds[grams[at[lo] : at[min(lo + PART, len(names))]]], at[lo : lo + PART][: len(names) - lo] - at[lo]) for lo in range(0, len(names), PART)]) / lens
    # A window's first score is the sum of its words' squared positive odds.
    total = np.concatenate(([0.0], np.cumsum(np.maximum(by_word, 0)[idx] ** 2)))
    stop = np.minimum(np.arange(len(idx)) + WINDOW, np.repeat(begin + sizes, sizes))
    score = np.where(starts, total[stop] - total[:-1], -np.inf).astype(np.float32)
    del total, stop
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    tick = 0
    clean = np.flatnonzero(starts & (y[owner] == 0))
    for turn in range(rounds):
        pick = _best(score, begin, owner)
        if turn:  # of clean texts also the worst window that the first does not meet
            rest = score.copy()
            for k in range(1 - WINDOW, WINDOW):
                near = pick + k
                near = near[(near >= 0) & (near < len(owner))]
                rest[near] = -np.inf
            second = _best(rest, begin, owner)
            pick = np.concatenate((pick, second[y[owner[second]] == 0]))
        pick = np.concatenate((pick, rng.choice(clean, min(len(clean), len(pick) // 3))))
        weight_up = np.repeat(pick[y[owner[pick]] > 0], max(1, int((y[owner[pick]] == 0).sum() / max(1, (y[owner[pick]] > 0).sum()) / 3)))
        train = np.concatenate((pick[y[owner[pick]] == 0], weight_up))
        for _ in range(epochs + (turn == 0) * epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), 128):
                b = train[lo : lo + 128]
                own = owner[b]
                places, mask = lines(b, begin[own], begin[own] + sizes[own], WINDOW)
                rows = idx[places]
                uniq, inv = np.unique(rows, return_inverse=True)
                inv = inv.reshape(rows.shape)
                ug = _take(grams, at, uniq)
                ul = lens[uniq]
                chars = (np.add.reduceat(net.p["char"][ug], np.concatenate(([0], np.cumsum(ul)[:-1]))) / ul[:, None]).astype(np.float32)
                kept = np.where(rng.random(len(uniq)) < 0.5, 0, known[uniq])  # half of the words must do with their characters
                _, d, dx = net.loss(kept[inv], chars[inv], mask, y[own])
                order = np.argsort(inv, axis=None, kind="stable")
                heads = np.searchsorted(inv.ravel()[order], np.arange(len(uniq)))
                du = np.add.reduceat(dx.reshape(-1, dx.shape[2])[order], heads)
                tick += 1
                rate = 0.004 * np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
                d["word"] = (kept, du[:, :WORD_DIM])
                d["char"] = (ug, np.repeat(du[:, WORD_DIM:] / ul[:, None], ul, axis=0))
                for k, grad in d.items():
                    _adam(net.p[k], moments[k], grad, rate)
        table = np.concatenate([net.vectors(names[lo : lo + PART]) for lo in range(0, len(names), PART)])
        for lo in range(0, len(sizes), 500):
            here = slice(begin[lo], begin[lo] + sizes[lo : lo + 500].sum())
            own, place = np.unique(idx[here], return_inverse=True)
            score[here] = net.logits(_halves(net.gates(table[own])), place, sizes[lo : lo + 500])
        del table
    net.scale = _calibrate(np.maximum.reduceat(score, begin), y)
    return net


def _take(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenated slices flat[at[r]:at[r + 1]]."""
    size = at[rows + 1] - at[rows]
    done = np.cumsum(size)
    return flat[np.repeat(at[rows] - (done - size), size) + np.arange(done[-1] if len(done) else 0)]


def _adam(p: np.ndarray, m: list[np.ndarray], grad, rate: float) -> None:
    """One step; grad is dense or (rows, values) of some rows, which then alone move."""
    if isinstance(grad, tuple):
        rows, inv = np.unique(grad[0], return_inverse=True)
        g = np.stack([np.bincount(inv, grad[1][:, j], len(rows)) for j in range(p.shape[1])], 1).astype(np.float32)
    else:
        rows, g = slice(None), grad
    m[0][rows] = 0.9 * m[0][rows] + 0.1 * g
    m[1][rows] = 0.999 * m[1][rows] + 0.001 * g * g
    p[rows] -= rate * m[0][rows] / (np.sqrt(m[1][rows]) + 1e-7)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the worst window's logit (Newton, with a small ridge)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * x + b)
        w = q * (1 - q) + 1e-6
        g = np.array([((q - y) * x).sum() + 0.5 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 0.05)), float(b)


class Scorer:
    """A network with the inputs of the words it has met; from MEMORY words on it forgets them before a batch."""

    def __init__(self, net: Net):
        self.net, self.known, self.used = net, {}, 0
        self.table = _halves(np.zeros((1024, 6 * HIDDEN), np.float32))

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        if self.used > MEMORY:
            self.known.clear()
            self.used = 0
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            end = self.used + len(part)
            if end > len(self.table[0]):
                self.table = tuple(np.concatenate((t[: self.used], np.zeros((end // 2 + 10_000, 3 * HIDDEN), np.float32))) for t in self.table)
            for t, x in zip(self.table, _halves(self.net.inputs(part)), strict=True):
                t[self.used : end] = x
            self.known.update(zip(part, range(self.used, end), strict=True))
            self.used = end
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        split = [words_of(t) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        out = np.zeros(len(texts))
        if not sizes.any():
            return out
        rows = self.rows_of([w for s in split for w in s])
        has = np.flatnonzero(sizes)
        logit = self.net.logits(self.table, rows, sizes[has])
        worst = np.maximum.reduceat(logit, np.cumsum(sizes[has]) - sizes[has])
        out[has] = sigmoid(self.net.scale[0] * worst + self.net.scale[1])
        return out


_scorers: dict[str, Scorer] = {}


def scorer(packed: bytes) -> Scorer:
    key = hashlib.sha256(packed).hexdigest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(pickle.loads(packed))
    return _scorers[key]


def held_out(col: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text, mod 4, is 2. False for null ids."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Net:
    """Fit on labelled rows outside the held-out fold: at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean ones,
    by the hash of their ids, of texts up to SAMPLE_BYTES. Null labels, ids and texts are left out."""
    rows = labels.filter("toxic is not null and doc_id is not null").filter(~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # A label may belong to a text that is too long or not there; twice as many ids leave enough.
    one = rows.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_TOXIC)
    two = rows.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_CLEAN)
    ids = {r.doc_id: r.toxic for r in one.union(two).collect()}
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(f"octet_length(text) between 1 and {SAMPLE_BYTES}")
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").orderBy("toxic", F.xxhash64("doc_id"), "doc_id", "text")
    texts, labels, room = [], [], {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    for r in got.limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN)).toLocalIterator():
        if room.get(r.toxic, 0):
            room[r.toxic] -= 1
            texts.append(r.text.encode())
            labels.append(r.toxic)
    net = fit(texts, labels)
    del texts
    trim()  # the driver has little memory, and what fitting took is not needed again
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score, predicted) of every whole text, all its windows scored; texts without words score 0."""
    prepare(docs.sparkSession)
    packed = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            got = np.zeros(len(texts))
            for lo, hi in pieces(texts, SPAN):
                got[lo:hi] = scorer(packed).scores(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null, empty and wordless texts score 0; rows with null or repeated ids are scored like others.
    Without usable labels the score is the same for all. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic."""
    prepare(docs.sparkSession)
    net = learn(docs, labels)
    packed = pickle.dumps(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch, batch.schema.names[at])
            ok = np.ones(len(texts), bool)
            for lo, hi in pieces(texts, SPAN):
                ok[lo:hi] = scorer(packed).scores(texts[lo:hi]) < THRESHOLD
            yield batch.filter(pa.array(ok))
        # The stages that follow reuse this worker: it should not keep the words.
        _scorers.clear()
        trim()

    return docs.mapInArrow(run, docs.schema)
