import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import suffix


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def run(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(suffix.remove_repeats(docs, **how).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b))), max_size=40))
def test_sort_and_classes(rows):
    group, strings = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
    if not rows:
        return
    order, common = suffix.Suffixes(strings, group).classes()
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in rows)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        assert common[k] == (suffix._common(strings[i], strings[j]) if group[i] == group[j] else -1)


def test_collision_falls_back(monkeypatch):
    monkeypatch.setattr(suffix.Hashes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    strings = [b"ba", b"ab", b"aa"]
    order, common = suffix.Suffixes(strings, np.zeros(3, np.int64)).classes()
    assert order.tolist() == [2, 1, 0] and common.tolist() == [-1, 1, 0]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_small_alphabet(spark, crowd):
    rng = np.random.default_rng(crowd)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(0, 120, 60)]
    passage = "".join(rng.choice(list("abcdefgh"), 70))
    texts += ["x" * 90, "xy" * 50, texts[0], texts[0], "é" * 40, "", *[f"{i}" * int(i % 5) + passage[i % 9 : 70 - i % 7] + "q" * (i % 4) for i in range(30)]]
    want = brute([t.encode() for t in texts], 20)
    assert run(spark, texts, length=20, gram=6, crowd=crowd) == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = brute([t.encode() for _, t in rows], 200)
    got = sorted(suffix.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert sum(w[1] for w in want) > 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (None, "d" * 300), (None, "d" * 300), (6, "e" * 250), (6, "e" * 250), (7, "f\n" * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit("x")).withColumn("spans", F.lit(1))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(docs).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 199, 0, 0), (4, 200, 0, 0), (5, 201, 201, 1), (None, 300, 300, 1), (6, 250, 250, 1), (7, 120_000, 120_000, 1)}
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_crowd_through_the_sort(spark, monkeypatch):
    """Many contexts around one gram, some of which share windows; hashes that see nothing leave it to the bytes."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    core, texts = "zyxwvuts", []
    shared = [(word(9), word(9)) for _ in range(4)]
    for i in range(160):
        a, b = shared[i % 4]
        k = int(rng.integers(0, 10))
        texts.append(word(12) + a[9 - k :] + core + b[: 9 - k] + word(12))
    texts += [word(3) + shared[0][0] + core + word(20) for _ in range(40)] + [word(20) + core + shared[1][1] + word(3) for _ in range(40)]
    want = brute([t.encode() for t in texts], 20)
    assert sum(w[1] for w in want) > 0 and any(w[1] == 0 for w in want)
    for crowd in (20_000, 50, 5, 1):
        assert run(spark, texts, length=20, gram=6, crowd=crowd) == want


def test_texts_that_share_a_name(spark, monkeypatch):
    """Where the first hash does not tell texts apart, the second names them, and none is taken for a copy."""
    monkeypatch.setattr(suffix, "_told", lambda text="text": F.substring(text, 1, 1).cast("long"))
    texts = [f"{k % 3}" + "abcdefg"[k] * 3 + "".join(chr(97 + (i * i * (k + 2)) % 26) for i in range(70)) for k in range(7)]
    texts += [texts[0], texts[3]]
    assert run(spark, texts, length=20, gram=6) == brute([t.encode() for t in texts], 20)
