import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import toxicity as T


def test_a_window_starts_at_every_word():
    sizes = np.array([1, 32, 33, 100])
    starts = np.split(T.window_starts(sizes), np.cumsum(sizes)[:-1])
    assert [np.flatnonzero(s).tolist() for s in starts] == [list(range(max(1, n - T.WINDOW + 1))) for n in sizes]


def step(s, x, u):
    h = T.HIDDEN
    hu = s @ u
    z, r = T.sigmoid(x[:h] + hu[:h]), T.sigmoid(x[h : 2 * h] + hu[h : 2 * h])
    return s + (1 - z) * (np.tanh(x[2 * h :] + r * hu[2 * h :]) - s)


def test_every_window_has_the_states_of_its_words(monkeypatch):
    """Window logits from running sums equal a softmax over states found word by word, also where texts cross chunks."""
    net = T.Net(3)
    rng = np.random.default_rng(1)
    sizes = np.array([1, 40, 64, 3 * 64 + 5])
    table = rng.normal(size=(50, 6 * T.HIDDEN)).astype(np.float32)
    idx = rng.integers(0, 50, sizes.sum())
    whole = net.logits(T._halves(table), idx, sizes)
    monkeypatch.setattr(T, "CHUNK", 37)
    assert np.allclose(net.logits(T._halves(table), idx, sizes), whole, atol=1e-5)
    for rows, mine in zip(np.split(idx, np.cumsum(sizes)[:-1]), np.split(whole, np.cumsum(sizes)[:-1]), strict=True):
        n, states = len(rows), []
        for i in range(n):
            f, b = np.zeros(T.HIDDEN), np.zeros(T.HIDDEN)
            for k in range(max(0, i - T.REACH), i + 1):
                f = step(f, table[rows[k], : 3 * T.HIDDEN], net.p["uf"])
            for k in range(min(n - 1, i + T.REACH), i - 1, -1):
                b = step(b, table[rows[k], 3 * T.HIDDEN :], net.p["ub"])
            states.append(np.concatenate((f, b)))
        states = np.array(states)
        e = np.exp(np.tanh(states @ net.p["att"] + net.p["att_b"]) @ net.p["att_v"])
        for i in range(n):
            if i > max(0, n - T.WINDOW):
                assert mine[i] == -np.inf
                continue
            w = e[i : i + T.WINDOW] / e[i : i + T.WINDOW].sum()
            assert abs(w @ states[i : i + T.WINDOW] @ net.p["out"] + net.p["out_b"][0] - mine[i]) < 1e-4


def test_trimming_a_prefix_changes_no_score():
    """Wherever its words stand in a text, a toxic window has the same logit, and the text the same score."""
    net = T.fit([b"you vile clown", b"a calm day", b"vile thing here", b"calm sea and sky"] * 5, [1, 0, 1, 0] * 5, rounds=1, epochs=2)
    words = ("calm sea and sky a calm day " * 30).split()
    scorer, far = T.Scorer(net), " ".join(["you vile clown vile thing here"] * 6)
    scores = scorer.scores([" ".join([*words[k:], far]).encode() for k in range(0, 160, 7)])
    assert np.ptp(scores) < 1e-6 and scores[0] > scorer.scores([" ".join(words).encode()])[0]
    table = T._halves(net.inputs([w.encode() for w in [*words, *far.split()]]))
    rows = np.arange(len(words) + len(far.split()))
    whole = net.logits(table, rows, np.array([len(rows)]))
    for k in (1, 17, 64, 100):
        assert np.allclose(net.logits(table, rows[k:], np.array([len(rows) - k]))[T.REACH :], whole[k + T.REACH :], atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    net = T.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    whole = T.WINDOW + 2 * T.REACH
    known = rng.integers(0, 20, (4, whole))
    chars = rng.normal(size=(4, whole, T.CHAR_DIM))
    at, first = np.arange(whole), T.REACH
    mask = ((at >= np.array([0, 3, first, first])[:, None]) & (at < np.array([whole, first + 5, first + 1, whole - 7])[:, None])).astype(float)
    y = np.array([1.0, 0, 1, 0])
    _, d, dx = net.loss(known, chars, mask, y)
    for k in ("xf", "ub", "uf", "bb", "att", "att_b", "att_v", "out", "out_b"):
        at = tuple(int(rng.integers(s)) for s in net.p[k].shape)
        was, eps = net.p[k][at], 1e-3
        net.p[k][at] = was + eps
        up = net.loss(known, chars, mask, y)[0]
        net.p[k][at] = was - eps
        down = net.loss(known, chars, mask, y)[0]
        net.p[k][at] = was
        assert abs((up - down) / (2 * eps) - d[k][at]) < 2e-5, k
    chars[1, 4, 3] += 1e-3
    up = net.loss(known, chars, mask, y)[0]
    chars[1, 4, 3] -= 2e-3
    down = net.loss(known, chars, mask, y)[0]
    assert abs((up - down) / 2e-3 - dx[1, 4, T.WORD_DIM + 3]) < 2e-5


def test_scoring_equals_the_training_pass():
    net = T.fit([b"you vile clown", b"a calm day", b"vile thing here", b"calm sea and sky"] * 5, [1, 0, 1, 0] * 5, rounds=1, epochs=1)
    words = [b"you", b"vile", b"calm"]
    table = net.inputs(words)
    one = net.logits(T._halves(table), np.array([0, 1, 2]), np.array([3]))[0]
    whole = T.WINDOW + 2 * T.REACH
    here = slice(T.REACH, T.REACH + 3)
    pad = np.zeros((1, whole), int)
    pad[0, here] = [net.vocab.get(w, 0) for w in words]
    chars = np.zeros((1, whole, T.CHAR_DIM))
    chars[0, here] = net.chars(words)
    mask = np.zeros((1, whole))
    mask[0, here] = 1
    loss = net.loss(pad, chars, mask, np.array([1.0]))[0]
    assert abs(-np.log(T.sigmoid(one) + 1e-7) - loss) < 1e-3


def test_held_out_and_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = T.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    mark = {r.doc_id: r.toxic for r in labels.collect()}
    far = [r for r in rows if r.held_out and mark.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    hit = sum(r.predicted and mark[r.doc_id] for r in far)
    # Measured 0.78 and 0.92: few toxic texts here are not English (some 20 to 50 to learn from in each language).
    assert hit >= 0.7 * sum(mark[r.doc_id] for r in far) and hit >= 0.8 * sum(r.predicted for r in far)


def test_odd_rows(spark):
    bad, good = "you are a vile clown and more", "the sea is calm and wide today"
    rows = [(i, (bad if i % 2 else good) + f" {i}", 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (102, " .,! ", 1), (None, bad, 1), (103, "calm sea " * 40_000 + bad, 1), (104, bad, 1), (104, bad, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (3, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    out = T.classify(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[100].score == by[101].score == by[102].score == 0 and by[103].predicted == by[104].predicted == by[None].predicted == 1
    assert T.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in T.classify(docs, labels.limit(0)).collect()} == {0.0}
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(0, 60, 2)} | {100, 101, 102}
