import numpy as np
import zlib

from graphloom.llm import langid


def test_counts_and_vectors():
    counts, codes, letters = langid.profiles([b"abab", b"", "É1".encode(), b"12 !", b"ba"])
    assert letters.tolist() == [True, False, True, False, True]
    sym = langid._symbol_table()
    a, b = int(sym[97]), int(sym[98])
    have = dict(zip(codes.tolist(), counts[0].tolist()))
    assert have[a << 24 | b << 12 | a] == 1 and have[0 << 24 | a << 12 | b] == 1 and have[b << 24 | a << 12 | b] == 1 and have[a << 24 | b << 12 | 0] == 1
    assert counts[0].sum() == 4 and counts[3].sum() == 0
    v = langid.vectors_of(np.array([a << 24 | b << 12 | a]))[0]
    L = langid._LETTERS.astype(int)
    assert (v == np.roll(L[a], 2) * np.roll(L[b], 1) * L[a]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    far = [r for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert sum(r.lang_pred == lang[r.doc_id] for r in far) >= 0.97 * len(far)


def test_odd_rows(spark):
    rows = [(i, "der die das und nicht ein", "de", 1.0) for i in range(9)] + [(i, "the and that with this", "en", 1.0) for i in range(10, 19)]
    rows += [(20, None, "en", 0.0), (21, "", "de", 0.0), (22, "12 34 !", "de", 0.0), (None, "the the", None, 0.0), (23, "THE AND " * 50_000, None, 0.0), (23, "THE AND", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[20].lang_pred == by[21].lang_pred == by[22].lang_pred == "und" and by[22].score == 0
    assert by[23].lang_pred == by[None].lang_pred == "en" and by[None].held_out is False
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_bundles_are_the_sums_of_all_trigrams(monkeypatch):
    monkeypatch.setattr(langid, "SPAN", 300)
    monkeypatch.setattr(langid, "CELLS", 64)
    monkeypatch.setattr(langid, "CODES", 16)
    texts = ["der die das " * 90, "", "x" * 1000, "日本語の文 と文字 " * 40, "12 !", "été naïve\n" * 70]
    kind = np.array([0, 1, 2, 1, 0, 2])
    v, letters = langid.bundles([t.encode() for t in texts], kind, 3)
    counts, codes, want = langid.profiles([t.encode() for t in texts])
    each = counts @ langid.vectors_of(codes)
    assert letters.tolist() == want.tolist() == [True, False, True, True, False, True]
    assert all((v[k] == each[kind == k].sum(0)).all() for k in range(3))


def test_bytes_that_are_not_utf8():
    bad, good = langid.profiles([b"ab\xff\xfecd", b"ab cd"])[0]
    assert (bad == good).all()
