import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [[m.span() for m in EMAIL.finditer(text)], [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]]
    out.append([m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))])
    out.append([m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])
    return out


def check(rows, got):
    for r, text in zip(got, rows, strict=True):
        want = brute(text)
        base = ",".join(f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, want, strict=True) for a, b in s)
        assert r.base == base, (text[:300], r.base, base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, want))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == base or r.spans.startswith(base)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs).collect()
    check([text[r.doc_id] for r in got], got)
    assert len(got) == len(text) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 50


HARD = ["a@b", "a@b.c", "a@b.c@d.e", "a@b.c_x@d.e.f-", "a@b..c@d.e", "x.y@.z", "é@b.co a.b%c+d@e-f.g.h.", "1.2.3.4.5.6.7.8", "999.1.1.1.5.6.7.8", "001.02.255.256 0255.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "+1 555 01 ) ", "++49 30 123456 78", "a\x01b@c.d 4\x0111111111111111", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
        "\U0001f600 a@b.c", "a@b.c" + ".d" * 8000, "1 " * 9000, "9" * 50_000, "x" * 100_000 + "@", "+1" + "2 " * 30_000, "@.@.@", "", None]


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("_t", F.lit(1)).withColumn("spans", F.lit("clash"))
    got = sorted(pii.find(docs).collect(), key=lambda r: r.doc_id)
    check(HARD, got)
    assert pii.find(docs.limit(0)).count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("a1@.+- (4\x01é_", max_size=40), min_size=200, max_size=200))
def test_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    based = pii.with_base(docs).select("doc_id", pii.joined(*pii.KINDS).alias("base")).collect()
    for r in based:
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, brute(texts[r.doc_id]), strict=True) for a, b in s), texts[r.doc_id]


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, f"Contact Zyxomatic Person {i} at boss@corp.example or ask around", 0) for i in range(4)]
    rows += [(100 + i, f"common words contact person around common {i}", 0) for i in range(60)]
    return rows + [(None, "boss@corp.example", 1), (200, None, None), (0, rows[0][1], 0)]


def test_disclosing_terms(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, n_chars long")
    got = [r for r in pii.find(docs).collect() if r.doc_id is not None]
    n = len(corpus)
    for r in got:
        text = dict((a, b) for a, b, _ in corpus)[r.doc_id]
        want = [m.span() for m in re.finditer("Zyxomatic", text or "")]
        assert [x for x in r.spans.split(",") if x.startswith("term")] == [f"term:{a}:{b}" for a, b in want], r
    assert len(got) == n - 1
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert pii.sanitise(docs).columns == docs.columns
    assert clean[1].text.startswith("Contact ") and "Zyx" not in clean[1].text and "[EMAIL]" in clean[1].text and clean[1].n_chars == len(clean[1].text)
    assert clean[100].text == corpus[4][1] and clean[200].text is None


def test_disclosing_terms_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    word = regex.compile(pii.TERM)
    words = {i: set(word.findall(t.lower())) for i, t in text.items()}
    df_t = Counter(w for own in words.values() for w in own)
    who, held = defaultdict(set), {}
    got = pii.find(docs).collect()
    for r in got:
        rest = text[r.doc_id]
        for x in reversed(sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r.base.split(",") if s))):
            v = text[r.doc_id][x[0] : x[1]]
            who[x[2], v.lower() if x[2] == "email" else v if x[2] == "ip" else re.sub("[^0-9]", "", v)].add(r.doc_id)
            rest = rest[: x[0]] + " " + rest[x[1] :]
        held[r.doc_id] = set(word.findall(rest.lower()))
    n, told = len(text), set()
    for ids in who.values():
        for w, co in Counter(w for i in ids for w in held[i]).items():
            if math.log2(n * co / (df_t[w] * len(ids))) >= pii.GENERALISE_AT * math.log2(n / len(ids)):
                told.add(w)
    assert told
    for r in got:
        assert (r.terms or []) == sorted(words[r.doc_id] & told), r.doc_id
    assert sum(r.n_term for r in got) > 0


def test_terms_far_away_and_in_other_documents(spark):
    filler = "plain words without meaning " * 100
    rows = [(0, f"Quibblethorp {filler} to one@corp.example"), (1, f"quibblethorp {filler}"), (2, "")] + [(10 + i, filler) for i in range(1500)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].terms == got[1].terms == ["quibblethorp"]
    assert got[1].spans == "term:0:12" and got[1].n_term == 1 and got[10].terms is None


def _shuffled_records(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_words_that_disclose_nothing_are_not_shuffled(spark):
    plain = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))
    rows = [(0, "Quibblethorp to one@corp.example")] + [(1 + i, plain) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled_records(spark)
        got = {r.doc_id: r.terms for r in pii.find(docs).collect()}
        assert _shuffled_records(spark) - before < 20_000  # of 120,000 words
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got.pop(0) == ["quibblethorp"] and set(got.values()) == {None}
