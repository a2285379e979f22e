import base64

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_minhash import brute


def test_each_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    clean = cp.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() >= 0.8 * len(before)

    want = {d for d, (_, c) in brute([(r.doc_id, r.text) for r in before.values()], 80).items() if d == c}
    one = cp.drop_near_copies(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want

    safe = cp.replace_personal_data(spark, docs, sf)
    rows = safe.collect()
    assert safe.dtypes == docs.dtypes and {r.doc_id for r in rows} == set(before)
    assert any("[EMAIL]" in r.text for r in rows if r.text) and not any("@example" in (r.text or "") for r in rows)

    mixed = cp.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= len(before)

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in cp.encode_tokens(spark, docs, sf).collect():
        ids = lib.encode_ordinary(before[r.doc_id].text or "")
        assert r.n_tokens == len(ids) and r.round_trip
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and rows and all(r.round_trip for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_stages_on_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "a@b.c " * 3000, "en", None, 5), (2, "a@b.c " * 3000, "en", None, 5), (3, "one two", "xx", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit("clash"))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert cp.encode_tokens(spark, docs, sf).count() == len(rows)
