import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ours():
    return bpe.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(ours, text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


@pytest.mark.parametrize("leaf", [1, 3, 512])
def test_decoding_up_the_tree(ours, theirs, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "IDS_LEAF", leaf)
    text = "tree of halves, " * 150
    assert ours.decode(ours.encode(text)) == text.encode() == theirs.decode_bytes(theirs.encode_ordinary(text)) and ours.decode(b"") == b""


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab aA'1\n", max_size=400), st.text("étionçhereing", max_size=300)))
def test_any_text(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5003, "ab" * 3001, "the" * 2000, " " * 4001, "\n \t" * 999, "=-" * 1501, "7" * 999, "aaab" * 997, "einmentchtion" * 301, "　x\x1c\x85᠎​ y"])
def test_long_matches(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_white_space_of_the_pattern(ours, theirs):
    text = "".join(f"a{chr(c)}{chr(c)}b" for c in [*range(0x0, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF])
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_whole_table(spark, sf, theirs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in bpe.digest(docs, PATH, PATTERN).collect()}
    for r in docs.collect():
        want = theirs.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(want)
        assert g.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows_and_array(spark, theirs):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "x" * 200_000), (3, "tie"), (3, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).withColumn("list", bpe.ids_array()).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert r.list == theirs.encode_ordinary(r.text or "")
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_bytes_that_are_not_utf8(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    raw = [b"\xff\xfe one \xc3", b"caf\xe9 au lait", b"\xed\xa0\x80x", b"good"]
    strings = pa.Array.from_buffers(pa.string(), len(raw), pa.array(raw, pa.binary()).buffers())
    pq.write_table(pa.table({"doc_id": pa.array(range(len(raw)), pa.int64()), "text": strings}), tmp_path / "x.parquet")
    docs = spark.read.parquet(str(tmp_path / "x.parquet"))
    got = {r.doc_id: bytes(r.decoded) for r in bpe.round_trip(docs, PATH, PATTERN).select("doc_id", "decoded").collect()}
    assert [got[i] for i in range(len(raw))] == raw


def test_direct_looks_up_few_ranks(ours, monkeypatch):
    seen = []

    class Counting(dict):
        def get(self, *args):
            seen.append(args)
            return super().get(*args)

    piece = b"thereforeinthatoneandtheotheroftheirstatements"
    want = ours.direct(piece)
    monkeypatch.setattr(ours, "rank", Counting(ours.rank))
    assert ours.direct(piece) == want and len(want) > 5
    assert len(seen) <= 3 * len(piece)  # a pass over all pairs after each merge takes some hundreds
