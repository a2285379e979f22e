from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import minhash


def brute(rows, percent):
    """doc_id -> (n_shingles, component_id), by counting all overlaps with an inverted index."""
    sets, posts, up = {}, defaultdict(list), {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        up[doc] = doc
        for s in sets[doc]:
            posts[s].append(doc)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b, inter in Counter(b for s in sets[a] for b in posts[s] if b > a).items():
            if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [85, 80])
def test_matches_brute_force(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == want
    assert any(d != c for d, (_, c) in want.items())


def test_hot_group_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i % 40}"] + base[31:]), "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(20)), "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = brute([(r[0], r[1]) for r in rows], 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 85, block=7).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b"), (7, "x " * 200_000), (7, "x " * 200_000), (8, "x x x x x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("component_id", F.lit("z"))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert {(g[0], g[1], g[3]) for g in got} == {(1, 0, True), (2, 0, True), (3, 0, True), (4, 1, True), (5, 1, False), (6, 1, True), (-1, 1, True), (7, 1, True), (8, 1, False)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_deletes_rows_not_ids(spark):
    """Of two rows with one id only the near copy goes; extra columns with clashing names stay as they are."""
    copy = "a b c d e f g h"
    rows = [(3, copy), (7, copy), (7, "another text that stands for itself here"), (7, None), (7, ""), (None, copy), (9, copy.upper()), (9, copy.upper()), (3, copy)]
    docs = spark.createDataFrame([(i, t, k, 5, 6) for k, (i, t) in enumerate(rows)], "doc_id long, text string, t1 int, t2 int, id int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.t1 for r in kept.collect()) == [0, 2, 3, 4, 5, 8]


def test_stage_keeps_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (2, "a b c d e f"), (9, "q r")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 9]


def test_documents_without_copies_are_not_shuffled(spark):
    """Less is shuffled than the texts are long: neither they nor keys of band values that one document alone has move."""
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(150))) for i in range(1500)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = lambda: sum(s.shuffleWriteBytes() for s in _stages(spark))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs.localCheckpoint()
        before = written()
        gone = sorted(r.doc_id for r in minhash.near_duplicates(docs).filter("not kept").collect())
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert gone == [5000 + i for i in range(5)]
    assert moved < sum(len(t) for _, t in rows)


def _stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
