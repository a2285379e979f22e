import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing


def test_equals_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r) for r in mixing.report(spark.read.parquet(path)).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = sorted(con.sql(mixing.oracle()).fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[5] == w[5] and abs(g[3] - w[3]) <= 1.1e-6 and abs(g[4] - w[4]) <= 1.1e-6


def test_marginals_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    share = {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}
    aim = {"lang": spark.createDataFrame(list(share.items()), "value string, share double")}
    out = mixing.weigh(docs, aim, fraction=0.05).groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("prob")).alias("x"), F.max("prob").alias("p"), F.sum("n_tokens").alias("all")).collect()
    total = sum(r.x for r in out)
    assert total == pytest.approx(0.05 * sum(r["all"] for r in out), rel=1e-6)
    for r in out:
        assert r.p == 1 or r.x / total == pytest.approx(0.25, rel=0.05)


def test_raked_to_the_tolerance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cells = docs.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), mixing.topic().alias("topic")).agg(F.sum(mixing.tokens()).alias("mass"))
    out = mixing.rake(cells).collect()
    total = sum(r.mass for r in out)
    assert {r.residual for r in out} == {out[0].residual} and out[0].residual <= mixing.TOLERANCE
    for dim in mixing.DIMS:
        given, got = {}, {}
        for r in out:
            given[r[dim]] = given.get(r[dim], 0) + r.mass
            got[r[dim]] = got.get(r[dim], 0) + r.mass * r.factor / total
        aim = {k: v ** mixing.TEMPER[dim] for k, v in given.items()}
        assert all(abs(got[k] - aim[k] / sum(aim.values())) <= 2 * mixing.TOLERANCE for k in got)


def test_targets_that_cannot_be_met_end(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, mass long")
    one = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double")
    two = spark.createDataFrame([("x", 0.1), ("y", 0.9)], "value string, share double")
    out = mixing.rake(cells, {"source": one, "lang": two}, most=20).collect()
    assert len(out) == 2 and out[0].residual == pytest.approx(0.8)


def test_capped_rate_keeps_the_fraction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = mixing.weigh(docs, fraction=0.8).agg(F.sum(F.col("n_tokens") * F.col("prob")).alias("x"), F.sum("n_tokens").alias("n"), F.avg(F.col("selected").cast("int")).alias("kept")).first()
    assert r.x == pytest.approx(0.8 * r.n, rel=1e-6) and r.kept > 0.7


@pytest.mark.parametrize("fraction", [mixing.FRACTION, 0.8])
def test_shares_at_production_fractions(spark, fraction):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.shares(docs, fraction=fraction).collect()
    for dim in mixing.DIMS:
        own = [r for r in rows if r.dim == dim]
        for k in ("natural", "target", "expected", "realised"):
            assert sum(r[k] for r in own) == pytest.approx(1)
        tempered = {r.value: r.natural ** mixing.TEMPER[dim] for r in own}
        for r in own:
            # The raked weights meet the target; the sample holds no more of a value than there is.
            assert r.target == pytest.approx(tempered[r.value] / sum(tempered.values()), rel=1e-6)
            assert r.expected * fraction <= r.natural * (1 + 1e-9)
    # Without repeats prose cannot get below this, which is above its target.
    prose = next(r for r in rows if r.value == "prose")
    assert prose.expected >= 1 - (1 - prose.natural) / fraction - 1e-9 > prose.target


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "one two", None, "en"), (None, "three", "s", None), (4, "x " * 100_000, "s", "en"), (4, "x " * 100_000, "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("clash")).withColumn("topic", F.lit(3))
    out = mixing.report(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.prob <= 1 for r in out)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    assert mixing.report(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
