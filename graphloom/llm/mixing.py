"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Token masses of the cells (source, language, topic) are raked: each sweep scales them to the target
shares of one dimension after another, until every marginal is within `TOLERANCE` of its target. There is one
row a cell, so sweeps run as window sums within one partition, without exchanges. A cell's factor, raked over given mass, is the calibrated weight
of its documents; sampling probabilities are these weights times a common rate, at most one, and the rate
is the one at which the wanted fraction of all tokens is expected in the sample. Where cells are cut at one,
the sample's shares differ from the targets; shares() has both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import prepare, stage

DIMS = ("source", "lang", "topic")
TOLERANCE = 1e-9  # of every marginal share
BURST = 4  # sweeps between two looks at the residual
MOST = 400  # sweeps; targets that exclude one another (cells without mass) are never met, the residual says so
#: Exponent on the given shares that makes the default targets: under 1 favours the rare.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.5}
FRACTION = 0.5  # of the tokens that the sample is expected to hold
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    """White-space separated words of the whole text; 0 for null."""
    return F.expr(f"cast(coalesce(regexp_count({text}, r'{WORD}'), 0) as long)")


def topic(text: str = "text") -> Column:
    """A surface topic by the first rule that holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains("icensed under"), "licence")
        .when(t.contains("@"), "contact")
        .when(t.contains("|"), "table")
        .when(F.length(t) < 400, "short")
        .otherwise("prose")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone (52 bits of md5)."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|mix"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _sums(dim: str, x: str = "_x") -> Column:
    return F.sum(x).over(Window.partitionBy(dim))


def _whole(x: Column) -> Column:
    return F.sum(x).over(Window.partitionBy())


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """Cells (source, lang, topic, mass) with `factor`, the raked mass over the given one, and `residual`: the largest
    difference of a marginal share from its target, which is over `tolerance` only where `most` sweeps did not do.

    targets: for a dimension, a table (value, share) with shares over zero; values without a share get
    none of the mass. Dimensions left out aim at the given shares tempered by TEMPER. Shares are
    normalised over the values that have mass. Cells without mass are left out. The cells, one row for each
    combination that occurs, are held by one task.
    """
    whole = cells.filter("mass > 0").withColumn("_x", F.col("mass").cast("double"))
    for dim in DIMS:
        if targets and dim in targets:
            given = targets[dim].select(F.col("value").alias(dim), F.col("share").cast("double").alias(f"_w_{dim}"))
            whole = whole.join(given, dim, "left")
    whole = whole.coalesce(1)
    for dim in DIMS:
        aim = F.coalesce(f"_w_{dim}", F.lit(0.0)) if f"_w_{dim}" in whole.columns else F.pow(_sums(dim), F.lit(TEMPER[dim]))
        whole = whole.withColumn("_a", aim).withColumn("_p", F.col("_a") * F.col("_x") / _sums(dim))  # a value's aim, dealt to its cells
        whole = whole.withColumn(f"_t_{dim}", F.col("_a") / _whole(F.col("_p")))
    whole = whole.withColumn("_total", _whole(F.col("_x")))
    keep = [*DIMS, "mass", *[f"_t_{d}" for d in DIMS], "_total"]
    done, last = 0, None
    while True:
        for _ in range(BURST):
            for dim in DIMS:
                now = _sums(dim)
                whole = whole.withColumn("_x", F.when(now > 0, F.col("_x") * F.col(f"_t_{dim}") * F.col("_total") / now).otherwise(0.0))
        off = F.greatest(*[F.abs(_sums(d) / F.col("_total") - F.col(f"_t_{d}")) for d in DIMS])
        whole = stage(whole.withColumn("_off", off).select(*keep, "_x", "_off"), "cells")
        worst = whole.agg(F.max("_off")).first()[0]
        done += BURST
        if worst is None or worst <= tolerance or done >= most or (last is not None and worst > 0.999 * last and done >= 10 * BURST):
            return whole.select(*DIMS, "mass", (F.col("_x") / F.col("mass")).alias("factor"), F.lit(worst).cast("double").alias("residual"))
        last = worst
        whole = whole.drop("_off").coalesce(1)


def common_rate(raked: DataFrame, fraction: float) -> float:
    """The rate c with sum(mass * min(1, c * factor)) = fraction * sum(mass); 1 / the least factor where all must be taken.

    From the largest factor down, cells are cut at one until the rate that the rest of the mass then needs cuts no other.
    """
    down = Window.orderBy(F.desc("factor"), *DIMS)
    x = raked.filter("factor > 0").coalesce(1).select(
        "factor", F.sum(F.col("mass").cast("double")).over(Window.partitionBy()).alias("all"),
        F.coalesce(F.sum("mass").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("above"),
        F.sum(F.col("mass") * F.col("factor")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("below"))
    x = x.withColumn("rate", (F.lit(fraction) * F.col("all") - F.col("above")) / F.col("below"))
    r = x.agg(F.min_by("rate", F.when(F.col("factor") * F.col("rate") < 1, F.col("above"))).alias("rate"), F.min("factor").alias("least")).first()
    return r["rate"] if r["rate"] is not None else 1 / r["least"] if r["least"] else float(fraction)


def weigh(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION) -> DataFrame:
    """`docs` with _topic, n_tokens, weight (the cell's factor), prob and selected.

    Null sources and languages form the value '(none)'; documents without a word have weight 1 and the
    common rate as probability. Whether a document is selected depends on its doc_id and probability
    alone, so repeated rows share their fate; a null id counts as ''. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    dims = {d: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in ("source", "lang")}
    rows = docs.withColumns({"_d_source": dims["source"], "_d_lang": dims["lang"], "_topic": topic(), "n_tokens": tokens()})
    cells = rows.groupBy(F.col("_d_source").alias("source"), F.col("_d_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("n_tokens").alias("mass"))
    cells = stage(cells, "mass")
    raked = stage(rake(cells, targets), "raked")
    rate = common_rate(raked, fraction)
    # One row for each cell; the join key is salted over the rows so that a hot cell is dealt to many tasks.
    salt = 16
    spread = raked.select(
        F.col("source").alias("_d_source"), F.col("lang").alias("_d_lang"), F.col("topic").alias("_topic"), "factor", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt")
    )
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int"))
    out = rows.join(spread, ["_d_source", "_d_lang", "_topic", "_salt"], "left")
    out = out.withColumn("weight", F.coalesce("factor", F.lit(1.0)))
    out = out.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))
    out = out.withColumn("selected", uniform(F.col("doc_id")) < F.col("prob"))
    return out.select(*docs.columns, *[c for c in ("_topic", "n_tokens", "weight", "prob", "selected") if c not in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, topic, n_tokens, weight, prob, selected) of every document; weights and probabilities to 6 places."""
    out = weigh(docs.select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("_topic").alias("topic"), "n_tokens", F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "selected")


def shares(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION) -> DataFrame:
    """(dim, value, natural, target, expected, realised): token shares of a dimension's values in the table, under the
    raked weights, expected in the sample and in the sample drawn.

    A document is taken once at most, so where a value's target times the fraction is more than it holds, its
    expected share stays under the target, and that of the others over it."""
    w = weigh(docs.select("doc_id", "text", "source", "lang"), targets, fraction)
    mass = {"natural": F.col("n_tokens").cast("double"), "target": F.col("n_tokens") * F.col("weight"), "expected": F.col("n_tokens") * F.col("prob"), "realised": F.when(F.col("selected"), F.col("n_tokens")).otherwise(0).cast("double")}
    values = {"source": F.coalesce(F.col("source").cast("string"), F.lit("(none)")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("(none)")), "topic": F.col("_topic")}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), values[d].alias("value")) for d in DIMS]))
    by = w.select(each.alias("v"), *[m.alias(k) for k, m in mass.items()]).groupBy("v.dim", "v.value").agg(*[F.sum(k).alias(k) for k in mass])
    return by.select("dim", "value", *[(F.col(k) / F.sum(k).over(Window.partitionBy("dim"))).alias(k) for k in mass])


def sample(docs: DataFrame, fraction: float = 0.8) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    own = weigh(docs.select("doc_id", "text", "source", "lang"), fraction=fraction).filter("not selected").select("doc_id").distinct()
    return docs.join(own, docs["doc_id"].eqNullSafe(own["doc_id"]), "left_anti").select(*docs.columns)


def oracle(sweeps: int = 40, fraction: float = FRACTION) -> str:
    """report() over the table documents in DuckDB's SQL; as many sweeps as bring the residual far below the places reported."""
    parts = [
        "rows0 as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,"
        " case when contains(coalesce(text, ''), 'icensed under') then 'licence' when contains(coalesce(text, ''), '@') then 'contact'"
        " when contains(coalesce(text, ''), '|') then 'table' when length(coalesce(text, '')) < 400 then 'short' else 'prose' end as topic,"
        rf" cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as n_tokens from documents)",
        "cells as (select source, lang, topic, sum(n_tokens)::double as mass from rows0 group by all having sum(n_tokens) > 0)",
    ]
    for d in DIMS:
        parts.append(f"t_{d} as (select {d}, pow(sum(mass), {TEMPER[d]}) / sum(pow(sum(mass), {TEMPER[d]})) over () as t from cells group by {d})")
    parts.append("x0 as (select source, lang, topic, mass, mass as x, sum(mass) over () as total, a.t as t_source, b.t as t_lang, c.t as t_topic from cells join t_source a using (source) join t_lang b using (lang) join t_topic c using (topic))")
    k = 0
    for _ in range(sweeps):
        for d in DIMS:
            parts.append(f"x{k + 1} as materialized (select * exclude (x), x * t_{d} * total / sum(x) over (partition by {d}) as x from x{k})")
            k += 1
    parts.append(f"raked as (select source, lang, topic, mass, x / mass as factor from x{k})")
    parts.append(f"x{k}s as (select factor, sum(mass) over () as t, coalesce(sum(mass) over (order by factor desc rows between unbounded preceding and 1 preceding), 0) as above, sum(mass * factor) over (order by factor desc rows between current row and unbounded following) as below from raked)")
    parts.append(f"rate as (select coalesce(max(({fraction} * t - above) / below), {fraction}) as r from x{k}s where below > 0 and factor * ({fraction} * t - above) / below < 1 and above = (select min(above) from x{k}s where below > 0 and factor * ({fraction} * t - above) / below < 1))")
    parts.append("w as (select doc_id, topic, n_tokens, coalesce(factor, 1.0) as weight, least(1.0, coalesce(factor, 1.0) * r) as prob from rows0 left join raked using (source, lang, topic) cross join rate)")
    u = "('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|mix'), 1, 13))::bigint / 4503599627370496.0"
    return "with " + ", ".join(parts) + f" select doc_id, topic, n_tokens, round(weight, 6) as weight, round(prob, 6) as prob, {u} < prob as selected from w"
