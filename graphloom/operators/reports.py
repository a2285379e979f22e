"""Text reports as queries (P25c, P30, C12, GA17, A02, A13c, X25, X26, SK11, Y22): a line or a document a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violation_report(status: DataFrame, violations: DataFrame, most: int = 3) -> DataFrame:
    """(graph_id, report): a line a constraint, and the first `most` violations of those that fail."""
    w = Window.partitionBy("graph_id", "constraint").orderBy("entity", "other")
    line = F.concat(F.lit("    -> "), "entity", F.coalesce(F.concat(F.lit(" / "), "other"), F.lit("")), F.lit(": "), F.format_number("actual", 2), F.lit(" vs "), F.format_number("required", 2))
    first = violations.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("graph_id", "constraint", "k", line.alias("line"))
    first = first.groupBy("graph_id", "constraint").agg(F.expr("transform(array_sort(collect_list(struct(k, line))), x -> x.line)").alias("lines"))
    head = F.concat(F.when(F.col("passed"), "[pass] ").otherwise("[FAIL] "), "constraint", F.when(F.col("passed"), "").otherwise(F.concat(F.lit(" ("), "n_violations", F.lit(")"))))
    rows = status.join(first, ["graph_id", "constraint"], "left").select("graph_id", "constraint", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("text"))
    return rows.groupBy("graph_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(constraint, text))), x -> x.text), '\n')").alias("report"))


def summary_report(summary: DataFrame) -> DataFrame:
    """GA17, P25c: (graph_id, report) of graph_summary rows, one line a column."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns if c != "graph_id"]
    return summary.select("graph_id", F.concat_ws("\n", F.concat(F.lit("graph "), F.col("graph_id").cast("string")), *lines).alias("report"))


def rate_marks(rates: DataFrame) -> DataFrame:
    """(constraint, line): a rate with ok from 0.90, weak from 0.50, else bad."""
    mark = F.when(F.col("rate") >= 0.9, "ok  ").when(F.col("rate") >= 0.5, "weak").otherwise("bad ")
    return rates.select("constraint", F.concat(mark, F.lit(" "), "constraint", F.lit(" "), F.format_number(100 * F.col("rate"), 1), F.lit("%")).alias("line"))


def grade_report(scores: DataFrame) -> DataFrame:
    """(graph_id, report) of (graph_id, metric, score) rows with the mean and its grade."""
    from graphloom.operators.stats import grade

    line = F.concat("metric", F.lit(" "), F.format_number("score", 1))
    d = scores.groupBy("graph_id").agg(F.avg("score").alias("mean"), F.sort_array(F.collect_list(line)).alias("lines"))
    return d.select("graph_id", F.concat_ws("\n", F.array_join("lines", "\n"), F.concat(F.lit("overall "), F.format_number("mean", 1), F.lit(" "), grade(F.col("mean")))).alias("report"))


def composition_lines(comp: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """(motif_id, text): the types with a mean from `least` on by count, at most `most`."""
    w = Window.partitionBy("motif_id").orderBy(F.desc("mean"), "room_type")
    d = comp.filter(F.col("mean") >= least).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    return d.groupBy("motif_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(k, room_type, mean))), x -> concat(cast(round(x.mean) as int), ' ', x.room_type)), ', ')").alias("text"))


def motif_report(motifs: DataFrame, texts: DataFrame) -> DataFrame:
    """SK11: (motif_id, line) in order of frequency."""
    return motifs.join(texts, "motif_id", "left").orderBy(F.desc("frequency"), "motif_id").select("motif_id", F.concat_ws(" | ", F.col("motif_id").cast("string"), F.concat(F.col("frequency").cast("string"), F.lit(" graphs")), "text").alias("line"))
