"""Labels and losses of scoring (L04b, L06-L11, SC09); the network is in network.py, its training in training.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import GraphTables
from graphloom.operators.metrics import doors, multi_degree, source_degree


def fire_exit_loss(g: GraphTables) -> DataFrame:
    """Mean over rooms of 50 persons of the exits they lack; 0 without such rooms."""
    d = g.nodes.filter("occupancy >= 50").join(multi_degree(doors(g)), ["graph_id", "room_id"], "left")
    r = d.groupBy("graph_id").agg(F.avg(F.greatest(F.lit(0), F.col("exits") - F.coalesce("d", F.lit(0)))).alias("loss"))
    return g.graphs.select("graph_id").join(r, "graph_id", "left").select("graph_id", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def circulation_loss(g: GraphTables) -> DataFrame:
    """How far the corridor share is below 0.10 or above 0.30."""
    hall = F.sum(F.when(F.col("room_type") == "corridor", F.col("area")).otherwise(0.0))
    r = F.coalesce(F.try_divide(hall, F.sum("area")), F.lit(0.0))
    return g.nodes.groupBy("graph_id").agg((F.greatest(F.lit(0.0), 0.10 - r) + F.greatest(F.lit(0.0), r - 0.30)).alias("loss"))


def daylight_loss(g: GraphTables) -> DataFrame:
    """The share of HIGH rooms without a sight edge of their own; 0 without such rooms."""
    d = g.nodes.filter("daylight >= 3").join(source_degree(g.view("sight")), ["graph_id", "room_id"], "left")
    r = d.groupBy("graph_id").agg(F.avg(F.greatest(F.lit(0), 1 - F.coalesce("d", F.lit(0)))).alias("loss"))
    return g.graphs.select("graph_id").join(r, "graph_id", "left").select("graph_id", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def connectivity_loss(g: GraphTables) -> DataFrame:
    """How far algebraic connectivity is below 0.05; 0.5 without an edge."""
    from graphloom.operators.algorithms import lambda2

    e = doors(g).filter("src <> dst").groupBy("graph_id", F.col("src").alias("node"), F.col("dst").alias("nbr")).agg(F.count("*").cast("double").alias("w"))
    l2 = lambda2(e.unionByName(g.nodes.select("graph_id", F.col("room_id").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(0.0).alias("w"))))
    some = e.select("graph_id").distinct().withColumn("has", F.lit(True))
    return l2.join(some, "graph_id", "left").select("graph_id", F.when(F.col("has").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 0.05 - F.col("l2"))).alias("loss"))


def ranking_loss(rows: DataFrame, margin: float = 0.05, compat: bool = False) -> DataFrame:
    """(task, pairs, loss) over (task, item, pred, target): mean of max(0, margin - difference of predictions) over
    pairs of different targets, better target first; compat has the sign the original inverts."""
    a = rows.select("task", F.col("pred").alias("pa"), F.col("target").alias("ta"))
    b = rows.select("task", F.col("pred").alias("pb"), F.col("target").alias("tb"))
    diff = (F.col("pb") - F.col("pa")) if compat else (F.col("pa") - F.col("pb"))
    return a.join(b, "task").filter("ta > tb").groupBy("task").agg(F.count("*").alias("pairs"), F.avg(F.greatest(F.lit(0.0), margin - diff)).alias("loss"))


def multitask_mse(rows: DataFrame) -> DataFrame:
    """The sum over tasks of the mean squared error of (task, pred, target); 0 without rows."""
    per = rows.groupBy("task").agg(F.avg(F.pow(F.col("pred") - F.col("target"), 2)).alias("mse"))
    return per.agg(F.coalesce(F.sum("mse"), F.lit(0.0)).alias("loss"))


def pass_label(quality: Column, fraction: Column) -> Column:
    """SC09: the label: quality if there is one, else the share of constraints passed, else 0.5."""
    return F.coalesce(quality, fraction, F.lit(0.5))
