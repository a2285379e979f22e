"""Storage of graph collections and of reports (SC06-SC16, SK01-SK12), on any file system that Spark reaches."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.model import GraphTables
from graphloom.operators.features import env_features, room_features, schema_errors

PARTS = ("graphs", "nodes", "env", "edges")


def save_graphs(g: GraphTables, path: str, mode: str = "error") -> str:
    """SK01-SK04: one table a part below path, partitioned by `split`; graphs get saved_at and their numbers of rooms and environment nodes.

    There is no second raw copy: it is the table without a filter."""
    graphs = g.graphs if "split" in g.graphs.columns else g.graphs.withColumn("split", F.lit("all"))
    rooms = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n_rooms"))
    envs = g.env.groupBy("graph_id").agg(F.count("*").alias("n_env"))
    graphs = graphs.join(rooms, "graph_id", "left").join(envs, "graph_id", "left").withColumn("saved_at", F.lit(datetime.datetime.now(datetime.UTC).isoformat()))
    split = graphs.select("graph_id", F.col("split"))
    for name, df in (("graphs", graphs), ("nodes", g.nodes), ("env", g.env), ("edges", g.edges)):
        out = df if name == "graphs" else df.drop("split").join(split, "graph_id")
        out.write.mode(mode).partitionBy("split").parquet(f"{path}/{name}")
    return path


def load_graphs(spark: SparkSession, path: str, split: str | None = None, graph_id=None, validate: bool = False) -> GraphTables:
    """SC06-SC08, SC10: the tables of a collection, of one split (partitions pruned) or one graph.

    A missing path fails as Spark's reader does; ValueError for an empty split or, with `validate`, schema errors."""
    t = {p: spark.read.parquet(f"{path}/{p}") for p in PARTS}
    if split is not None:
        t = {k: v.filter(F.col("split") == split) for k, v in t.items()}
    if graph_id is not None:
        t = {k: v.filter(F.col("graph_id") == graph_id) for k, v in t.items()}
    g = GraphTables(**t)
    if g.graphs.isEmpty():
        raise ValueError(f"no graphs in {path}, split {split}")
    if validate and not (bad := schema_errors(room_features(g.nodes), env_features(g.env), g).limit(1)).isEmpty():
        raise ValueError(f"schema errors, first {bad.first()}")
    return g


def labels(metrics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """SC09: (graph_id, label): the mean quality if there is one, else the share of constraints passed, else 0.5."""
    q = metrics.groupBy("graph_id").agg(F.avg("value").alias("q"))
    return verdicts.join(q, "graph_id", "full").select("graph_id", F.coalesce("q", "pass_fraction", F.lit(0.5)).alias("label"))


def score_statistics(scores: DataFrame, n: int | None = None) -> DataFrame:
    """SC15: count, mean, sample deviation, minimum and maximum of the score, of the first n graphs by id if given."""
    s = scores.orderBy("graph_id").limit(n) if n else scores
    return s.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("least"), F.max("score").alias("most"))


def first_matches(graphs: DataFrame, wanted: tuple[tuple[int, int, int], ...] = ((3, 40, 70), (4, 65, 95), (5, 80, 10**9)), n: int = 3) -> DataFrame:
    """SC16: for each wanted (least floors, least rooms, most rooms) the first graph by id, filled up to n with others."""
    case = F.coalesce(*[F.when((F.col("num_floors") >= f) & F.col("n_rooms").between(a, b), i) for i, (f, a, b) in enumerate(wanted)])
    w = Window.partitionBy("want").orderBy("graph_id")
    d = graphs.withColumn("want", case).withColumn("k", F.when(F.col("want").isNotNull(), F.row_number().over(w)))
    return d.orderBy(F.when(F.col("k") == 1, 0).otherwise(1), "graph_id").limit(n).select("graph_id", "num_floors", "n_rooms")


def seeded_pick(graphs: DataFrame, by: str = "school_size", seed: int = 42) -> DataFrame:
    """SC17: one graph of each group, by hash."""
    w = Window.partitionBy(by).orderBy(hash_uniform(seed, F.col("graph_id")), "graph_id")
    return graphs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def thin_floor(nodes: DataFrame, most: int = 40, keep: int = 36, seed: int = 42) -> DataFrame:
    """SC17: on floors of more than `most` rooms, `keep` others by hash and all corridors; areas over the floors they span."""
    f = Window.partitionBy("graph_id", "typical_floor")
    hall = F.col("room_type") == "corridor"
    k = F.row_number().over(Window.partitionBy("graph_id", "typical_floor", hall).orderBy(hash_uniform(seed, F.col("graph_id"), F.col("room_id")), "room_id"))
    d = nodes.withColumn("_n", F.count("*").over(f)).withColumn("_k", k)
    return d.filter(hall | (F.col("_n") <= most) | (F.col("_k") <= keep)).drop("_n", "_k")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SK05-SK09: rows as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def write_text(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> str:
    """SK08, SK11."""
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)
    return path


def metadata(config: dict, statistics: DataFrame, splits: DataFrame) -> str:
    """SC12, SK05: the metadata document: configuration, statistics (stat, value; a few dozen rows), and graphs a split."""
    s = {r["stat"]: r["value"] for r in statistics.collect()}
    n = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return json.dumps({"config": config, "statistics": s, "split_info": {k: {"count": v} for k, v in sorted(n.items())}, "saved_at": datetime.datetime.now(datetime.UTC).isoformat()}, sort_keys=True)


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SC12, SC13."""
    return spark.read.option("multiLine", multi_line).json(path)


def motif_patterns(spark: SparkSession, path: str | None) -> DataFrame:
    """SC13: (motif_id, room_type, mean) of a motif dictionary's compositions; the default patterns where there is no path."""
    from graphloom.operators.layout import default_patterns

    if path is None:
        return default_patterns(spark).select(F.col("pattern").alias("motif_id"), "room_type", F.col("count").cast("double").alias("mean"))
    d = spark.read.option("multiLine", True).schema("motifs array<struct<motif_id:string,room_composition:map<string,double>>>").json(path)
    m = d.select(F.explode("motifs").alias("m"))
    return m.select("m.motif_id", F.explode("m.room_composition").alias("room_type", "mean"))


def graph_documents(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """SK10: (graph_id, document): node and edge lists of each graph as JSON; the type is the label before the first underscore."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("room_id", "room_type"))).alias("nodes"))
    e = simple.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", F.coalesce("etype", F.lit("physical_connects")).alias("edge_type")))).alias("edges"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "edges")).alias("document"))


def motif_documents(motifs: DataFrame) -> DataFrame:
    """SK09: motifs (motif_id, name, frequency, percentage, avg_nodes, room_composition) as JSON, percentages to 4 places, sizes to 1."""
    c = {"percentage": F.bround("percentage", 4), "avg_nodes": F.bround("avg_nodes", 1)}
    return motifs.select("motif_id", F.to_json(F.struct(*[c.get(x, F.col(x)).alias(x) for x in motifs.columns])).alias("document"))
