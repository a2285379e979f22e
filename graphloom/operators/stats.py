"""Graph and dataset statistics, audits and evaluation (GA10-GA17, A01-A23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import half_even, hash_uniform
from graphloom.model import RELATIONS, ROOM_TYPES, RULES, GraphTables
from graphloom.operators import algorithms as A
from graphloom.operators.constraints import distinct_degree
from graphloom.operators.features import flatten, undirected
from graphloom.operators.metrics import multi_degree, source_degree
from graphloom.session import held_together


def relation_counts(g: GraphTables) -> DataFrame:
    """GA10, GA16, GA16b: (graph_id, relation, n, density) with all five relations; density over pairs of rooms, to 4 places."""
    name = F.concat_ws(">", F.lit("room"), "rel", "dst_kind").alias("relation")
    n = g.edges.groupBy("graph_id", name).agg(F.count("*").alias("n"))
    rooms = g.nodes.groupBy("graph_id").agg(F.count("*").alias("rooms"))
    every = rooms.select("graph_id", "rooms", F.explode(F.array(*[F.lit(r) for r in RELATIONS])).alias("relation"))
    out = every.join(n, ["graph_id", "relation"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = F.col("rooms") * (F.col("rooms") - 1) / 2
    return out.select("graph_id", "relation", "n", F.when(pairs > 0, F.bround(F.try_divide(F.col("n"), pairs), 4)).otherwise(0.0).alias("density"))


def links_both(simple: DataFrame) -> DataFrame:
    """Flattened edges (graph_id, a, b) in both directions as (graph_id, node, nbr)."""
    return simple.select("graph_id", F.col("a").alias("node"), F.col("b").alias("nbr")).union(simple.select("graph_id", "b", "a"))


def graph_summary(g: GraphTables) -> DataFrame:
    """GA11: counts, mean physical degree, density, components, mean clustering, and mean hops and diameter of the largest component."""
    simple = flatten(g.edges)
    links = links_both(simple)
    names = g.nodes.select("graph_id", F.col("room_id").alias("node")).union(g.env.select("graph_id", "env_id")).withColumn("nbr", F.lit(None).cast("long"))
    comp = A.components(links.unionByName(names))
    size = comp.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    top = size.groupBy("graph_id").agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("t"), F.count("*").alias("n_components"))
    largest = top.select("graph_id", (-F.col("t.c")).alias("component"))
    hops = A.component_paths(links).join(largest, ["graph_id", "component"]).select("graph_id", (F.col("hops") / F.col("pairs")).alias("apl"), "diameter")
    cc = names.select("graph_id", "node").join(A.clustering(links), ["graph_id", "node"], "left").groupBy("graph_id").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("clustering"))
    phys = links_both(simple.filter("etype = 'physical'")).groupBy("graph_id", F.col("node").alias("room_id")).agg(F.count("*").alias("d"))
    rooms = g.nodes.join(phys, ["graph_id", "room_id"], "left").groupBy("graph_id").agg(F.count("*").alias("n_rooms"), F.avg(F.coalesce("d", F.lit(0))).alias("avg_degree"))
    envs = g.env.groupBy("graph_id").agg(F.count("*").alias("n_env"))
    e = g.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count_if((F.col("dst_kind") == "room")).alias("n_rr"))
    out = rooms.join(envs, "graph_id", "left").join(e, "graph_id", "left").join(top.select("graph_id", "n_components"), "graph_id", "left").join(cc, "graph_id", "left").join(hops, "graph_id", "left")
    pairs = F.col("n_rooms") * (F.col("n_rooms") - 1) / 2
    rounded = lambda c, places: half_even(c * 10.0**places) / 10.0**places  # noqa: E731  # of the double, as the SQL: 2.175 is below the tie
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "graph_id", "n_rooms", z("n_env").alias("n_env"), z("n_edges").alias("n_edges"), rounded(F.col("avg_degree"), 2).alias("avg_degree"),
        rounded(F.try_divide(z("n_rr"), pairs), 4).alias("density"), "n_components", rounded(F.col("clustering"), 4).alias("clustering"),
        rounded(F.coalesce("apl", F.lit(0.0)), 2).alias("apl"), z("diameter").alias("diameter"),
    )


def type_distribution(g: GraphTables) -> DataFrame:
    """GA12."""
    return g.nodes.groupBy("graph_id", "room_type").agg(F.count("*").alias("n"))


def floor_distribution(g: GraphTables) -> DataFrame:
    """GA13: rooms by typical floor, told by the middle of their floor range."""
    from graphloom.functions import typical_floor_of

    mid = (F.col("floor_lo") + F.col("floor_hi")) / 2
    return g.nodes.groupBy("graph_id", typical_floor_of(mid).alias("typical_floor")).agg(F.count("*").alias("n"))


def daylight_rate(g: GraphTables) -> DataFrame:
    """GA14: the share of HIGH rooms with a sight edge at either end; 1 without such rooms."""
    s = g.view("sight")
    seen = s.select("graph_id", F.col("src").alias("room_id")).union(s.filter("dst_kind = 'room'").select("graph_id", "dst")).distinct().withColumn("ok", F.lit(1.0))
    r = g.nodes.filter("daylight >= 3").join(seen, ["graph_id", "room_id"], "left").groupBy("graph_id").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("r"))
    return g.graphs.select("graph_id").join(r, "graph_id", "left").select("graph_id", F.coalesce("r", F.lit(1.0)).alias("daylight_rate"))


def acoustic_rate(g: GraphTables, gap: int = 2) -> DataFrame:
    """GA15: over all pairs of a graph whose noise exceeds tolerance by gap, the share with an acoustic edge or two or more
    hops (or no path) in the flattened physical graph; 1 without pairs."""
    pairs = A.acoustic_mask(g.nodes, gap).filter("a < b")
    simple = flatten(g.edges)
    of = lambda t: simple.filter(F.col("etype") == t).select("graph_id", "a", "b").withColumn(t, F.lit(True))
    p = pairs.join(of("acoustic"), ["graph_id", "a", "b"], "left").join(of("physical"), ["graph_id", "a", "b"], "left")
    ok = F.col("acoustic").isNotNull() | F.col("physical").isNull()
    r = p.groupBy("graph_id").agg(F.avg(ok.cast("double")).alias("r"))
    return g.graphs.select("graph_id").join(r, "graph_id", "left").select("graph_id", F.coalesce("r", F.lit(1.0)).alias("acoustic_rate"))


def dataset_statistics(g: GraphTables) -> DataFrame:
    """(stat, value): rooms a graph, edges a category, rooms a type (none counts as 0), graphs, floors."""
    r = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.max(F.col("floor_lo") + 1).alias("floors"))
    rooms = r.agg(*[f("n").cast("double").alias(k) for k, f in {"rooms_mean": F.avg, "rooms_std": F.stddev_pop, "rooms_min": F.min, "rooms_max": F.max}.items()], F.avg("floors").alias("floors_mean"), F.count("*").cast("double").alias("graphs"))
    n = r.agg(F.count("*").alias("graphs"))
    e = g.edges.groupBy("rel").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select(F.concat(F.lit("edges_"), "rel").alias("stat"), (F.col("n") / F.col("graphs")).alias("value"))
    types = g.nodes.sparkSession.createDataFrame([(t,) for t in ROOM_TYPES], "room_type string")
    t = g.nodes.groupBy("room_type").agg(F.count("*").alias("n"))
    t = types.join(t, "room_type", "left").crossJoin(F.broadcast(n)).select(F.concat(F.lit("type_"), "room_type").alias("stat"), (F.coalesce("n", F.lit(0)) / F.col("graphs")).alias("value"))
    cols = rooms.columns
    long = rooms.select(F.expr(f"stack({len(cols)}, " + ", ".join(f"'{c}', {c}" for c in cols) + ") as (stat, value)"))
    return long.unionByName(e).unionByName(t)


def floor_audit(g: GraphTables) -> DataFrame:
    """(graph_id, floor_mid, n_phys, area, corridor_ratio, n_rooms, outliers, ratio_ok) for each floor middle.

    n_phys is inferred from the rank of the floor: the first and, of three or more, the last stand for one physical floor,
    those between share what num_floors leaves. Areas are divided by n_phys."""
    mid = half_even((F.col("floor_lo") + F.col("floor_hi")) / 2).cast("int")
    hall = F.when(F.col("room_type") == "corridor", F.col("area")).otherwise(0.0)
    odd = ((F.col("area") > 300) & (F.col("room_type") != "corridor")) | (F.col("area") < 3)
    f = g.nodes.groupBy("graph_id", mid.alias("floor_mid")).agg(F.sum("area").alias("total"), F.sum(hall).alias("hall"), F.count("*").alias("n_rooms"), F.count_if(odd).alias("outliers"))
    w = Window.partitionBy("graph_id")
    f = f.join(g.graphs.select("graph_id", "num_floors"), "graph_id").withColumn("k", F.dense_rank().over(w.orderBy("floor_mid"))).withColumn("m", F.count("*").over(w))
    span = F.when((F.col("k") == 1) | ((F.col("k") == F.col("m")) & (F.col("m") > 2)), 1).otherwise(
        F.greatest(F.lit(1), F.expr("(num_floors - if(m > 2, 2, 1)) div greatest(1, m - if(m > 2, 2, 1))")))
    lo, hi = RULES["floor_corridor"]
    ratio = F.coalesce(F.try_divide(F.col("hall"), F.col("total")), F.lit(0.0))
    return f.select("graph_id", "floor_mid", span.cast("int").alias("n_phys"), (F.col("total") / span).alias("area"), ratio.alias("corridor_ratio"), "n_rooms", "outliers", ratio.between(lo, hi).alias("ratio_ok"))


def audit_graphs(audit: DataFrame) -> DataFrame:
    """(graph_id, area, ratio, valid): the global corridor ratio and whether it and every floor's are in range."""
    lo, hi = RULES["floor_corridor"]
    a = audit.groupBy("graph_id").agg(F.sum("area").alias("area"), F.try_divide(F.sum(F.col("area") * F.col("corridor_ratio")), F.sum("area")).alias("ratio"), F.bool_and("ratio_ok").alias("floors_ok"), F.sum("outliers").alias("outliers"))
    return a.select("graph_id", "area", "ratio", "outliers", (F.col("floors_ok") & F.coalesce(F.col("ratio").between(lo, hi), F.lit(False))).alias("valid"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row over all graphs."""
    a = audit_graphs(audit)
    return a.agg(
        F.count("*").alias("graphs"), (100.0 * F.avg(F.col("valid").cast("double"))).alias("valid_pct"), F.avg("ratio").alias("ratio_mean"), F.stddev_pop("ratio").alias("ratio_std"),
        F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"), F.sum("outliers").alias("outliers"),
    )


def evaluate_connectivity(g: GraphTables) -> DataFrame:
    """Components with rooms, isolated rooms and bridges of the flattened physical graph; 100, or less 30 a component and 5 an isolated room."""
    phys = links_both(flatten(g.edges).filter("etype = 'physical'"))
    comp = A.components(phys.unionByName(g.nodes.select("graph_id", F.col("room_id").alias("node"), F.lit(None).cast("long").alias("nbr"))))
    rooms = g.nodes.select("graph_id", F.col("room_id").alias("node"))
    n = comp.join(rooms, ["graph_id", "node"], "left_semi").groupBy("graph_id").agg(F.countDistinct("component").alias("components"))
    iso = A.isolated(g.nodes, phys).groupBy("graph_id").agg(F.count("*").alias("isolated"))
    br = A.bridges(phys).groupBy("graph_id").agg(F.count("*").alias("bridges"))
    out = n.join(iso, "graph_id", "left").join(br, "graph_id", "left").select("graph_id", "components", F.coalesce("isolated", F.lit(0)).alias("isolated"), F.coalesce("bridges", F.lit(0)).alias("bridges"))
    whole = (F.col("components") <= 1) & (F.col("isolated") == 0)
    score = F.when(whole, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 30 * F.col("components") - 5 * F.col("isolated")))
    return out.withColumn("score", score).withColumn("passed", whole)


def _rated(g: GraphTables, rows: DataFrame, ok: Column, shown: int) -> DataFrame:
    """(graph_id, compliant, total, rate, score, passed, violations): the share of rows that are ok, 1 without rows; pass from
    0.95; the first rooms that fail."""
    r = rows.groupBy("graph_id").agg(F.count_if(ok).alias("compliant"), F.count("*").alias("total"), F.slice(F.sort_array(F.collect_list(F.when(~ok, F.col("room_id")))), 1, shown).alias("violations"))
    d = g.graphs.select("graph_id").join(r, "graph_id", "left")
    rate = F.coalesce(F.col("compliant") / F.col("total"), F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("graph_id", zero("compliant"), zero("total"), rate.alias("rate"), (100 * rate).alias("score"), (rate >= 0.95).alias("passed"), F.coalesce("violations", F.array().cast(r.schema["violations"].dataType)).alias("violations"))


def evaluate_fire(g: GraphTables) -> DataFrame:
    """The share of rooms of 50 persons with as many doors as exits, every edge counting; five that fail."""
    d = g.nodes.filter("occupancy >= 50").join(multi_degree(g.view("physical", "room")), ["graph_id", "room_id"], "left")
    return _rated(g, d, F.coalesce("d", F.lit(0)) >= F.greatest(F.lit(1), F.col("exits")), 5)


def evaluate_daylight(g: GraphTables) -> DataFrame:
    """The share of rooms of high daylight demand that a sight line starts from; three that fail."""
    d = g.nodes.filter("daylight >= 3").join(source_degree(g.view("sight")), ["graph_id", "room_id"], "left")
    return _rated(g, d, F.coalesce("d", F.lit(0)) >= 1, 3)


def evaluate_acoustic(g: GraphTables, gap: int = 2) -> DataFrame:
    """A10: (graph_id, adequate, total, rate, score, passed, violations) over pairs of rooms where one's noise exceeds the other's
    tolerance by `gap`: those with an acoustic edge, or two hops of doors or more apart (or not connected), are adequate.

    Pairs are counted by classes of noise and tolerance, of which there are at most 25; only pairs at a door can fail."""
    k = g.nodes.groupBy("graph_id", "noise", "tolerance").agg(F.count("*").alias("n"))
    side = lambda x: k.select("graph_id", F.col("noise").alias(f"n{x}"), F.col("tolerance").alias(f"t{x}"), F.col("n").alias(f"k{x}"))
    both = side("a").join(side("b"), "graph_id").filter("na < nb or (na = nb and ta <= tb)").filter(f"na - tb >= {gap} or nb - ta >= {gap}")
    n = F.when((F.col("na") == F.col("nb")) & (F.col("ta") == F.col("tb")), F.col("ka") * (F.col("ka") - 1) / 2).otherwise(F.col("ka") * F.col("kb"))
    total = both.groupBy("graph_id").agg(F.sum(n).cast("long").alias("total"))
    room = lambda x: g.nodes.select("graph_id", F.col("room_id").alias(x), F.col("noise").alias(f"n_{x}"), F.col("tolerance").alias(f"t_{x}"))
    near = undirected(g.view("physical", "room")).filter("node < nbr").join(room("node"), ["graph_id", "node"]).join(room("nbr"), ["graph_id", "nbr"])
    bad = near.filter(f"n_node - t_nbr >= {gap} or n_nbr - t_node >= {gap}").join(undirected(g.view("acoustic", "room")), ["graph_id", "node", "nbr"], "left_anti")
    bad = bad.groupBy("graph_id").agg(F.count("*").alias("bad"), F.slice(F.sort_array(F.collect_list(F.struct("node", "nbr"))), 1, 3).alias("violations"))
    d = g.graphs.select("graph_id").join(total, "graph_id", "left").join(bad, "graph_id", "left")
    all_, worse = F.coalesce("total", F.lit(0)), F.coalesce("bad", F.lit(0))
    rate = F.coalesce(F.try_divide(all_ - worse, all_), F.lit(1.0))
    return d.select("graph_id", (all_ - worse).alias("adequate"), all_.alias("total"), rate.alias("rate"), (100 * rate).alias("score"), (rate >= 0.95).alias("passed"), F.coalesce("violations", F.array().cast(bad.schema["violations"].dataType)).alias("violations"))


def _physical(g: GraphTables) -> tuple[DataFrame, DataFrame]:
    """The links of the flattened physical graph, and the same with a row of its own for every room and environment node."""
    phys = links_both(flatten(g.edges).filter("etype = 'physical'"))
    alone = g.nodes.select("graph_id", F.col("room_id").alias("node")).unionByName(g.env.select("graph_id", F.col("env_id").alias("node")))
    return phys, phys.unionByName(alone.withColumn("nbr", F.lit(None).cast("long")))


def evaluate_circulation(g: GraphTables) -> DataFrame:
    """(graph_id, corridor_ratio, avg_path, diameter, max_betweenness, bottlenecks, score, passed): mean and largest hops
    within the largest component of the flattened physical graph (of equally large ones that of the smallest node), the
    three rooms of largest betweenness; 100 less 30 for a ratio outside 0.10 to 0.30 and 10 for a mean over 8."""
    phys, whole = _physical(g)
    hall = F.sum(F.when(F.col("room_type") == "corridor", F.col("area")).otherwise(0.0))
    ratio = g.nodes.groupBy("graph_id").agg(F.coalesce(F.try_divide(hall, F.sum("area")), F.lit(0.0)).alias("corridor_ratio"), F.count("*").alias("rooms"))
    comp = A.components(whole)
    size = comp.groupBy("graph_id", "component").agg(F.count("*").alias("size"))
    top = size.groupBy("graph_id").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    path = A.component_paths(phys).join(top, ["graph_id", "component"]).select("graph_id", (F.col("hops") / F.col("pairs")).alias("avg_path"), "diameter")
    bc = A.betweenness(whole).join(g.nodes.select("graph_id", F.col("room_id").alias("node"), F.lit(True).alias("room")), ["graph_id", "node"], "left")
    first = F.sort_array(F.collect_list(F.when(F.col("room"), F.struct((-F.round("bc", 9)).alias("o"), "node"))))
    bc = bc.groupBy("graph_id").agg(F.max("bc").alias("max_betweenness"), F.transform(F.slice(first, 1, 3), lambda x: x["node"]).alias("bottlenecks"))
    d = ratio.join(path, "graph_id", "left").join(bc, "graph_id", "left")
    ok, far = F.col("corridor_ratio").between(0.10, 0.30), F.coalesce(F.when(F.col("rooms") >= 2, F.col("avg_path")), F.lit(0.0))
    score = 100.0 - F.when(ok, 0.0).otherwise(30.0) - F.when(far > 8, 10.0).otherwise(0.0)
    return d.select("graph_id", "corridor_ratio", far.alias("avg_path"), F.coalesce(F.when(F.col("rooms") >= 2, F.col("diameter")), F.lit(0)).alias("diameter"), F.coalesce("max_betweenness", F.lit(0.0)).alias("max_betweenness"), "bottlenecks", score.alias("score"), ok.alias("passed"))


def evaluate_diversity(g: GraphTables) -> DataFrame:
    """Entropy (nats) of the rooms' degrees in the flattened physical graph, 0 included, mean clustering over all its nodes;
    score min(100, 40 H + 50 C), pass from H >= 1."""
    phys, _ = _physical(g)
    have = phys.groupBy("graph_id", F.col("node").alias("room_id")).agg(F.count("*").alias("d"))
    deg = g.nodes.select("graph_id", "room_id").join(have, ["graph_id", "room_id"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    k = deg.groupBy("graph_id", "d").agg(F.count("*").alias("k"))
    p = F.col("k") / F.sum("k").over(Window.partitionBy("graph_id"))
    h = k.withColumn("p", p).groupBy("graph_id").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.min("d").alias("d_min"), F.max("d").alias("d_max"))
    n = g.nodes.select("graph_id").unionAll(g.env.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("n"))
    c = A.clustering(phys).groupBy("graph_id").agg(F.sum("c").alias("c"))
    d = h.join(n, "graph_id").join(c, "graph_id", "left").withColumn("clustering", F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)))
    return d.select("graph_id", "entropy", "clustering", "d_min", "d_max", F.least(F.lit(100.0), 40 * F.col("entropy") + 50 * F.col("clustering")).alias("score"), (F.col("entropy") >= 1).alias("passed"))


EVALUATORS = {"connectivity": evaluate_connectivity, "fire_safety": evaluate_fire, "daylight": evaluate_daylight, "acoustic": evaluate_acoustic, "circulation": evaluate_circulation, "diversity": evaluate_diversity}


def evaluate_all(g: GraphTables) -> DataFrame:
    """(graph_id, a score of each evaluator, overall, grade): overall is the mean of the six scores.

    Each evaluator's scores are written before they are joined: planned as one, the six take most of the time on the driver."""
    out = g.graphs.select("graph_id")
    for part in held_together(g.graphs.sparkSession, [lambda name=name, f=f: f(g).select("graph_id", F.col("score").alias(name)) for name, f in EVALUATORS.items()]):
        out = out.join(part, "graph_id", "left")
    out = out.withColumn("overall", reduce(lambda a, b: a + b, [F.col(n) for n in EVALUATORS]) / len(EVALUATORS))
    return out.withColumn("grade", grade(F.col("overall")))


def grade(score: Column) -> Column:
    """A from 85, B from 70, C from 50, else D."""
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def score_report(scores: DataFrame) -> DataFrame:
    """Five bins of (graph_id, score) with counts, and the mean and population deviation over all."""
    edges = [0, 30, 50, 70, 85, 101]
    b = F.coalesce(*[F.when((F.col("score") >= lo) & (F.col("score") < hi), F.lit(f"[{lo},{hi})")) for lo, hi in zip(edges, edges[1:], strict=False)], F.lit("out"))
    n = scores.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    whole = scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return n.crossJoin(F.broadcast(whole))


def best_and_worst(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best and worst graphs; ties by graph_id."""
    top = scores.orderBy(F.desc("score"), "graph_id").limit(k).withColumn("side", F.lit("best"))
    return top.unionByName(scores.orderBy("score", "graph_id").limit(k).withColumn("side", F.lit("worst")))


def violation_stats(status: DataFrame) -> DataFrame:
    """Over graphs, the mean, median, least and most violations."""
    v = status.groupBy("graph_id").agg(F.sum("n_violations").alias("v"))
    return v.agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.min("v").alias("least"), F.max("v").alias("most"))


def failure_table(status: DataFrame) -> DataFrame:
    """Passed, failed, pass % and all violations of each constraint."""
    return status.groupBy("constraint").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), (100.0 * F.avg(F.col("passed").cast("double"))).alias("pass_pct"), F.sum("n_violations").alias("violations"))


def pass_histogram(status: DataFrame) -> DataFrame:
    """How many graphs pass how many constraints."""
    return status.groupBy("graph_id").agg(F.count_if("passed").alias("n_passed")).groupBy("n_passed").agg(F.count("*").alias("graphs"))


def split_balance(graphs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per split (graph_id, split): graphs, mean, population deviation and lower median of the score."""
    return graphs.join(scores, "graph_id").groupBy("split").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.expr("percentile_disc(0.5) within group (order by score)").alias("median"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, R2, Pearson r, MSE and MAE of the fit, MSE of the mean."""
    c = lambda n: F.col(n).cast("double")
    fit = df.agg(F.regr_slope(c(y), c(x)).alias("slope"), F.regr_intercept(c(y), c(x)).alias("intercept"), F.regr_r2(c(y), c(x)).alias("r2"), F.corr(c(x), c(y)).alias("r"), F.avg(c(y)).alias("mean"))
    e = c(y) - (F.col("slope") * c(x) + F.col("intercept"))
    return df.crossJoin(F.broadcast(fit)).groupBy("slope", "intercept", "r2", "r").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.pow(c(y) - F.col("mean"), 2)).alias("mse_mean"))


def score_audit(rows: DataFrame) -> DataFrame:
    """Per split of (split, score), and over `all`: count, mean, sample deviation, least, most, lower median, distinct scores to
    four places, scores of 1 and of at least 0.83."""
    s = F.col("score")
    both = rows.select(F.explode(F.array("split", F.lit("all"))).alias("split"), "score")
    return both.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"),
        F.expr("percentile_disc(0.5) within group (order by score)").alias("median"), F.countDistinct(F.round(s, 4)).alias("distinct_scores"),
        F.count_if(s == 1).alias("perfect"), F.count_if(s >= 0.83).alias("high"),
    )


def model_audit(rows: DataFrame, seed: int = 42) -> DataFrame:
    """One row over (key, x, pred, target): errors of the predictions beside those of the mean, of random numbers by hash and of a
    line through x, what the model gains on the mean and on the line (%), correlation, how many errors are small, and the deviations' ratio."""
    e, t = F.col("pred") - F.col("target"), F.col("target")
    fit = rows.agg(F.avg("target").alias("mean"), F.regr_slope("target", "x").alias("slope"), F.regr_intercept("target", "x").alias("intercept"))
    d = rows.crossJoin(F.broadcast(fit)).withColumn("error", F.abs(e))  # one row
    square = lambda c: F.avg(F.pow(c, 2))
    out = d.agg(
        F.count("*").alias("n"), square(e).alias("mse"), F.avg("error").alias("mae"), square(t - F.col("mean")).alias("mse_mean"),
        square(t - hash_uniform(seed, F.col("key"), "baseline")).alias("mse_random"), square(t - F.col("intercept") - F.col("slope") * F.col("x")).alias("mse_line"),
        F.corr("pred", "target").alias("corr"), (F.stddev_samp("pred") / F.stddev_samp("target")).alias("spread"),
        *[F.count_if(F.col("error") < c).alias(f"under_{round(100 * c):02d}") for c in (0.05, 0.10, 0.15)], F.count_if(F.col("error") >= 0.20).alias("over_20"),
    )
    gain = lambda base: F.try_divide(100 * (F.col(base) - F.col("mse")), F.col(base))
    return out.withColumns({"r2": 1 - F.try_divide(F.col("mse"), F.col("mse_mean")), "gain_mean": gain("mse_mean"), "gain_line": gain("mse_line")})


def type_variation(g: GraphTables) -> DataFrame:
    """Mean, sample deviation and coefficient of variation of each type's count over graphs (absent counts as 0)."""
    n = g.graphs.select("graph_id").distinct()
    types = g.nodes.select("room_type").distinct()
    k = g.nodes.groupBy("graph_id", "room_type").agg(F.count("*").alias("k"))
    k = n.crossJoin(F.broadcast(types)).join(k, ["graph_id", "room_type"], "left").withColumn("k", F.coalesce("k", F.lit(0)))  # at most 13 types
    return k.groupBy("room_type").agg(F.avg("k").alias("mean"), F.stddev_samp("k").alias("std"), (F.stddev_samp("k") / (F.avg("k") + 1e-8)).alias("cv"), F.min("k").alias("least"), F.max("k").alias("most"))


def task_report(long: DataFrame) -> DataFrame:
    """Per task of (task, pred, target): R2 (0 if the targets do not vary), MAE and means."""
    m = long.groupBy("task").agg(F.avg("target").alias("t"))
    d = long.join(F.broadcast(m), "task")  # one row a task
    ss, tot = F.sum(F.pow(F.col("pred") - F.col("target"), 2)), F.sum(F.pow(F.col("target") - F.col("t"), 2))
    return d.groupBy("task").agg(F.when(tot > 0, 1 - F.try_divide(ss, tot)).otherwise(0.0).alias("r2"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.avg("pred").alias("mean_pred"), F.avg("target").alias("mean_target"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the last is closed; values outside are left out."""
    v = F.col(col)
    b = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int")
    return df.filter(v.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of row by col as a table, 0 where there are none."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def degree_histogram(g: GraphTables, rel: str) -> DataFrame:
    """How many rooms have how many distinct neighbours over a relation."""
    d = g.nodes.select("graph_id", "room_id").join(distinct_degree(g.view(rel)), ["graph_id", "room_id"], "left")
    return d.groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count("*").alias("n"))
