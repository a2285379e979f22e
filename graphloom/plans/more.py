"""Registered queries of mining, explanation, scoring, layout and generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.model import CATALOG, NOISE, ROOM_TYPES, SPEC_SCHEMA, catalog
from graphloom.operators import explain as X
from graphloom.operators import features as P
from graphloom.operators import generate as G
from graphloom.operators import layout as Y
from graphloom.operators import metrics as M
from graphloom.operators import mining as K
from graphloom.operators import network as N
from graphloom.operators import scoring as L
from graphloom.operators import stats as S
from graphloom.operators import training as T
from graphloom.plans.catalogue import LAMBDA2, on_events, query, r6, written
from graphloom.plans.prelude import sql, u
from graphloom.session import held, held_together

# Kernels and patterns ------------------------------------------------------------------------------
_L0 = {"l0": "select graph_id, room_id as node, room_type as label from nodes"}
for _k in (1, 2, 3):
    _L0[f"l{_k}"] = f"select l.graph_id, l.node, substr(md5(l.label || '|' || coalesce(a.around, '')), 1, 12) as label from l{_k - 1} l left join (select d.graph_id, d.node, string_agg(x.label, ',' order by x.label) as around from door d join l{_k - 1} x on x.graph_id = d.graph_id and x.node = d.nbr group by 1, 2) a using (graph_id, node)"
_HIST = _L0 | {"hist": " union all ".join(f"select graph_id, ('0x' || substr(md5(label), 1, 8))::bigint % 100 + {100 * k} as bin, count(*) as n from l{k} group by 1, 2" for k in range(4))}


def _labels(g):
    return g.nodes.select("graph_id", F.col("room_id").alias("node"), F.col("room_type").alias("label"))


def _doors(g):
    return P.undirected(g.view("physical"))


for _k in (1, 2, 3):

    def _round(g, k=_k):
        lab = _labels(g)
        for _ in range(k):
            lab = K.refine(lab, _doors(g))
        return lab

    _round.__name__ = f"wl_labels_h{_k}"
    on_events(sql("nodes door", f"select graph_id, node, label from l{_k}", **_L0))(_round)


@on_events(sql("nodes door", "select graph_id, bin, n from hist", **_HIST), doors=True)
def wl_histogram(g):
    """X16."""
    return K.wl_histogram(_labels(g), _doors(g))


@on_events(sql("nodes door", "select a.graph_id as g1, b.graph_id as g2, round(case when a.graph_id = b.graph_id then sum(a.n * b.n)::double else sum(a.n * b.n) / (na.m * nb.m) end, 6) as k from hist a join hist b using (bin) join nm na on na.graph_id = a.graph_id join nm nb on nb.graph_id = b.graph_id group by a.graph_id, b.graph_id, na.m, nb.m", **_HIST, nm="select graph_id, sqrt(sum(n * n)) + 1e-8 as m from hist group by 1"), doors=True)
def wl_kernel(g):
    """X18."""
    return K.kernel_matrix(K.wl_histogram(_labels(g), _doors(g))).select("g1", "g2", r6("k"))


_PAT = {
    "lb": "select graph_id, room_id as node, room_type as l from nodes",
    "two": "select d.graph_id, 2::bigint as size, array_to_string(list_sort([a.l || ':' || b.l, b.l || ':' || a.l]), ';') as form from door d join lb a on a.graph_id = d.graph_id and a.node = d.node join lb b on b.graph_id = d.graph_id and b.node = d.nbr where d.node < d.nbr",
    "wd": "select x.graph_id, x.node as m, x.nbr as a, y.nbr as b, exists (select 1 from door z where z.graph_id = x.graph_id and z.node = x.nbr and z.nbr = y.nbr) as closed from door x join door y on x.graph_id = y.graph_id and x.node = y.node and x.nbr < y.nbr",
    "three": "select w.graph_id, 3::bigint as size, array_to_string(list_sort(case when closed then [a.l || ':' || array_to_string(list_sort([m.l, b.l]), ','), b.l || ':' || array_to_string(list_sort([m.l, a.l]), ','), m.l || ':' || array_to_string(list_sort([a.l, b.l]), ',')] else [a.l || ':' || m.l, b.l || ':' || m.l, m.l || ':' || array_to_string(list_sort([a.l, b.l]), ',')] end), ';') as form from wd w join lb a on a.graph_id = w.graph_id and a.node = w.a join lb b on b.graph_id = w.graph_id and b.node = w.b join lb m on m.graph_id = w.graph_id and m.node = w.m where not closed or w.m < w.a",
    "pt": "select graph_id, size, substr(md5(form), 1, 16) as canonical, form, count(*) as n from (select * from two union all select * from three) group by 1, 2, 3, 4",
}


@on_events(sql("nodes door", "select graph_id, size, canonical, n from pt", **_PAT))
def induced_patterns_k2_k3(g):
    """X29, X30."""
    return K.patterns(_labels(g), _doors(g)).select("graph_id", "size", "canonical", "n")


_FQ = _PAT | {
    "sc": "select graph_id, avg(area) / 100 as score from nodes group by 1",
    "fq": "select canonical, size, form, count(distinct graph_id) as support, count(distinct graph_id) as occurrences, count(distinct graph_id) / (select count(*) from sc) as percentage, avg(score) as avg_score, len(list_distinct(list_transform(string_split(form, ';'), lambda x: string_split(x, ':')[1]))) as diversity from pt join sc using (graph_id) group by 1, 2, 3 having count(distinct graph_id) >= 6",
}


@on_events(sql("nodes door", "select canonical, support, occurrences, round(percentage, 6) as percentage, round(avg_score, 6) as avg_score, diversity::bigint as diversity, round(support * (1 + avg_score) * (1 + 0.1::double * diversity), 6) as rank_score from fq order by round(support * (1 + avg_score) * (1 + 0.1::double * diversity), 9) desc, canonical limit 15", **_FQ))
def frequent_patterns(g):
    """A top-k report."""
    sc = g.nodes.groupBy("graph_id").agg((F.avg("area") / 100).alias("score"))
    return K.frequent(K.patterns(_labels(g), _doors(g)), sc).select("canonical", "support", "occurrences", r6("percentage"), r6("avg_score"), "diversity", r6("rank_score"))


@on_events()
def pattern_dedup(g):
    """X31 over the top patterns."""
    sc = g.nodes.groupBy("graph_id").agg((F.avg("area") / 100).alias("score"))
    top = K.frequent(K.patterns(_labels(g), _doors(g)), sc)
    w = Window.orderBy(F.desc(F.round("rank_score", 9)), "canonical")
    return K.dedup(top.select(F.col("canonical").alias("pattern"), F.row_number().over(w).cast("long").alias("rank"), F.split("form", ";").alias("items"))).select("pattern", "rank")


@on_events()
def sampled_subgraphs(g):
    """X29 beyond three nodes, counted by size."""
    return K.sample_connected(_labels(g), _doors(g)).groupBy("graph_id", F.size("nodes").alias("size")).agg(F.count("*").alias("n"))


_COMP = ", ".join(f"sum((room_type = '{t}')::int)::double as {t}" for t in ("classroom", "corridor", "staircase", "toilet", "music_room"))
_NAME = "case when music_room >= 0.5 and classroom >= 2 then '动静分区模体' when classroom >= 2 and corridor >= 1 and staircase >= 0.5 then '教学翼标准模体' when classroom >= 2 and corridor >= 1 then '教室-走廊模体' when toilet >= 1 and staircase >= 0.5 and corridor >= 1 then '公共服务核模体' when staircase >= 0.5 and corridor >= 1 then '垂直交通核模体' when corridor >= 1 then '走廊脊柱模体' else '复合功能模体' end"
_REFS = "array_to_string(list_sort(list_filter([case when classroom >= 1 then 'GB50099-2011 §5.1 采光' end, case when classroom >= 1 then 'GB50016-2014 §5.5 消防' end, case when music_room >= 0.5 then 'GB50099-2011 §7.3 声学' end, case when staircase >= 0.5 then 'GB50016-2014 §5.5.17 疏散' end, case when corridor >= 1 then 'GB50099-2011 §8.2.3 走廊比' end], lambda x: x is not null)), ',')"
_CN = {"classroom": "教室", "corridor": "走道", "staircase": "楼梯间", "toilet": "卫生间", "music_room": "音乐教室"}
_TOP = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'o': -{t}, 't': '{t}', 'n': '{n}'}}" for t, n in _CN.items()) + "], lambda x: x.o < 0))[1:2], lambda x: x.n), '·') || '组合'"
_PNAME = f"case when classroom >= 1 and corridor >= 1 and staircase >= 0.5 then classroom::int || '教室教学单元' when staircase >= 0.5 and toilet >= 0.5 and corridor >= 1 then '交通服务核' when music_room >= 0.5 and classroom >= 1 then '动静分区单元' when classroom >= 1 then classroom::int || '教室集群' else {_TOP} end"


@on_events(sql("nodes", f"select graph_id, typical_floor, {_NAME} as name, {_PNAME} as pattern, {_REFS} as refs from c", c=f"select graph_id, typical_floor, {_COMP} from nodes group by 1, 2"))
def motif_names(g):
    """X23, X24, X32 over the composition of each typical floor."""
    c = g.nodes.groupBy("graph_id", "typical_floor", "room_type").agg(F.count("*").cast("double").alias("n"))
    c = c.groupBy("graph_id", "typical_floor").agg(F.map_from_entries(F.collect_list(F.struct("room_type", "n"))).alias("comp"))
    m = F.col("comp")
    return c.select("graph_id", "typical_floor", K.motif_name(m).alias("name"), K.pattern_name(m).alias("pattern"), F.array_join(K.constraint_refs(m), ",").alias("refs"))


_MEM = {"mem": "select graph_id, graph_id % 5 as cluster from graphs"}


@on_events(sql("nodes graphs", "select cluster, room_type as label, round(avg(n), 6) as mean, count(*) as graphs from (select graph_id, room_type, count(*) as n from nodes group by 1, 2) join mem using (graph_id) group by 1, 2", **_MEM))
def motif_prototypes(g):
    """X22 for five given clusters."""
    m = g.graphs.select("graph_id", (F.col("graph_id") % 5).alias("cluster"))
    return K.prototypes(m, S.type_distribution(g).withColumnRenamed("room_type", "label")).select("cluster", "label", r6("mean"), "graphs")


@on_events(sql("simple graphs", "select cluster, label, round(avg(n), 6) as mean, count(*) as graphs from (select graph_id, etype as label, count(*) as n from simple group by 1, 2) join mem using (graph_id) group by 1, 2", **_MEM))
def motif_edge_prototypes(g):
    """Edge compositions of five given clusters."""
    m = g.graphs.select("graph_id", (F.col("graph_id") % 5).alias("cluster"))
    n = P.flatten(g.edges).groupBy("graph_id", F.col("etype").alias("label")).agg(F.count("*").alias("n"))
    return K.prototypes(m, n).select("cluster", "label", r6("mean"), "graphs")


_PAIRS = {
    "nm": "select graph_id, sqrt(sum(n * n)) + 1e-8 as m from hist group by 1",
    "kk": "select p.cluster, a.graph_id, case when a.graph_id = b.graph_id then sum(a.n * b.n)::double else sum(a.n * b.n) / (na.m * nb.m) end as k from hist a join hist b using (bin) join mem p on p.graph_id = a.graph_id join mem q on q.graph_id = b.graph_id and p.cluster = q.cluster join nm na on na.graph_id = a.graph_id join nm nb on nb.graph_id = b.graph_id group by p.cluster, a.graph_id, b.graph_id, na.m, nb.m",
}


@on_events(sql("nodes door graphs", "select cluster, graph_id from (select cluster, graph_id, row_number() over (partition by cluster order by round(sum(k), 6) desc, graph_id) as r from kk group by 1, 2) where r = 1", **_HIST, **_MEM, **_PAIRS), doors=True)
def motif_centroids(g):
    """The middle graphs of five given clusters."""
    m = g.graphs.select("graph_id", (F.col("graph_id") % 5).alias("cluster"))
    return K.histogram_centroids(m, held(K.wl_histogram(_labels(g), _doors(g))))


@on_events(sql("graphs", "select row_number() over (order by count(*) desc, cluster) - 1 as motif_id, cluster, count(*) as frequency, round(count(*) / (select count(*) from mem), 6) as percentage from mem group by cluster having count(*) >= 2", **_MEM))
def motif_frequencies(g):
    """X19's numbering."""
    m = g.graphs.select("graph_id", (F.col("graph_id") % 5).alias("cluster"))
    return K.motifs(m).select("motif_id", "cluster", "frequency", r6("percentage"))


@on_events(doors=True)
def spectral_clusters(g):
    """X19, X20."""
    return K.histogram_clusters(K.wl_histogram(_labels(g), _doors(g)), 5)


@query()
def kmeans(spark: SparkSession, sf_dir: str):
    """X21 over the embeddings."""
    return K.kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 10).select("vec_id", F.col("cluster").cast("long").alias("cluster"))


# Explanation ---------------------------------------------------------------------------------------
def _packed(g, tasks=N.TASKS):
    """The graphs packed for the network, with the metrics as targets and a split by hash."""
    g = written(g)
    scores = reduce(DataFrame.unionByName, held_together(g.nodes.sparkSession, [lambda m=m: M.compute_all(g, (m,)) for m in M.WEIGHTS]))
    goal = scores.unionByName(M.aggregate(scores).select("graph_id", F.lit("overall_quality").alias("metric"), F.col("score").alias("value")))
    goal = goal.filter(F.col("metric").isin(*tasks)).select("graph_id", F.col("metric").alias("task"), F.col("value").alias("target"))
    u7 = hash_uniform(7, F.col("graph_id"), "split")
    packed = T.pack(_typed(g), g.edges.filter("dst_kind = 'room'"), goal, tasks)
    packed = packed.withColumn("split", F.when(u7 < 0.7, "train").when(u7 < 0.85, "val").otherwise("test"))
    # Rows are few and small, but take long: without a number of partitions, all may come into one file, which one task reads.
    return held(packed.repartition(4 * g.nodes.sparkSession.sparkContext.defaultParallelism, "graph_id"))


def _typed(g):
    return P.room_features(g.nodes, "room_type")


@on_events()
def mcts_subgraphs(g):
    """The found states of two heads of a network with seeded weights."""
    packed = T.pack(_typed(g), g.edges.filter("dst_kind = 'room'"))
    f = X.search_graphs(packed, N.Network(hidden=32), ("overall_quality", "zone_cohesion"))
    return f.select("graph_id", "metric", F.size("rooms").cast("long").alias("n_rooms"), F.size("edges").cast("long").alias("n_edges"), r6("reward"), r6("baseline"), "actions")


_TESTED = ("overall_quality", "fire_safety_margin", "circulation_efficiency")


@on_events(once=True)
def counterfactual(g):
    """Three heads of a network that was trained for two epochs."""
    packed, network = _packed(g, _TESTED), N.Network(_TESTED, hidden=32)
    T.fit(packed, network, epochs=2)
    return X.counterfactual(packed, network).select("graph_id", "metric", "test_type", r6("baseline_score"), r6("sub_score"), r6("delta_q"), "subgraph_nodes", "subgraph_edges", "significant")


@on_events(once=True)
def counterfactual_report(g):
    """X34, X35."""
    packed = T.pack(_typed(g), g.edges.filter("dst_kind = 'room'"))
    return X.counterfactual_report(X.counterfactual(packed, N.Network(_TESTED, hidden=32)))


@on_events(sql("edges", "select graph_id, least(src, dst) as a, greatest(src, dst) as b, rel from edges where dst_kind = 'room' and src <> dst group by all"))
def root_state(g):
    """X04, X05."""
    return X.root_state(g.edges)


@on_events(sql("nodes edges", "select graph_id, rel, dst_kind, count(*) as n from edges e where exists (select 1 from nodes n where n.graph_id = e.graph_id and n.room_id = e.src and floor = 0) and (dst_kind = 'environment' or exists (select 1 from nodes n where n.graph_id = e.graph_id and n.room_id = e.dst and floor = 0)) group by all"))
def induced_floor_subgraph(g):
    """The ground floor's edges."""
    return X.induced(g.edges, g.nodes.filter("floor = 0")).groupBy("graph_id", "rel", "dst_kind").agg(F.count("*").alias("n"))


@on_events(sql("nodes edges", "select graph_id, rel, count(*) as n from (select distinct graph_id, least(src, dst) as a, greatest(src, dst) as b, rel from edges where dst_kind = 'room' and src <> dst) k where not exists (select 1 from nodes n where n.graph_id = k.graph_id and n.room_type = 'toilet' and n.room_id in (k.a, k.b)) group by all"))
def dropped_nodes(g):
    """The state without its toilets."""
    gone = g.nodes.filter("room_type = 'toilet'").select("graph_id", F.col("room_id").alias("node"))
    return X.drop_nodes(X.root_state(g.edges), gone).groupBy("graph_id", "rel").agg(F.count("*").alias("n"))


@on_events(sql("nodes", "select graph_id, room_id, round(case when floor = 0 then least(1, area / 800) else 0 end, 9) as area from nodes"))
def masked_features(g):
    """Rooms off the ground floor masked."""
    f = X.masked_features(P.room_features(g.nodes), g.nodes.filter("floor = 0"))
    return f.select("graph_id", "room_id", F.round(F.element_at("features", 14), 9).alias("area"))  # areas have two places: no tie at the ninth


@on_events(sql("nodes", f"select graph_id, room_id, k from (select *, row_number() over (partition by graph_id order by {u('42', 'graph_id', 'room_id', chr(39) + 'drop' + chr(39))}, room_id) as k from nodes where room_type not in ('staircase', 'corridor')) where k <= 5"))
def candidate_actions(g):
    """Five candidates a graph, which is the feature."""
    return X.candidate_actions(g.nodes).select("graph_id", "room_id", F.col("k").cast("long").alias("k"))


@on_events(sql("nodes", "select graph_id, room_type, round(sum(area) / count(*) + 1.414 * sqrt(ln(sum(count(*)) over (partition by graph_id)) / count(*)), 6) as score from nodes group by 1, 2"))
def uct_scores(g):
    """X02 with rooms as visits and area as reward."""
    t = g.nodes.groupBy("graph_id", "room_type").agg(F.sum("area").alias("t"), F.count("*").alias("v")).withColumn("p", F.sum("v").over(Window.partitionBy("graph_id")))
    return t.select("graph_id", "room_type", r6(X.uct(F.col("t"), F.col("v"), F.col("p")), "score"))


# Scoring -------------------------------------------------------------------------------------------
@on_events(sql("nodes graphs mdeg", "select graph_id, round(coalesce(l, 0), 6) as loss from graphs left join (select n.graph_id, avg(greatest(0, exits - coalesce(d, 0))) as l from nodes n left join mdeg using (graph_id, room_id) where occupancy >= 50 group by 1) using (graph_id)"))
def fire_loss(g):
    """L06."""
    return L.fire_exit_loss(g).select("graph_id", r6("loss"))


@on_events(sql("nodes", "select graph_id, round(greatest(0, 0.1 - r) + greatest(0, r - 0.3), 6) as loss from (select graph_id, sum(case when room_type = 'corridor' then area else 0 end) / sum(area) as r from nodes group by 1)"))
def circulation_loss(g):
    """L07."""
    return L.circulation_loss(g).select("graph_id", r6("loss"))


@on_events(sql("nodes graphs edges", "select graph_id, round(coalesce(l, 0), 6) as loss from graphs left join (select n.graph_id, avg(greatest(0, 1 - coalesce(d, 0))) as l from nodes n left join (select graph_id, src as room_id, count(*) as d from edges where rel = 'sight' group by 1, 2) using (graph_id, room_id) where daylight >= 3 group by 1) using (graph_id)"))
def daylight_loss(g):
    """L08."""
    return L.daylight_loss(g).select("graph_id", r6("loss"))


@on_events(sql("nodes phys", "select graph_id, round(case when exists (select 1 from ra where ra.graph_id = l2.graph_id) then greatest(0, 0.05 - l2) else 0.5 end, 6) as loss from l2", **LAMBDA2))
def connectivity_loss(g):
    """L09."""
    return L.connectivity_loss(g).select("graph_id", r6("loss"))


_RK = "select s_nationkey as task, s_suppkey as item, s_acctbal / 1000 as pred, (s_suppkey * 37 % 101)::double as target from supplier"


@query(f"select a.task, count(*) as pairs, round(avg(greatest(0, 0.05 - (a.pred - b.pred))), 6) as loss from ({_RK}) a join ({_RK}) b on a.task = b.task and a.target > b.target group by 1")
def ranking_pairs(spark: SparkSession, sf_dir: str):
    """L10, L11."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("task"), (F.col("s_acctbal") / 1000).alias("pred"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("target"))
    return L.ranking_loss(s).select("task", "pairs", r6("loss"))


@query(f"select round(sum(m), 4) as loss from (select task, avg((pred - target) ** 2) as m from ({_RK}) group by 1)")
def multitask_mse(spark: SparkSession, sf_dir: str):
    """L04b."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("task"), (F.col("s_acctbal") / 1000).alias("pred"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("target"))
    return L.multitask_mse(s).select(F.round("loss", 4).alias("loss"))


@on_events()
def graph_scores(g):
    """All heads of a network with seeded weights."""
    return T.score(T.pack(_typed(g), g.edges.filter("dst_kind = 'room'")), N.Network()).select("graph_id", "task", F.round("score", 4).alias("score"))


@on_events(once=True)
def graph_training(g):
    """Losses of four epochs over the metrics of the graphs."""
    packed = _packed(g)
    state = T.fit(packed, N.Network(hidden=32), epochs=4)
    return T.history(packed.sparkSession, state).select("epoch", r6("train_loss"), r6("val_loss"), "lr")


@on_events(once=True)
def graph_training_report(g):
    """A20 on the test split, after four epochs."""
    packed, network = _packed(g), N.Network(hidden=32)
    T.fit(packed, network, epochs=4)
    report = S.task_report(T.predictions(packed.filter("split = 'test'"), network))
    return report.select("task", r6("r2"), r6("mae"), r6("mean_pred"), r6("mean_target"))


# Layout --------------------------------------------------------------------------------------------
@on_events(sql("nodes", "select graph_id, room_id, row_number() over (partition by graph_id order by r, n desc, f) as pos from (select *, row_number() over (partition by graph_id, room_type order by ord) as r, count(*) over (partition by graph_id, room_type) as n, min(ord) over (partition by graph_id, room_type) as f from nodes)"))
def interleave(g):
    """Y07."""
    return Y.interleave(g.nodes).select("graph_id", "room_id", F.col("pos").cast("long").alias("pos"))


@on_events(sql("nodes", "select graph_id, room_id, round(w, 6) as w, round(coalesce(sum(w) over (partition by graph_id, typical_floor order by ord rows between unbounded preceding and 1 preceding), 0), 6) as x0 from (select *, case room_type when 'staircase' then 4.0 when 'toilet' then 5.5 else area / 7 end::double as w from nodes) where w >= 2"))
def row_packing(g):
    """Y08."""
    return Y.pack_rows(g.nodes).select("graph_id", "room_id", r6("w"), r6("x0"))


@on_events(sql("nodes", "select graph_id, room_id, (case when room_type in ('toilet') then floor(i * 3 / n) when room_type in ('corridor', 'staircase') then i % 3 else j % 3 end)::bigint as phys from (select *, row_number() over (partition by graph_id, typical_floor, room_type order by ord) - 1 as i, count(*) over (partition by graph_id, typical_floor, room_type) as n, row_number() over (partition by graph_id, typical_floor, room_type in ('toilet', 'corridor', 'staircase') order by ord) - 1 as j from nodes)"))
def split_physical(g):
    """Y04."""
    return Y.split_physical(g.nodes, 3).select("graph_id", "room_id", "phys")


@on_events(sql("nodes", "select graph_id, typical_floor, round(sum(greatest(7, area / 9) + 0.3) + 8, 6) as width, round(sum(sqrt(area) * 0.9), 6) as least from nodes group by 1, 2"))
def row_widths(g):
    """Y05, Y09."""
    return Y.width_estimate(g.nodes).select("graph_id", "typical_floor", r6("width"), r6("least"))


@on_events(sql("nodes", "select graph_id, room_id, row::bigint as row, round(h, 6) as h, round(w, 6) as w, round(coalesce(sum(w) over (partition by graph_id, typical_floor, row order by i rows between unbounded preceding and 1 preceding), 0), 6) as x0 from (select *, sum(area) over (partition by graph_id, typical_floor, row) / 50 as h, area / sum(area) over (partition by graph_id, typical_floor, row) * 50 as w from (select *, i // 6 as row from (select *, row_number() over (partition by graph_id, typical_floor order by area desc, ord) - 1 as i from nodes)))"))
def strip_packing(g):
    """Y11, Y12."""
    return Y.strips(g.nodes).select("graph_id", "room_id", "row", r6("h"), r6("w"), r6("x0"))


@on_events(sql("nodes", "select graph_id, room_id, round(case when n = 1 then 25.0 when n = 2 then 2.75 + i * 44.5 else (i + 0.5) * 50.0 / n end, 6) as cx from (select *, row_number() over (partition by graph_id, typical_floor order by ord) - 1 as i, count(*) over (partition by graph_id, typical_floor) as n from nodes)"))
def even_positions(g):
    """Y06."""
    return Y.even_positions(g.nodes, 50.0).select("graph_id", "room_id", r6("cx"))


@on_events()
def floor_plan_error(g):
    """Y01, Y03, Y13."""
    return Y.plan_error(g.nodes, Y.floor_plan(g.nodes)).select("graph_id", "typical_floor", r6("stored"), r6("drawn"), r6("error"))


_CMP = {"cmp": "select graph_id as motif_id, room_type, avg(n) as mean from (select graph_id, floor, room_type, count(*)::double as n from nodes group by 1, 2, 3) group by 1, 2"}


def _composition(g):
    n = g.nodes.groupBy("graph_id", "floor", "room_type").agg(F.count("*").cast("double").alias("n"))
    return n.groupBy(F.col("graph_id").alias("motif_id"), "room_type").agg(F.avg("n").alias("mean"))


_SUB = {
    "pv": "select motif_id, " + ", ".join(f"coalesce(max(trunc(mean)::int) filter (where room_type = '{t}' and mean >= 0.5), 0) as {t}" for t in ("classroom", "staircase", "toilet")) + " from cmp group by 1",
    "own": "select motif_id, 'U1' as pattern, t.room_type, t.n as count from pv, lateral (values ('classroom', least(6, classroom)), ('corridor', 1), ('toilet', 1)) as t(room_type, n) where classroom >= 4"
    " union all select motif_id, 'U2', t.room_type, t.n from pv, lateral (values ('classroom', classroom // 2), ('corridor', 1)) as t(room_type, n) where classroom >= 8"
    " union all select motif_id, 'C1', t.room_type, 1 from pv, lateral (values ('staircase'), ('toilet')) as t(room_type) where staircase >= 1 and toilet >= 1",
    "dflt": "select * from (values " + ", ".join(f"('{p}', '{t}', {n})" for p, _, _, rooms in Y.DEFAULT_PATTERNS for t, n in rooms.items()) + ") as d(pattern, room_type, count)",
}  # the fixture has no offices and no special classrooms


@on_events(sql("nodes", "select motif_id, pattern, room_type, count from own union all select motif_id, d.pattern, d.room_type, d.count from pv, dflt d where motif_id not in (select motif_id from own)", **_CMP, **_SUB))
def sub_patterns(g):
    """Y14."""
    return Y.sub_patterns(_composition(g))


@on_events(sql("nodes", "select motif_id, room_type, greatest(1, least(6, trunc(mean)::int)) as count from (select *, row_number() over (partition by motif_id order by mean desc, room_type) as k from cmp where room_type <> 'corridor') where k <= 5", **_CMP))
def top_types(g):
    """Five types a motif, which is the feature."""
    return Y.top_types(_composition(g)).select("motif_id", "room_type", "count")


@on_events()
def layout_template(g):
    """Where the rooms of the template stand."""
    return Y.template(_composition(g)).select("motif_id", "i", "room_type", r6("x"), r6("y"), "w", "h")


# Catalog and generation ----------------------------------------------------------------------------
_CAT = ", ".join(f"('{t}', {ROOM_TYPES.index(t)}, '{r[0]}', {r[1]}::double, {r[2]}::double, {NOISE[r[6]]}, {NOISE[r[7]]}, {r[8]}::double, {r[9]})" for t, r in CATALOG.items())
_SPECV = f"(values {_CAT}) as t(room_type, type_idx, zone, area_min, area_max, noise, tolerance, density, exits)"


@query(f"select room_type, type_idx, zone, area_min, area_max, noise, tolerance, density, exits from {_SPECV}")
def room_catalog(spark: SparkSession, sf_dir: str):
    """SC01-SC05."""
    assert SPEC_SCHEMA
    return catalog(spark).select("room_type", "type_idx", "zone", "area_min", "area_max", "noise", "tolerance", "density", "exits")


def _req(spark: SparkSession):
    return G.requests(spark, 30)


_REQ = f"select i as graph_id, ['small', 'medium', 'large'][(i % 3 + 1)::int] as school_size, (2 + floor({u('42', 'i', chr(39) + 'floors' + chr(39))} * 4))::int as num_floors, i + 42 as seed, case when {u('42', 'i', chr(39) + 'split' + chr(39))} < 0.7 then 'train' when {u('42', 'i', chr(39) + 'split' + chr(39))} < 0.85 then 'val' else 'test' end as split from range(30) r(i)"


@query(_REQ)
def generate_requests(spark: SparkSession, sf_dir: str):
    """G18's quotas, floors and splits."""
    return _req(spark)


_PROGV = ", ".join(f"('{s}', '{t}', {n})" for s, p in G.PROGRAM.items() for t, n in p.items())


@query(f"select graph_id, school_size, room_type, n as count from ({_REQ}) join (values {_PROGV}) as p(school_size, room_type, n) using (school_size)")
def generate_program(spark: SparkSession, sf_dir: str):
    """G10."""
    return G.program(_req(spark)).select("graph_id", "school_size", "room_type", "count")


_FLO = "select graph_id, 'ground' as typical_floor, 0 as floor_lo, 0 as floor_hi from q union all select graph_id, 'teaching', 1, case when num_floors >= 5 then num_floors - 2 else num_floors - 1 end from q where num_floors >= 2 union all select graph_id, 'top', num_floors - 1, num_floors - 1 from q where num_floors >= 5"


@query(f"with q as ({_REQ}) {_FLO}")
def typical_floors(spark: SparkSession, sf_dir: str):
    """G11."""
    return G.typical_floors(_req(spark)).select("graph_id", "typical_floor", "floor_lo", "floor_hi")


@query(f"select graph_id, format('{{}}_{{:03d}}_G0', room_type, k::bigint) as room_name, round(least(area_max, greatest(area_min, (area_min + area_max) / 2 * (0.9 + 0.2 * {u('seed', 'nm', chr(39) + 'area' + chr(39))}))), 6) as area from (select *, format('{{}}_{{:03d}}_G0', room_type, k::bigint) as nm from (select q.*, room_type, unnest(range(n)) as k from ({_REQ}) q join (values {_PROGV}) as p(school_size, room_type, n) using (school_size))) join {_SPECV} using (room_type)")
def generate_rooms(spark: SparkSession, sf_dir: str):
    """G02-G04 with the whole program on the ground floor."""
    p = G.program(_req(spark)).withColumns({"typical_floor": F.lit("ground"), "floor_lo": F.lit(0), "floor_hi": F.lit(0)})
    return G.rooms(p, catalog(spark)).select("graph_id", "room_name", r6("area"))


@query()
def generate_floor_program(spark: SparkSession, sf_dir: str):
    """G12."""
    return G.floor_program(_req(spark)).select("graph_id", "typical_floor", "room_type", "count")


@query()
def generate_areas(spark: SparkSession, sf_dir: str):
    """Floor areas after allocation."""
    n = G.allocate_areas(G.enforce_minimums(G.rooms(G.floor_program(_req(spark)), catalog(spark))))
    return n.groupBy("graph_id", "typical_floor").agg(r6(F.sum("area"), "area"), F.count("*").alias("rooms"))


@query()
def generate_environment(spark: SparkSession, sf_dir: str):
    """G05-G09b."""
    return G.environment(_req(spark)).select("graph_id", "env_name", "env_type", r6("x"), r6("y"))


@query()
def generated_checks(spark: SparkSession, sf_dir: str):
    """G17's checks on areas over a generated collection."""
    from graphloom.model import GraphTables
    from graphloom.operators import constraints as C

    r = _req(spark)
    n = G.allocate_areas(G.enforce_minimums(G.rooms(G.floor_program(r), catalog(spark))))
    g = GraphTables(r, n.drop("school_size", "num_floors").withColumn("room_id", F.col("room_name")), n.limit(0), n.limit(0))
    return C.area_bounds(g).unionByName(C.floor_corridor_ratio(g)).groupBy("graph_id", "constraint").agg(F.count("*").alias("n"))


@query()
def generated_status(spark: SparkSession, sf_dir: str):
    """The status of all checks over the best attempts, after all rules."""
    from graphloom.operators import constraints as C

    return C.status(G.with_retries(_req(spark))[0])


@query("select source, attempt, all_passed, case when all_passed then 0 else violations end::bigint as violations from (select *, row_number() over (partition by source order by all_passed desc, case when all_passed then 0 else violations end, attempt) as k from (select o_custkey as source, o_orderkey as attempt, o_orderstatus = 'F' as all_passed, o_totalprice::bigint as violations from orders)) where k = 1".replace("o_totalprice::bigint", "floor(o_totalprice)::bigint"))
def best_attempt(spark: SparkSession, sf_dir: str):
    """G17's choice, over orders as attempts of customers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("all_passed"), F.floor("o_totalprice").alias("violations"))
    return G.best_attempt(o).select("source", "attempt", "all_passed", F.col("violations").cast("long").alias("violations"))
