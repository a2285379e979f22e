"""Label refinement, kernels, pattern mining and clustering."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import hash_uniform
from graphloom.operators import large
from graphloom.session import delete, held, new_folder, share_code

BINS = 100
LARGEST = 20_000  # nodes of a graph whose refinement one task holds


def hash_bin(label: Column, bins: int = BINS) -> Column:
    """The first eight hex digits of md5 modulo the number of bins."""
    return F.pmod(F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("long"), F.lit(bins)).cast("long")


def refine(labels: DataFrame, links: DataFrame) -> DataFrame:
    """One refinement round of (graph_id, node, label) over links in both directions (graph_id, node, nbr):
    12 hex digits of md5 of the own label, a bar, and the neighbours' sorted labels joined by commas."""
    near = links.join(labels.select("graph_id", F.col("node").alias("nbr"), F.col("label").alias("l")), ["graph_id", "nbr"])
    around = near.groupBy("graph_id", "node").agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("around"))  # bounded by a node's degree
    joined = labels.join(around, ["graph_id", "node"], "left")
    return joined.select("graph_id", "node", F.substring(F.md5(F.concat("label", F.lit("|"), F.coalesce("around", F.lit("")))), 1, 12).alias("label"))


def wl_histogram(labels: DataFrame, links: DataFrame, rounds: int = 3, bins: int = BINS) -> DataFrame:
    """Sparse rows (graph_id, bin, n); the bins of round r follow those of round r - 1.

    A graph's rounds run in one task over its labels and links, so that they are shuffled once; graphs too large for that refine by joins."""
    share_code(labels.sparkSession)
    rows = links.select("graph_id", "node", "nbr", F.lit(None).cast("string").alias("label"))
    rows = rows.unionByName(labels.select("graph_id", "node", F.lit(None).cast("long").alias("nbr"), "label"))

    def run(t: pa.Table) -> pa.Table:
        label, near, count = {}, {}, Counter()
        for node, nbr, own in zip(*(t.column(c).to_pylist() for c in ("node", "nbr", "label")), strict=True):
            if nbr is None:
                label[node] = own
            else:
                near.setdefault(node, []).append(nbr)
        for r in range(rounds + 1):
            count.update(int(_md5(v)[:8], 16) % bins + r * bins for v in label.values())
            label = {x: _md5(f"{v}|{','.join(sorted(label[y] for y in near.get(x, ()) if y in label))}")[:12] for x, v in label.items()} if r < rounds else label
        return pa.table([pa.array([t.column("graph_id")[0].as_py()] * len(count), t.schema.field("graph_id").type), pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["graph_id", "bin", "n"])

    def joins(those: DataFrame) -> DataFrame:
        lab, out = those.filter("nbr is null").select("graph_id", "node", "label"), None
        for r in range(rounds + 1):
            h = lab.groupBy("graph_id", (hash_bin(F.col("label"), bins) + r * bins).alias("bin")).agg(F.count("*").alias("n"))
            out = h if out is None else out.unionByName(h)
            if r < rounds:
                lab = refine(lab, those.filter("nbr is not null").select("graph_id", "node", "nbr"))
        return out

    kind = dict(labels.dtypes)["graph_id"]
    return large.by_size(rows, LARGEST, lambda e: e.groupBy("graph_id").applyInArrow(run, f"graph_id {kind}, bin long, n long"), joins)


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def kernel_matrix(hist: DataFrame, block: int = 512, wide: int = 4096, least: int = 16) -> DataFrame:
    """(g1, g2, k) of graphs that share a bin: cosine off the diagonal (norms plus 1e-8), raw squared norm on it.

    The matrix is made of tiles, each in a task; no row is made for a pair and bin. A graph's bins go to a tile for each group of graphs: to as few groups
    as keep at least `block` graphs, but to more than `least` only where groups would pass `wide` graphs. A task makes its tile in strips of
    block x block pairs. hist: (graph_id, bin, n)."""
    share_code(hist.sparkSession)
    n = hist.select("graph_id").distinct().count()
    k = max(1, min(-(-n // block), max(least, -(-n // wide))))
    rows = hist.groupBy("graph_id").agg(F.collect_list(F.col("bin").cast("int")).alias("bins"), F.collect_list(F.col("n").cast("int")).alias("counts"))  # bounded by the bins
    rows = rows.withColumn("c", F.pmod(F.xxhash64("graph_id"), F.lit(k)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o")).select(F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), "c", "graph_id", "bins", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        c, ids = t.column("c").to_numpy(), t.column("graph_id").to_numpy()
        bins, counts = (pa.concat_arrays(t.column(x).chunks) for x in ("bins", "counts"))
        at = bins.flatten().to_numpy()
        x = np.zeros((len(ids), at.max(initial=0) + 1))
        x[np.repeat(np.arange(len(ids)), bins.value_lengths().to_numpy()), at] = counts.flatten().to_numpy()
        norm = np.sqrt((x * x).sum(1)) + 1e-8
        left, right, other, size = ids[c == p], ids[c == q], x[c == q].T, norm[c == q]
        strip = max(1, block * block // max(1, len(right)))
        for lo in range(0, len(left), strip):
            some, own = left[lo : lo + strip], norm[c == p][lo : lo + strip]
            dot = x[c == p][lo : lo + strip] @ other
            i, j = np.nonzero(dot)
            v = np.where(some[i] == right[j], dot[i, j], dot[i, j] / (own[i] * size[j]))
            yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(right[j]), pa.array(v)], ["g1", "g2", "k"])
            if p != q:
                yield pa.RecordBatch.from_arrays([pa.array(right[j]), pa.array(some[i]), pa.array(v)], ["g1", "g2", "k"])

    return rows.groupBy("p", "q").applyInArrow(run, "g1 long, g2 long, k double")


def lloyd(x: np.ndarray, k: int, rounds: int = 50, seed: int = 42) -> np.ndarray:
    """K-means from k distinct rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        lab = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return ((x[:, None] - c) ** 2).sum(2).argmin(1)


def spectral_labels(kernel: np.ndarray, k: int) -> np.ndarray:
    """Clusters from the k lowest eigenvectors of the normalised Laplacian, rows normalised, by k-means."""
    d = 1 / np.sqrt(kernel.sum(1) + 1e-8)
    lap = np.eye(len(kernel)) - d[:, None] * kernel * d
    v = np.linalg.eigh(lap)[1][:, :k]
    return lloyd(v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8), k)


def spectral_clusters(kernel: DataFrame, k: int, most: int = 4000) -> DataFrame:
    """(graph_id, cluster) of a kernel matrix (g1, g2, k) of at most `most` graphs, in one task; for more graphs see histogram_clusters and power_clusters."""
    share_code(kernel.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        a, b, v = (t.column(c).to_numpy(zero_copy_only=False) for c in ("g1", "g2", "k"))
        ids = np.unique(np.concatenate((a, b)))
        if len(ids) > most:
            raise ValueError(f"{len(ids)} graphs are too many for one dense kernel")
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, a), np.searchsorted(ids, b)] = v
        lab = spectral_labels(m, min(k, len(ids))) if len(ids) > 1 else np.zeros(len(ids))
        return pa.table([pa.array(ids), pa.array(lab.astype(np.int64))], names=["graph_id", "cluster"])

    return kernel.groupBy(F.lit(1).alias("one")).applyInArrow(run, "graph_id long, cluster long")


def _unit(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's histograms by their norms, and their squared norms."""
    bins, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("bins", "counts"))
    x = np.zeros((batch.num_rows, width))
    x[np.repeat(np.arange(batch.num_rows), np.diff(bins.offsets.to_numpy())), bins.flatten().to_numpy()] = counts.flatten().to_numpy()
    square = (x * x).sum(1)
    return x / (np.sqrt(square) + 1e-8)[:, None], square


def _rows_of(batch: pa.RecordBatch, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, f) of a batch of histograms: the kernel between its roots of degrees is A A' plus the diagonal of f. total: the sum of unit histograms."""
    unit, square = _unit(batch, len(total))
    own = square - (unit * unit).sum(1)
    degree = unit @ total + own + 1e-8
    return unit / np.sqrt(degree)[:, None], own / degree


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, fn) -> np.ndarray:
    """The sum of fn(batch), a matrix of fixed shape, over all rows: a matrix a task comes to the driver."""

    def run(batches):
        out = None
        for batch in batches:
            if batch.num_rows:
                out = fn(batch) if out is None else out + fn(batch)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([out.shape[1]], pa.int32())], ["m", "w"])

    return sum(np.frombuffer(r.m).reshape(-1, r.w) for r in rows.mapInArrow(run, "m binary, w int").collect())


def spectral_vectors(hist: DataFrame, k: int, rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """X20 without a kernel matrix: (graph_id, embedding), the k lowest eigenvectors of the normalised Laplacian of kernel_matrix(hist), rows normalised.

    The kernel is the product of the unit histograms with themselves plus a diagonal, so that a product with it is a pass over the
    graphs and only matrices of the number of bins come to the driver. Three blocks of vectors (found, corrected by the diagonal, last
    step) are searched a round, from the histograms' main directions and the graphs that weigh most on the diagonal, until the
    residuals are within the tolerance; RuntimeError if they never are. Copies of a graph make equal eigenvalues: which vectors of their space are
    found is then not defined, as it is for the matrix.
    """
    spark = hist.sparkSession
    share_code(spark)
    rows = held(hist.groupBy("graph_id").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts")))  # bounded by the bins
    n, width = rows.agg(F.count("*"), F.max(F.array_max("bins"))).first()
    if not n:
        return rows.select("graph_id", F.lit(None).cast("array<double>").alias("embedding"))
    total = _summed(rows, lambda b: _unit(b, width + 1)[0].sum(0)[None])[0]
    p = min(n, 3 * k)
    main = np.linalg.eigh(_summed(rows, lambda b: (lambda a: a.T @ a)(_rows_of(b, total)[0])))[1][:, ::-1][:, : min(k, p)]

    def heavy(batches):
        for batch in batches:
            f = _rows_of(batch, total)[1]
            at = np.argsort(-f)[:p]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(f[at])], ["graph_id", "f"])

    kind = dict(rows.dtypes)["graph_id"]
    top = {r.graph_id: i for i, r in enumerate(rows.mapInArrow(heavy, f"graph_id {kind}, f double").orderBy(F.desc("f"), "graph_id").limit(p - main.shape[1]).collect())}

    def mapped(state, fn):
        """The state with new v and q, written, as fn(batch) gives them."""

        def run(batches):
            for batch in batches:
                new = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in fn(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["graph_id", "bins", "counts", "v", "q"])

        path = new_folder(spark, "spectral")
        out = state.mapInArrow(run, f"graph_id {kind}, bins array<long>, counts array<long>, v array<double>, q array<double>")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path), path

    def first(batch):
        v = np.zeros((batch.num_rows, p))
        v[:, : main.shape[1]] = _rows_of(batch, total)[0] @ main
        for i, g in enumerate(batch.column(0).to_pylist()):
            if g in top:
                v[i, main.shape[1] + top[g]] = 1
        return v, np.zeros_like(v)

    state, path = mapped(rows, first)
    w = theta = None
    for _ in range(rounds):

        def blocks(batch, w=w, theta=theta):
            a, f = _rows_of(batch, total)
            v, q = _column(batch, "v"), _column(batch, "q")
            r = np.zeros_like(v) if w is None else f[:, None] * v + a @ w - v * theta
            t = r if w is None else r / np.maximum(np.abs(theta - f[:, None]), 0.01 * np.abs(theta))
            return a, f, np.hstack((v, t, q)), r

        def sums(batch, blocks=blocks):
            a, f, b, r = blocks(batch)
            return np.vstack((a.T @ b, b.T @ b, b.T @ (f[:, None] * b), np.hstack(((r * r).sum(0), np.zeros(2 * p)))[None]))

        got = _summed(state, sums)
        ab, gram, diagonal, residual = np.split(got, [len(total), len(total) + 3 * p, len(total) + 6 * p])
        if w is not None and np.sqrt(residual[0, :k]).max() <= tolerance:
            break
        scale = 1 / np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), np.inf))
        weight, base = np.linalg.eigh(gram * scale[:, None] * scale)
        base = scale[:, None] * base[:, weight > 1e-12] / np.sqrt(weight[weight > 1e-12])
        value, turn = np.linalg.eigh(base.T @ (ab.T @ ab + diagonal) @ base)
        step = base @ turn[:, ::-1][:, :p]
        theta, w, last = value[::-1][:p], ab @ step, step.copy()
        last[:p] = 0
        old = path
        state, path = mapped(state, lambda batch, b=blocks, c=step, d=last: (lambda s: (s @ c, s @ d))(b(batch)[2]))
        delete(spark, old)
    else:
        raise RuntimeError("the eigenvectors did not settle")

    def normal(batches):
        for batch in batches:
            v = _column(batch, "v")[:, :k]
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))], ["graph_id", "embedding"])

    return state.mapInArrow(normal, f"graph_id {kind}, embedding array<double>")


def histogram_clusters(hist: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(graph_id, cluster) as spectral_clusters of kernel_matrix(hist), for any number of graphs: k-means starts from the same rows."""
    v = held(spectral_vectors(hist, k))
    n = v.count()
    if n < 2:
        return v.select("graph_id", F.lit(0).cast("long").alias("cluster"))
    at = {int(x): i for i, x in enumerate(np.random.default_rng(seed).choice(n, min(k, n), replace=False))}
    ids = v.select("graph_id").orderBy("graph_id").rdd.zipWithIndex().filter(lambda x: x[1] in at).map(lambda x: (x[0][0], at[x[1]])).collect()
    begin = {r.graph_id: r.embedding for r in v.filter(F.col("graph_id").isin([g for g, _ in ids])).collect()}
    start = np.array([begin[g] for g, _ in sorted(ids, key=lambda x: x[1])])
    return kmeans(v, min(k, n), start=start).select("graph_id", F.col("cluster").cast("long").alias("cluster"))


def power_clusters(kernel: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """X20 for many graphs: power iteration clustering of pyspark.ml over the sparse kernel."""
    from pyspark.ml.clustering import PowerIterationClustering

    pairs = kernel.filter("g1 < g2 and k > 0").select(F.col("g1").alias("src"), F.col("g2").alias("dst"), F.col("k").alias("weight"))
    out = PowerIterationClustering(k=k, maxIter=20, weightCol="weight", initMode="degree").assignClusters(pairs)
    return out.select(F.col("id").alias("graph_id"), F.col("cluster").cast("long").alias("cluster"))


def kmeans(vectors: DataFrame, k: int, col: str = "embedding", seed: int = 42, rounds: int = 50, start: np.ndarray | None = None) -> DataFrame:
    """`vectors` with `cluster`: Lloyd's rounds over the whole table from the centres `start`, else from k rows chosen by hash.

    A round is one pass: tasks sum the vectors nearest to each of the k centres, Spark adds up the sums,
    and only the k centres come to the driver. An empty cluster keeps its centre; stops when none moves.
    Rows without a vector get a null cluster."""
    share_code(vectors.sparkSession)
    spark = vectors.sparkSession
    if start is None:
        first = vectors.filter(F.col(col).isNotNull()).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))).limit(k).select(col).collect()
        start = [r[0] for r in first]
    c = np.array(start, float)
    if not len(c):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))

    def nearest(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = batch.schema.get_field_index(col)
        x = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
        return x, ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)

    rows = vectors.filter(F.col(col).isNotNull())
    for _ in range(rounds):

        def sums(batches, centres=c):
            for batch in batches:
                if batch.num_rows:
                    x, lab = nearest(batch, centres)
                    for j in np.unique(lab):
                        yield pa.RecordBatch.from_arrays([pa.array([int(j)], pa.int32()), pa.array([int((lab == j).sum())], pa.int64()), pa.array([x[lab == j].sum(0).tolist()], pa.list_(pa.float64()))], ["j", "n", "v"])

        part = rows.select(col).mapInArrow(sums, "j int, n long, v array<double>").select("j", "n", F.posexplode("v"))
        new = c.copy()
        for r in part.groupBy("j", "pos").agg((F.sum("col") / F.sum("n")).alias("m")).collect():
            new[r.j, r.pos] = r.m
        if np.allclose(new, c):
            break
        c = new
    schema = spark.createDataFrame([], vectors.schema).withColumn("cluster", F.lit(None).cast("int")).schema

    def assign(batches, centres=c):
        for batch in batches:
            has = batch.column(batch.schema.get_field_index(col)).is_valid().to_numpy(zero_copy_only=False)
            lab = np.zeros(batch.num_rows, np.int32)
            if has.any():
                lab[has] = nearest(batch.filter(pa.array(has)), centres)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lab, mask=~has)], schema.names)

    return vectors.mapInArrow(assign, schema)


def prototypes(members: DataFrame, counts: DataFrame) -> DataFrame:
    """(cluster, label, mean, graphs): the mean count of a label over those graphs of the cluster that have it."""
    return members.join(counts, "graph_id").groupBy("cluster", "label").agg(F.avg("n").alias("mean"), F.count("*").alias("graphs"))


def centroids(members: DataFrame, kernel: DataFrame) -> DataFrame:
    """(cluster, graph_id), the graph with the largest sum of kernel values inside its cluster; ties to the smaller id."""
    a = members.select(F.col("graph_id").alias("g1"), F.col("cluster").alias("c1"))
    b = members.select(F.col("graph_id").alias("g2"), F.col("cluster").alias("c2"))
    s = kernel.join(a, "g1").join(b, "g2").filter("c1 = c2").groupBy("c1", "g1").agg(F.sum("k").alias("s"))
    w = Window.partitionBy("c1").orderBy(F.desc(F.round("s", 9)), "g1")
    return s.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("c1").alias("cluster"), F.col("g1").alias("graph_id"))


def histogram_centroids(members: DataFrame, hist: DataFrame) -> DataFrame:
    """X22 without a kernel matrix: as `centroids`, from the histograms (graph_id, bin, n).

    A graph's kernel values add up to its product with the sum of the cluster's histograms of length 1, of which there is one a cluster; on the
    diagonal the squared norm stands for the cosine with itself.
    """
    norm = hist.groupBy("graph_id").agg((F.sqrt(F.sum(F.col("n") * F.col("n"))) + 1e-8).alias("norm"))
    unit = hist.join(norm, "graph_id").join(members.select("graph_id", "cluster"), "graph_id").select("graph_id", "cluster", "bin", "n", (F.col("n") / F.col("norm")).alias("u"))
    total = unit.groupBy("cluster", "bin").agg(F.sum("u").alias("t"))
    s = unit.join(total, ["cluster", "bin"]).groupBy("cluster", "graph_id").agg(F.sum(F.col("u") * (F.col("t") - F.col("u")) + F.col("n") * F.col("n")).alias("s"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("s", 6)), "graph_id")
    return s.withColumn("r", F.row_number().over(w)).filter("r = 1").select("cluster", "graph_id")


def motifs(members: DataFrame) -> DataFrame:
    """Clusters of two or more graphs, numbered by size (ties by cluster): (motif_id, cluster, frequency, percentage)."""
    n = members.groupBy("cluster").agg(F.count("*").alias("frequency"))
    total = members.agg(F.count("*").alias("all"))
    w = Window.orderBy(F.desc("frequency"), "cluster")  # one row a cluster
    return n.filter("frequency >= 2").crossJoin(F.broadcast(total)).select((F.row_number().over(w) - 1).cast("long").alias("motif_id"), "cluster", "frequency", (F.col("frequency") / F.col("all")).alias("percentage"))


def patterns(labels: DataFrame, links: DataFrame) -> DataFrame:
    """X29 (exact for two and three nodes), X30: (graph_id, size, canonical, n) of connected induced subgraphs.

    The canonical form does not depend on node names: the sorted labels of the nodes with their sorted
    neighbours' labels, hashed. links: both directions."""
    lab = lambda c: labels.select("graph_id", F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    e = links.filter("node < nbr").select("graph_id", F.col("node").alias("a"), F.col("nbr").alias("b"))
    two = e.join(lab("a"), ["graph_id", "a"]).join(lab("b"), ["graph_id", "b"])
    c2 = F.array_join(F.sort_array(F.array(F.concat("la", F.lit(":"), "lb"), F.concat("lb", F.lit(":"), "la"))), ";")
    two = two.select("graph_id", F.lit(2).cast("long").alias("size"), c2.alias("form"))
    wedge = links.select("graph_id", F.col("node").alias("m"), F.col("nbr").alias("a")).join(links.select("graph_id", F.col("node").alias("m"), F.col("nbr").alias("b")), ["graph_id", "m"]).filter("a < b")
    wedge = wedge.join(e.withColumn("closed", F.lit(True)), ["graph_id", "a", "b"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    wedge = wedge.filter("not closed or m < a")  # a triangle is met from each corner; keep one
    three = wedge.join(lab("a"), ["graph_id", "a"]).join(lab("b"), ["graph_id", "b"]).join(lab("m"), ["graph_id", "m"])
    near = lambda own, *more: F.concat(own, F.lit(":"), F.array_join(F.sort_array(F.array(*more)), ","))
    open_ = F.array(near("la", "lm"), near("lb", "lm"), near("lm", "la", "lb"))
    shut = F.array(near("la", "lm", "lb"), near("lb", "lm", "la"), near("lm", "la", "lb"))
    c3 = F.array_join(F.sort_array(F.when(F.col("closed"), shut).otherwise(open_)), ";")
    three = three.select("graph_id", F.lit(3).cast("long").alias("size"), c3.alias("form"))
    both = two.unionByName(three)
    return both.groupBy("graph_id", "size", F.substring(F.md5("form"), 1, 16).alias("canonical"), "form").agg(F.count("*").alias("n"))


def frequent(pats: DataFrame, scores: DataFrame, support: int = 3, top_k: int = 15, compat: bool = True) -> DataFrame:
    """Patterns in at least `support` graphs, ranked by support * (1 + mean score) * (1 + 0.1 * distinct labels), the top_k best.

    A pattern counts once a graph, so occurrences are the support; compat asks for twice `support` of them, as the original
    does. copies: all of them; percentage: of the graphs of `scores` (graph_id, score); composition: rooms by label."""
    names = F.transform(F.split("form", ";"), lambda x: F.substring_index(x, ":", 1))
    comp = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda t: F.struct(t, F.size(F.filter(names, lambda x: x == t)).cast("double"))))
    total = scores.agg(F.countDistinct("graph_id").alias("graphs"))
    p = pats.join(scores, "graph_id").groupBy("canonical", "size", "form").agg(F.countDistinct("graph_id").alias("support"), F.sum("n").alias("copies"), F.avg("score").alias("avg_score"))
    p = p.filter(F.col("support") >= support * (2 if compat else 1)).withColumn("diversity", F.size(F.array_distinct(names)).cast("long"))
    p = p.crossJoin(F.broadcast(total)).withColumns({"occurrences": F.col("support"), "percentage": F.col("support") / F.col("graphs"), "composition": comp}).drop("graphs")  # total is one row
    p = p.withColumn("rank_score", F.col("support") * (1 + F.col("avg_score")) * (1 + 0.1 * F.col("diversity")))
    return p.orderBy(F.desc(F.round("rank_score", 9)), "canonical").limit(top_k)


def dedup(ranked: DataFrame, most: float = 0.7) -> DataFrame:
    """The patterns of (pattern, rank, items) that no better kept one resembles with a Jaccard over `most`.

    Greedy in rank order over the few rows of a top-k report (one ordered window, at most a few hundred)."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = ranked.select("pattern", "rank", "items", F.collect_list(F.struct("pattern", "items")).over(w).alias("upto"))
    kept = F.expr(
        f"aggregate(upto, cast(array() as array<struct<pattern:string,items:array<string>>>), (k, x) -> if(exists(k, y -> size(array_intersect(y.items, x.items)) > {most} * size(array_union(y.items, x.items))), k, concat(k, array(named_struct('pattern', x.pattern, 'items', x.items)))))"
    )
    return all_.withColumn("k", kept).filter(F.expr("exists(k, y -> y.pattern = pattern)")).select("pattern", "rank", "items")


def sample_connected(labels: DataFrame, links: DataFrame, most: int = 8, seed: int = 42) -> DataFrame:
    """X29 beyond three nodes: (graph_id, walk, nodes): for each graph min(200, 10 n) seeded breadth-first samples of 2 to `most` nodes."""
    from graphloom.operators.algorithms import kernel

    names = labels.select("graph_id", "node", F.lit(None).cast("long").alias("nbr"))

    def fn(ids, adj):
        rng = np.random.default_rng(seed + len(ids))
        walks, nodes = [], []
        for w in range(min(200, 10 * len(ids))):
            size, start = int(rng.integers(2, most + 1)), int(rng.integers(len(ids)))
            got, front = {start}, [start]
            while front and len(got) < size:
                x = front.pop(0)
                for y in rng.permutation(adj[x]).astype(int).tolist():
                    if y not in got and len(got) < size:
                        got.add(y)
                        front.append(y)
            if len(got) >= 2:
                walks.append(w)
                nodes.append(sorted(ids[list(got)].tolist()))
        return [pa.array(walks, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))]

    return kernel(links.select("graph_id", "node", "nbr").unionByName(names), fn, "walk long, nodes array<long>")


#: Chinese names of room types in pattern names.
TYPE_NAMES = {
    "classroom": "教室", "corridor": "走道", "staircase": "楼梯间", "toilet": "卫生间", "office": "办公", "teacher_office": "教师办公",
    "special_classroom": "专用教室", "music_room": "音乐教室", "library": "图书馆", "storage": "储藏",
}


def _of(comp: Column, kind: str) -> Column:
    return F.coalesce(F.try_element_at(comp, F.lit(kind)), F.lit(0.0))


def motif_name(comp: Column) -> Column:
    """A motif's name by the first rule that holds over its composition (map of room type to mean count)."""
    n = lambda t: _of(comp, t)
    room, hall, stair = n("classroom") >= 2, n("corridor") >= 1, n("staircase") >= 0.5
    return (
        F.when((n("music_room") >= 0.5) & room, "动静分区模体").when(room & hall & stair, "教学翼标准模体").when(room & hall, "教室-走廊模体")
        .when((n("entrance_hall") >= 0.5) & (n("office") >= 1), "入口行政模体").when((n("toilet") >= 1) & stair & hall, "公共服务核模体")
        .when(stair & hall, "垂直交通核模体").when(hall, "走廊脊柱模体").otherwise("复合功能模体")
    )


def pattern_name(comp: Column) -> Column:
    """A pattern's name by the first rule that holds; else its two most frequent types (ties by type) joined."""
    n = lambda t: _of(comp, t)
    room, hall, stair = n("classroom") >= 1, n("corridor") >= 1, n("staircase") >= 0.5
    rooms = n("classroom").cast("int").cast("string")
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    order = F.array_sort(F.transform(F.map_entries(comp), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("t"))))
    top = F.transform(F.slice(order, 1, 2), lambda e: F.coalesce(F.try_element_at(names, e["t"]), e["t"]))
    return (
        F.when(room & hall & stair, F.concat(rooms, F.lit("教室教学单元"))).when(stair & (n("toilet") >= 0.5) & hall, "交通服务核").when((n("office") >= 1) & hall, "办公走廊区")
        .when((n("music_room") >= 0.5) & room, "动静分区单元").when(n("special_classroom") >= 0.5, "专用教室集群").when(room, F.concat(rooms, F.lit("教室集群")))
        .otherwise(F.concat(F.array_join(top, "·"), F.lit("组合")))
    )


def constraint_refs(comp: Column, edges: Column | None = None) -> Column:
    """The code sections that a composition of rooms (and of edge types, as a map) bears on, sorted, each once."""
    n = lambda t: _of(comp, t)
    loud = n("music_room") >= 0.5
    if edges is not None:
        loud = loud | (_of(edges, "acoustic_blocks") >= 0.5)
    return F.sort_array(F.array_compact(F.array(
        F.when(n("classroom") >= 1, "GB50099-2011 §5.1 采光"), F.when(n("classroom") >= 1, "GB50016-2014 §5.5 消防"), F.when(loud, "GB50099-2011 §7.3 声学"),
        F.when(n("staircase") >= 0.5, "GB50016-2014 §5.5.17 疏散"), F.when(n("corridor") >= 1, "GB50099-2011 §8.2.3 走廊比"),
    )))


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """SC11: a deterministic order for an epoch."""
    return df.orderBy(hash_uniform(seed, epoch, F.col(key)), key)
