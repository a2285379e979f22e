"""Training and scoring with the graph network over whole collections.

A graph becomes one packed row: features, edges by position, targets. Scoring maps over these rows without a shuffle. Training deals
them into parts of batches, one partition each, that are kept between the epochs; a step is a job over its batch's partitions alone, every task sums the
gradients of its graphs, the sums are added in a fixed order, and the driver, which holds weights and moments only, makes the step.
Where one step's sums are too many for the driver, batches are folders of a table instead, and a shuffle adds the sums piece by piece.
A checkpoint is a table in the shared folder, so that a run that was lost goes on from its last epoch with the same weights.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import hash_uniform
from graphloom.operators.network import Network, directed, ranking
from graphloom.session import delete, names, new_folder, share_code

ACCUMULATE = 16  # fixed value: graphs whose scores are ranked against each other
PIECE = 1 << 15  # weights of a gradient row
SUMS = 1 << 28  # bytes of one step's sums that the driver takes
MOST_STEPS = 256  # batches of an epoch, at most; larger collections have larger batches

_PACKED = "graph_id {kind}, ids array<long>, types array<string>, x array<double>, rel array<string>, src array<int>, dst array<int>, targets array<double>"


def pack(features: DataFrame, edges: DataFrame, targets: DataFrame | None = None, tasks: tuple[str, ...] = ()) -> DataFrame:
    """One row a graph: rooms by id, features row by row, room-room edges by position, and a target a task (null where there is none).

    features: (graph_id, room_id, features, and room_type if there is one); edges: (graph_id, rel, src, dst), those that end at other
    nodes are left out; targets: (graph_id, task, target).
    """
    share_code(features.sparkSession)
    kind = dict(features.dtypes)["graph_id"]
    typed = features if "room_type" in features.columns else features.withColumn("room_type", F.lit(None).cast("string"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(left.column("room_id").to_numpy(), kind="stable")
        left = left.take(pa.array(at))
        ids = left.column("room_id").to_numpy()
        x = [v for row in left.column("features").to_pylist() for v in row]
        s, d, rel = (right.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "rel"))
        si, di = (np.minimum(np.searchsorted(ids, v), max(0, len(ids) - 1)) for v in (s, d))
        ok = np.flatnonzero((ids[si] == s) & (ids[di] == d)) if len(s) and len(ids) else np.zeros(0, int)
        ok = ok[np.lexsort((di[ok], si[ok], rel[ok].astype(str)))]
        row = [[left.column("graph_id")[0].as_py()]] if len(ids) else [[]]
        row += [[v] * len(row[0]) for v in (ids.tolist(), left.column("room_type").to_pylist(), x, rel[ok].tolist(), si[ok].tolist(), di[ok].tolist())]
        kinds = [left.schema.field("graph_id").type, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["graph_id", "ids", "types", "x", "rel", "src", "dst"])

    a = typed.select("graph_id", "room_id", "room_type", "features").groupBy("graph_id")
    b = edges.select("graph_id", "rel", "src", "dst").toDF("graph_id", "rel", "src", "dst")  # attributes of its own: both sides may come from one frame
    out = a.cogroup(b.groupBy("graph_id")).applyInArrow(run, _PACKED.format(kind=kind).rsplit(", ", 1)[0])
    if targets is None:
        return out.withColumn("targets", F.lit(None).cast("array<double>"))
    by = targets.groupBy("graph_id").agg(F.array(*[F.max(F.when(F.col("task") == t, F.col("target"))) for t in tasks]).alias("targets"))
    return out.join(by, "graph_id", "left")


def _rows(batch: pa.RecordBatch, network: Network):
    """(x, links by relation, targets) of each packed row."""
    for x, rel, src, dst, n, want in zip(*(batch.column(c).to_pylist() for c in ("x", "rel", "src", "dst", "ids", "targets")), strict=True):
        rel, src, dst = np.array(rel, object), np.array(src, np.int64), np.array(dst, np.int64)
        links = {r: (src[rel == r], dst[rel == r]) for r in network.relations}
        goal = np.full(len(network.tasks), np.nan) if want is None else np.array([np.nan if v is None else v for v in want], np.float64)
        yield np.array(x, np.float64).reshape(len(n), -1), links, goal


def _graphs(batch: pa.RecordBatch, network: Network):
    """(x, means, targets) of each packed row."""
    for x, links, goal in _rows(batch, network):
        yield x, directed(len(x), links, network.relations), goal


def score(packed: DataFrame, network: Network) -> DataFrame:
    """(graph_id, task, score) of every packed graph, without a shuffle."""
    kind = dict(packed.dtypes)["graph_id"]
    share_code(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [network.forward(x, means) for x, means, _ in _graphs(batch, network)]
            which = pa.array(np.repeat(np.arange(len(got)), len(network.tasks)))
            yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(which), pa.array(list(network.tasks) * len(got)), pa.array(np.concatenate(got) if got else np.zeros(0))], ["graph_id", "task", "score"])

    return packed.select("graph_id", "ids", "x", "rel", "src", "dst", "targets").mapInArrow(run, f"graph_id {kind}, task string, score double")


def graph_loss(scores: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum over the tasks with a target of the squared error, its slope)."""
    off = np.where(np.isnan(target), 0.0, scores - np.nan_to_num(target))
    return float((off * off).sum()), 2 * off


def _summed(graphs: Iterable[tuple], network: Network, rank: float, ranked: bool, seed: int | None) -> tuple[int, float, np.ndarray]:
    """(graphs, summed loss, summed gradient) of (x, means, targets, key); seed None: the loss alone.

    The scores of every ACCUMULATE graphs are ranked; `ranked` says whether that term has a gradient or is only added to the loss.
    """
    total, n, loss, waiting = np.zeros(network.size if seed is not None else 0), 0, 0.0, []
    views = network.views(total) if seed is not None else {}

    def close(full: bool) -> float:
        if not waiting:
            return 0.0
        slopes, value = [s for *_, s in waiting], 0.0
        if full and rank and seed is not None:
            value, slope = ranking(np.array([w[2] for w in waiting]), np.array([w[3] for w in waiting]))
            slopes = [s + rank * r * ranked for s, r in zip(slopes, slope, strict=True)]
        if seed is not None:
            for (means, kept, *_), slope in zip(waiting, slopes, strict=True):
                network.backward(means, kept, slope, views)
        waiting.clear()
        return rank * value

    for x, means, goal, key in graphs:
        kept: list = []
        rng = None if seed is None else np.random.default_rng([seed, key & ((1 << 63) - 1)])
        out = network.forward(x, means, rng, kept if seed is not None else None)
        one, slope = graph_loss(out, goal)
        loss, n = loss + one, n + 1
        waiting.append((means, kept, out, goal, slope))
        if len(waiting) == ACCUMULATE:
            loss += close(True)
    close(False)
    return n, loss, total


def _gradients(network: Network, rank: float, ranked: bool, seed: int | None):
    """mapInArrow over packed rows with (part, key): rows (piece, part, n, loss, values), a task's sums; seed None: losses only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0

        def graphs() -> Iterator[tuple]:
            nonlocal part
            for batch in batches:
                part = batch.column("part")[0].as_py() if batch.num_rows else part
                for graph, key in zip(_graphs(batch, network), batch.column("key").to_pylist(), strict=True):
                    yield *graph, key

        n, loss, total = _summed(graphs(), network, rank, ranked, seed)
        if n:
            cut = [total[lo : lo + PIECE] for lo in range(0, len(total), PIECE)] or [total]
            for k, values in enumerate(cut):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([n if not k else 0]), pa.array([0.0 if k else loss]), pa.array([values], pa.list_(pa.float64()))], ["piece", "part", "n", "loss", "values"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over partitions sorted by (piece, part): one row a piece, its values added in the order of the parts."""
    own, n, loss, total = None, 0, 0.0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([total], pa.list_(pa.float64()))], ["piece", "n", "loss", "values"])

    for batch in batches:
        for k, m, one, values in zip(*(batch.column(c) for c in ("piece", "n", "loss", "values")), strict=True):
            values = values.values.to_numpy(zero_copy_only=False)
            if k.as_py() != own:
                if own is not None:
                    yield row()
                own, n, loss, total = k.as_py(), 0, 0.0, np.zeros(len(values))
            n, loss, total = n + m.as_py(), loss + one.as_py(), total + values
    if own is not None:
        yield row()


def gradient(rows: DataFrame, network: Network, rank: float = 0.1, ranked: bool = True, seed: int | None = 0) -> tuple[int, float, np.ndarray]:
    """(graphs, summed loss, summed gradient) of packed rows; without a seed the loss alone, without dropout and ranking.

    The driver receives one vector of the size of the weights.
    """
    share_code(rows.sparkSession)
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.select("graph_id", "ids", "x", "rel", "src", "dst", "targets", F.xxhash64("graph_id").alias("key"), F.spark_partition_id().alias("part"))
    sums = parts.mapInArrow(_gradients(network, rank, ranked, seed), "piece int, part int, n long, loss double, values array<double>")
    pieces = -(-network.size // PIECE)
    sums = sums.repartition(max(1, min(tasks, pieces)), "piece").sortWithinPartitions("piece", "part")
    got = sorted(sums.mapInArrow(_added, "piece int, n long, loss double, values array<double>").collect(), key=lambda r: r.piece)
    if not got:
        return 0, 0.0, np.zeros(network.size if seed is not None else 0)
    return sum(r.n for r in got), sum(r.loss for r in got), np.concatenate([np.array(r["values"]) for r in got])


@dataclass
class State:
    """What a run needs to go on: weights, Adam's moments, the schedule, the best weights so far and the losses of each epoch."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    lr: float
    epoch: int = 0
    step: int = 0
    bad: int = 0
    best_loss: float = float("inf")
    plateau: float = float("inf")
    history: list = field(default_factory=list)  # (epoch, train loss, validation loss, rate)


def adam(state: State, grad: np.ndarray, decay: float = 1e-5, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999)) -> State:
    """One step with the gradient cut to norm `clip` and weights decayed into it."""
    norm = np.linalg.norm(grad)
    grad = grad * min(1.0, clip / (norm + 1e-6)) + decay * state.weights
    step = state.step + 1
    first = betas[0] * state.first + (1 - betas[0]) * grad
    second = betas[1] * state.second + (1 - betas[1]) * grad * grad
    move = first / (1 - betas[0] ** step) / (np.sqrt(second / (1 - betas[1] ** step)) + 1e-8)
    return replace(state, weights=state.weights - state.lr * move, first=first, second=second, step=step)


def after_epoch(state: State, train: float, val: float, factor: float = 0.5, patience: int = 10) -> State:
    """The best weights by validation loss; the rate is halved after more than `patience` epochs without a loss lower by a ten-thousandth."""
    epoch, best, best_loss = state.epoch + 1, state.best, state.best_loss
    if val < best_loss:
        best, best_loss = state.weights, val
    plateau, bad, lr = (val, 0, state.lr) if val < state.plateau * (1 - 1e-4) else (state.plateau, state.bad + 1, state.lr)
    if bad > patience:
        bad, lr = 0, lr * factor
    return replace(state, epoch=epoch, best=best, best_loss=best_loss, plateau=plateau, bad=bad, lr=lr, history=[*state.history, (epoch, train, val, state.lr)])


_ARRAYS, _NUMBERS = ("weights", "first", "second", "best"), ("lr", "epoch", "step", "bad", "best_loss", "plateau")


def save(spark: SparkSession, state: State, path: str) -> None:
    """A checkpoint as a table (name, at, values) below `path`, named by its epoch; the one before the last goes."""
    rows = [(k, lo, getattr(state, k)[lo : lo + PIECE].tolist()) for k in _ARRAYS for lo in range(0, len(state.weights), PIECE)]
    rows += [(k, 0, [float(getattr(state, k))]) for k in _NUMBERS] + [("history", k, [float(x) for x in h]) for k, h in enumerate(state.history)]
    spark.createDataFrame(rows, "name string, at int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{state.epoch:06d}")
    for old in sorted(n for n in names(spark, path) if n.startswith("epoch-"))[:-2]:
        delete(spark, f"{path}/{old}")


def restore(spark: SparkSession, path: str) -> State | None:
    """The last whole checkpoint below `path`, if there is one."""
    whole = [n for n in sorted(names(spark, path), reverse=True) if n.startswith("epoch-") and "_SUCCESS" in names(spark, f"{path}/{n}")]
    if not whole:
        return None
    rows: dict[str, list] = {}
    for r in sorted(spark.read.schema("name string, at int, values array<double>").parquet(f"{path}/{whole[0]}").collect(), key=lambda r: (r.name, r.at)):
        rows.setdefault(r.name, []).append(r["values"])
    numbers = {k: rows[k][0][0] for k in _NUMBERS}
    numbers |= {k: int(numbers[k]) for k in ("epoch", "step", "bad")}
    return State(**{k: np.concatenate([np.array(v) for v in rows[k]]) for k in _ARRAYS}, **numbers, history=[(int(h[0]), *h[1:]) for h in rows.get("history", [])])


Sums = Callable[[int, Network, int | None], tuple[int, float, np.ndarray]]  # of a step (-1: validation), with the network as it is, by seed


def _kept(dealt: DataFrame, network: Network, steps: int, shards: int, tasks: int, rank: float, ranked: bool) -> tuple[Sums, Callable]:
    """The sums of a step's graphs, of packed rows with `step`: a partition a step and shard, compressed, kept in memory or on disk. And how to let go of them."""
    spark = dealt.sparkSession
    share_code(spark)
    key, shape = F.xxhash64("graph_id"), network

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [zlib.compress(pickle.dumps((*graph, k)), 1) for graph, k in zip(_rows(batch, shape), batch.column("key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["graph"])

    part = F.when(F.col("step") < 0, steps * shards + F.pmod(key, F.lit(tasks))).otherwise(F.col("step") * shards + F.pmod(key, F.lit(shards))).cast("int")
    rows = dealt.select("graph_id", "ids", "x", "rel", "src", "dst", "targets", key.alias("key"), part.alias("part"))
    rows = rows.repartitionById(steps * shards + tasks, "part").sortWithinPartitions("key", "graph_id")
    blocks = rows.select("ids", "x", "rel", "src", "dst", "targets", "key").mapInArrow(pack_rows, "graph binary").rdd.map(lambda r: bytes(r.graph)).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(step: int, network: Network, seed: int | None) -> tuple[int, float, np.ndarray]:
        def run(packed: Iterable[bytes]) -> list[tuple]:
            def graphs() -> Iterator[tuple]:
                for x, links, goal, key in map(pickle.loads, map(zlib.decompress, packed)):
                    yield x, directed(len(x), links, network.relations), goal, key

            return [_summed(graphs(), network, rank, ranked, seed)]

        parts = range(steps * shards, steps * shards + tasks) if step < 0 else range(step * shards, (step + 1) * shards)
        got = spark.sparkContext.runJob(blocks, run, list(parts))  # in the order of the parts
        return sum(n for n, *_ in got), sum(loss for _, loss, _ in got), sum(total for *_, total in got)

    return sums, blocks.unpersist


def _folders(dealt: DataFrame, network: Network, steps: int, shards: int, tasks: int, rank: float, ranked: bool) -> tuple[Sums, Callable]:
    """As `_kept`, for networks and clusters whose sums are too large together for the driver: a batch is a folder of a table."""
    spark = dealt.sparkSession
    table = new_folder(spark, "batches")
    # Files hold the same rows in the same order in every run.
    shard = F.pmod(F.xxhash64("graph_id"), F.lit(shards))
    dealt = dealt.repartition(tasks, "step", shard).sortWithinPartitions("step", F.xxhash64("graph_id"), "graph_id")
    dealt.write.partitionBy("step").parquet(table)
    rows = spark.read.schema(T.StructType([*dealt.drop("step").schema.fields, T.StructField("step", T.IntegerType())])).parquet(table)
    return lambda step, network, seed: gradient(rows.filter(F.col("step") == step), network, rank, ranked, seed), lambda: delete(spark, table)


def fit(packed: DataFrame, network: Network, path: str | None = None, epochs: int = 80, batch: int = 64, lr: float = 1e-3, rank: float = 0.1, ranked: bool = True, patience: int = 10, seed: int = 42) -> State:
    """Train on the packed rows whose `split` is train, validate on val; the state after the last epoch, best weights inside.

    Batches are fixed by hash and come in another order each epoch. `path`: checkpoints, from which an interrupted run goes on; `ranked=False`
    only adds the ranking term to the loss, as the original does, which detaches its scores. Rows without a target count with loss 0. An empty
    training split makes no steps; without validation rows the training loss stands in.
    """
    spark = packed.sparkSession
    n = packed.filter("split = 'train'").count()
    steps = max(1, min(-(-n // batch), MOST_STEPS))
    step = F.floor(hash_uniform(seed, F.col("graph_id"), F.lit("step")) * steps).cast("int")
    dealt = packed.filter("split in ('train', 'val')").withColumn("step", F.when(F.col("split") == "train", step).otherwise(-1)).drop("split")
    # As many tasks a batch as have graphs to rank; a task's graphs come in the same order in every run.
    tasks = max(1, spark.sparkContext.defaultParallelism)
    shards = max(1, min(tasks, -(-n // (steps * ACCUMULATE))))
    sums, close = (_kept if shards * network.size * 8 <= SUMS else _folders)(dealt, network, steps, shards, tasks, rank, ranked)
    state = restore(spark, path) if path else None
    if state is None:
        zero = np.zeros(network.size)
        state = State(network.vector.copy(), zero, zero, network.vector.copy(), lr)
    while state.epoch < epochs:
        total, seen = 0.0, 0
        for k in np.random.default_rng([seed, state.epoch]).permutation(steps).tolist():
            count, loss, grad = sums(k, network.load(state.weights), seed + 1 + state.epoch)
            if count:
                state = adam(state, grad / count)
                total, seen = total + loss, seen + count
        count, loss, _ = sums(-1, network.load(state.weights), None)
        train = total / max(1, seen)
        state = after_epoch(state, train, loss / count if count else train, patience=patience)
        if path:
            save(spark, state, path)
    close()
    network.load(state.best)
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, train_loss, val_loss, lr)."""
    return spark.createDataFrame([(h[0], float(h[1]), float(h[2]), float(h[3])) for h in state.history], "epoch int, train_loss double, val_loss double, lr double")


def predictions(packed: DataFrame, network: Network) -> DataFrame:
    """A20's input: (graph_id, task, pred, target) of the graphs and tasks that have a target."""
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in network.tasks]).alias("task"), F.col("targets").alias("target"))
    goal = packed.select("graph_id", F.explode(pairs).alias("p")).select("graph_id", "p.task", "p.target").filter("target is not null")
    return score(packed, network).withColumnRenamed("score", "pred").join(goal, ["graph_id", "task"])
