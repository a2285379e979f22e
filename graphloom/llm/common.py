"""Shared pieces: staging of intermediate tables, Arrow batching, components of a link table."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import share_code

#: Rows and bytes of one Arrow batch that goes to a Python worker; bounds the worker's memory.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
BLOOM_PARTS, BLOOM_BITS = 1024, 32768  # bitmaps of 4 KB: a filter of 4 MB at most, whatever the number of keys


def prepare(spark: SparkSession) -> SparkSession:
    """Batch limits for Python workers; workers can import this package."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.stage.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.stage.dir", where)
    return where


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder is temporary anyway
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when this driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame, name: str = "stage", release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives lost executors.

    release: let the driver's JVM collect garbage, so that Spark deletes shuffle files nothing needs any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(staged: DataFrame) -> None:
    """Delete what `stage` wrote, once nothing reads it any more."""
    _remove(staged.sparkSession, staged.staged_at)


def trim() -> None:
    """Give the worker's free memory back to the system; workers are reused and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col
    return [x or b"" for x in col.to_pylist()]


def pieces(items: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of items of at most `limit` bytes each, or of one larger item."""
    lo, size = 0, 0
    for i, x in enumerate(items):
        if i > lo and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(items):
        yield lo, len(items)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(BLOOM_PARTS)).cast("int")


def _bits(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOOM_BITS)) for seed in (1, 2, 3)]


def _passes(key: str) -> Column:
    """Whether all of the key's bits stand in `bits`."""
    byte = lambda bit: F.conv(F.hex(F.expr("bits").substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(F.array(*_bits(key)), lambda bit: F.getbit(byte(bit), (bit % 8).cast("int")) == 1)


def sieve(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the boolean `name`: false where the key is in no row of `keys`, without a shuffle of `rows`.

    A filter of at most BLOOM_PARTS bitmaps of 4 KB, three bits a key, is broadcast. With more keys than it is
    made for (some millions) more rows pass, and never fewer than have to.
    """
    spots = keys.select(_part(key).alias("_part"), F.explode(F.array(*_bits(key))).alias("bit"))
    bits = spots.groupBy("_part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = rows.withColumn("_part", _part(key)).join(F.broadcast(bits), "_part", "left")
    return rows.withColumn(name, F.coalesce(F.col(key).isNotNull() & F.col("bits").isNotNull() & _passes(key), F.lit(False))).drop("bits", "_part")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table (a, b), both long: (node, comp), comp the smallest node.

    Min-label propagation with pointer jumping; every round is staged in the shared folder. Nodes
    without a link are not returned. Hot nodes only meet partial aggregates and skew-split joins.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = stage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    for _ in range(rounds):
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("via"))
        seen = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("via").alias("via"))
        step = labels.join(seen, "node", "left").select(
            "node", F.col("comp").alias("was"), F.least("comp", F.coalesce("via", "comp")).alias("near")
        )
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = step.join(jump, "near", "left").select("node", "was", F.least("near", F.coalesce("far", "near")).alias("comp"))
        new = stage(new, "labels")
        labels = new.select("node", "comp")
        if not new.filter("was <> comp").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
