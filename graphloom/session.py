"""Session helpers: a local session for tests and the import path of Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(name: str = "graphloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package, also when only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, deleted when the driver ends."""
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def held(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table below the checkpoint folder, deleted when the driver ends: its plan starts
    there, and lost executors do not matter."""
    path = new_folder(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_together(spark: SparkSession, makers: list[Callable[[], DataFrame]], at_once: int = 4) -> list[DataFrame]:
    """held() of the frame of each maker, several at once: small frames take most of their time in planning, one thread each."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda make: held(make())), makers))


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any file system; none where there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def checkpoints(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the one the session names, a temporary one only where it names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
