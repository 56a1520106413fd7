"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession


#: Session setting with the folder, below the scratch root, that intermediate tables go to.
SCOPE = "tribospark.scratch.scope"
#: Spark's own setting that drops the shuffle files of a command once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Numbers (8 bytes each) that a table may have which is written only to be read faster.
SPARE_NUMBERS = 2**30
#: The folder that takes the tables of the running thread, before the session's.
_own: ContextVar[str | None] = ContextVar("own", default=None)
_writes, _lock, _outside = 0, threading.Lock(), None


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tribospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder for durable intermediates: the cluster's ``spark.checkpoint.dir``.

    A local master without that setting gets a fresh folder under /tmp. Any other master must name
    a shared folder, because a machine-local one is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tribospark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end; results must be written or collected before.

    Without a scope the tables are left to the retention rules of the scratch folder.
    """
    outer, folder = spark.conf.get(SCOPE, "tables"), f"scope-{uuid.uuid4().hex}"
    spark.conf.set(SCOPE, folder)
    try:
        yield
    finally:
        spark.conf.set(SCOPE, outer)
        _drop(spark, folder)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, written; the tables that this thread wrote on the way are deleted at once.

    So what takes part in a result takes room only while the result is made. It may be used in several threads and inside itself.
    """
    outer, folder = _own.get(), f"scope-{uuid.uuid4().hex}"
    _own.set(folder)
    spark = None
    try:
        made = make()
        spark = made.sparkSession
        _own.set(outer)
        return materialise(made)
    finally:
        _own.set(outer)
        _drop(spark or SparkSession.active(), folder)


def side_by_side(function: Callable, items: Iterable, at_once: int) -> list:
    """``function`` of each item, in their order; some run at once, each writing to the folder of this thread."""
    with ThreadPoolExecutor(at_once) as pool:
        return [task.result() for task in [pool.submit(copy_context().run, function, item) for item in items]]


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of commands that begin inside are dropped as they end, and not when the driver next collects its garbage."""
    global _writes, _outside
    with _lock:
        if not _writes:
            _outside = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writes += 1
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                if _outside is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, _outside)


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Cuts lineage without keeping blocks on executors, so a lost executor costs nothing that was
    finished. The Parquet footer also gives the optimiser the true size, which is how per-joint
    tables become broadcast joins only while they are small enough.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{_own.get() or spark.conf.get(SCOPE, 'tables')}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
