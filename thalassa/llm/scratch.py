"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="thalassa-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Seconds from one relieve() of materialize() to the next.
PAUSE = 5
_relieved = -float("inf")


def relieve(spark: SparkSession) -> None:
    """Give back to the system the freed memory that the allocators of the driver's Python and JVM hold.

    Each of the JVM's several hundred threads allocates from one of up to eight arenas a core, and glibc keeps what is
    freed there: over many jobs some hundred MB. Does nothing with another allocator, or with a JVM that can't (before 17.0.9).
    """
    global _relieved
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        of = jvm.java.lang.Class.forName
        types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = of(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is in a package that is not open
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    _relieved = time.monotonic()


#: Seconds from one relieve_executors() of materialize() to the next.
EXECUTORS_PAUSE = 20
_executors_relieved = -float("inf")


def relieve_executors(spark: SparkSession) -> None:
    """Collect the garbage of the executors' JVMs, which then give the freed part of their heaps back to the system.

    A heap only grows while there is room below its limit: after some stages it is all garbage but for a few MB. One task for each
    executor, which idle executors take one each. A local session's JVM is the driver's own, and is left alone.
    """
    global _executors_relieved
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        n = max(1, len(sc._jsc.sc().statusTracker().getExecutorInfos()) - 1)
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') g").write.format("noop").mode("overwrite").save()
    _executors_relieved = time.monotonic()


def materialize(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it: cuts lineage, survives lost executors.

    options are those of the writer.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/thalassa-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if time.monotonic() - _relieved > PAUSE:
        relieve(spark)
    if time.monotonic() - _executors_relieved > EXECUTORS_PAUSE:
        relieve_executors(spark)
    return out


#: Rows of a file of materialize_narrow().
FILE_ROWS = 1 << 18


def materialize_narrow(df: DataFrame) -> DataFrame:
    """As materialize(), for tables of a few numbers a row that many partitions give little of: as few files as their rows
    need, and none that only marks the end.

    Where Hadoop has no native library, each file (and its checksum) starts a child process of the executor, which for a
    moment counts with the whole memory of its parent.
    """
    held = keep(df)
    try:
        files = -(-held.count() // FILE_ROWS)
        # all rows are held, so that fewer tasks only copy them
        return materialize(held.coalesce(max(1, files)), {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"})
    finally:
        drop(held)


def keep(df: DataFrame) -> DataFrame:
    """df held on the executors' disks until drop(), for tables of short lineage that are read several times: what a lost
    executor held is computed again."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df._kept = True
    return df


def drop(*frames: DataFrame) -> None:
    """Remove tables that materialize() wrote or keep() holds and that no later plan reads."""
    for df in frames:
        if getattr(df, "_kept", False):
            df.unpersist()
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from the columns."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, unless their path has it already.

    Also sets the session to batches of at most BATCH_BYTES between executors and Python, if it allows more: texts and
    sets of shingles are long, and batches of 10,000 of them would fill the workers.
    """
    import os
    from pathlib import Path

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="thalassa-ship-"), package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
