"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset: one in the warehouse, or, if driver and executors are one process, a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sumfold"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sumfold-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def _place(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that lineage ends here.

    Such tables live as long as the application, unless sweep() deletes them before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    files, p = _place(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(p)
    _written.append(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


cut = stored  # the operators' slim tables: ids, counts, signatures


def trim(spark: SparkSession) -> bool:
    """Give back what the driver's two processes hold of freed native memory; whether the JVM did so.

    Planning and compiling dozens of jobs leaves freed blocks in the C library's pools, one for
    each few of some hundred threads. Where the C library or the JVM has no such call, nothing happens.
    """
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    jvm = spark._jvm
    try:  # by reflection on the public interface, as the class behind it is closed
        beans = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        call = next(m for m in beans.getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def mark() -> int:
    """A place in the list of intermediate tables, for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the intermediate tables written in this process after `since`, all but the last `but`; call it when the results that build on them are stored. Returns how many went."""
    gone = _written[since : len(_written) - but]
    for path in gone:
        files, p = _place(spark, path)
        files.delete(p, True)
    del _written[since : len(_written) - but]
    return len(gone)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of whole texts for this session: at most `rows` rows and about `size` bytes, so that a Python worker holds a few MB of them or one text. Settings of the caller that are smaller (bytes: any) stay."""
    key, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set(limit, spark.conf.get(limit, f"{size}b"))


def crc_mod(col: str | Column, k: int) -> Column:
    """crc32 of the value as text, mod k; null for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(k)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(spark: SparkSession, total: int, each: int = 256 << 20, most: int = 100_000) -> int:
    """How many ranges to deal `total` bytes into: about `each` bytes in one, at least the session's shuffle partitions."""
    return max(partitions(spark), min(most, math.ceil(total / each)))
