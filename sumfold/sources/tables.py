"""Input tables and sketch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly over the cores if its rows lie in fewer splits than there are cores, as those of a small file of one row group do.

    Tables with rows in at least as many splits, so all large ones, are not shuffled. One look at the splits' sizes, without any column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < used < cores else df


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV or text. CSV and JSON need a schema, so nothing is read twice to infer one."""
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_daily(df: DataFrame, path: str, day: str = "day", mode: str = "append") -> None:
    """A sketch table partitioned by day, so that range merges prune partitions."""
    df.write.mode(mode).partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str, day: str = "day") -> DataFrame:
    return spark.read.parquet(path).where(F.col(day).between(first, last))


def retain(df: DataFrame, days: int, day: str = "day") -> DataFrame:
    """Rows of the last `days` days before the newest one in the data, not before today."""
    newest = df.agg(F.max(day).alias("d")).first().d
    return df if newest is None else df.where(F.col(day) > F.date_sub(F.lit(newest), days))


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: the folder that spark.checkpoint.dir names, or else the warehouse; if both are one process, a temporary one."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="sumfold-tables-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def once(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back, for what is costly to compute and read more than once, as both sides of a self-join are. The table goes with the application."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
