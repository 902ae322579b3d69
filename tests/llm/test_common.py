from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from sumfold.llm import common


def test_cut_and_sweep(spark):
    common.sweep(spark)
    df = common.cut(spark.range(5).withColumn("x", F.lit("a")), "tag")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    folder = Path(urlparse(common.shared_dir(spark)).path)
    assert [p for p in folder.iterdir() if p.name.startswith("tag-")]
    assert common.sweep(spark) == 1 and not [p for p in folder.iterdir() if p.name.startswith("tag-")]


def test_named_folder_is_used():
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://store/shared/"}.get(key, default)

    class Session:
        conf = Conf()

    assert common.shared_dir(Session()) == "hdfs://store/shared"


def test_batches_only_shrink(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "50")
        common.small_batches(spark)
        assert spark.conf.get(key) == "50"
        spark.conf.set(key, "5000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_crc(spark):
    import zlib

    rows = spark.createDataFrame([(5,), (None,)], "i long").select(common.crc_mod("i", 7).alias("m")).collect()
    assert [r.m for r in rows] == [zlib.crc32(b"5") % 7, None]


def test_stored_gives_freed_native_memory_back(spark):
    """Freed blocks below one that is in use stay in the driver's JVM until it is told to trim."""
    unsafe = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    unsafe.setAccessible(True)
    unsafe = unsafe.get(None)
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held():
        return sum(int(x.split()[1]) for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon")) >> 10

    blocks = [unsafe.allocateMemory(100_000) for _ in range(3000)]
    for b in blocks:
        unsafe.setMemory(b, 100_000, 1)
    for b in blocks[:-1]:
        unsafe.freeMemory(b)
    before = held()
    assert common.stored(spark.range(3), "trimmed").count() == 3
    assert before - held() > 150
    unsafe.freeMemory(blocks[-1])
