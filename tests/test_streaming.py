import datetime as dt

import pytest
from pyspark.sql import functions as F

from sumfold.operators import hll
from sumfold.sources import tables
from sumfold.streaming import rollups


@pytest.fixture()
def stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * (i % 50)), i % 12, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_windows_equal_batch(stream):
    batch, live = stream
    for slide in (None, "30 minutes"):
        out = rollups.run_once(rollups.windowed(rollups.timed(live), "1 hour", slide), "w" + str(slide is None))
        want = rollups.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", slide)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(stream):
    batch, live = stream
    out = rollups.run_once(rollups.sessions(rollups.timed(live), "10 minutes", "user_id"), "s", "complete")
    want = rollups.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), "10 minutes", "user_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_distinct_counts_equal_batch(stream):
    batch, live = stream
    cells = rollups.run_once(rollups.registers(live, "user_id", (), 10), "h")
    assert hll.HyperLogLog(cells, (), precision=10).equals(hll.HyperLogLog.build(batch, "user_id", (), 10))


def test_native_sketches_merge(stream):
    _, live = stream
    out = rollups.run_once(rollups.native_distinct(rollups.timed(live), "user_id", "1 hour"), "n")
    assert out.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first().n == 12


def test_top_k_sink(stream, tmp_path):
    _, live = stream
    seen = []
    q = rollups.frequencies(live, "user_id").writeStream.outputMode("complete").foreachBatch(rollups.top_k_sink(3, lambda df, e: seen.append([(r.item, r.freq) for r in df.collect()]))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[-1] == [(0, 17), (1, 17), (2, 17)]


def test_dedup(stream):
    _, live = stream
    assert rollups.run_once(rollups.deduplicated(rollups.timed(live), ["user_id"]), "d", "append").count() == 12
    got = rollups.run_once(rollups.first_seen(live, "user_id"), "f", "append").collect()
    assert sorted(r.key for r in got) == list(range(12))


def test_retention_and_daily_tables(spark, tmp_path):
    df = spark.sql("select date_add(date'2024-01-01', cast(id as int)) as day, id from range(10)")
    assert sorted(r.id for r in tables.retain(df, 3).collect()) == [7, 8, 9]
    tables.write_daily(df, str(tmp_path / "t"))
    assert tables.read_days(spark, str(tmp_path / "t"), "2024-01-02", "2024-01-03").count() == 2
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
