import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumfold.operators import bloom, cms, hll, quantile, sketch, topk


def items(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("item_"), "id").alias("x"))


def h64(x):
    return int.from_bytes(hashlib.sha256(str(x).encode()).digest()[:8], "big")


def registers(values, p):
    out = {}
    for v in values:
        h = h64(v)
        rest = h >> p
        rank = (64 - p) - rest.bit_length() + 1
        out[h & ((1 << p) - 1)] = max(rank, out.get(h & ((1 << p) - 1), 0))
    return out


class TestHll:
    def test_registers_equal_brute_force(self, spark):
        got = {r.idx: r["rank"] for r in hll.HyperLogLog.build(items(spark, 500), "x", (), 8).df.collect()}
        assert got == registers([f"item_{i}" for i in range(500)], 8)

    @pytest.mark.parametrize("n,p,most", [(50, 12, 0.10), (1000, 14, 0.05), (100_000, 14, 0.03), (10_000, 10, 0.08), (10_000, 12, 0.04)])
    def test_error(self, spark, n, p, most):
        assert abs(hll.estimate_cardinality(items(spark, n), "x", p).first()[0] - n) <= most * n

    def test_merge(self, spark):
        a, b, c = (hll.HyperLogLog.build(items(spark, 300, s), "x", (), 10) for s in (0, 200, 400))
        bulk = hll.HyperLogLog.build(items(spark, 700), "x", (), 10)
        assert ((a + b) + c).equals(bulk) and (a + (b + c)).equals(bulk) and sum([c, a, b]).equals(bulk) and sketch.merge_all([a, b, c]).equals(bulk)
        assert (a + a.zero()).equals(a) and a.zero().is_zero() and not a.is_zero()

    def test_parameters(self, spark):
        a = hll.HyperLogLog.build(items(spark, 5), "x", (), 10)
        with pytest.raises(ValueError):
            a + hll.HyperLogLog.build(items(spark, 5), "x", (), 11)
        with pytest.raises(TypeError):
            a + cms.CountMin.build(items(spark, 5), "x")
        for p in (3, 17):
            with pytest.raises(ValueError):
                hll.HyperLogLog.build(items(spark, 5), "x", (), p)
        with pytest.raises(ValueError):
            sketch.merge_all([])

    def test_empty_and_null(self, spark):
        assert hll.HyperLogLog.build(items(spark, 0), "x").cardinality().first()[0] == 0
        df = spark.createDataFrame([("a", None), ("a", "v"), ("b", None)], "k string, x string")
        assert [tuple(r) for r in hll.HyperLogLog.build(df, "x", ("k",)).cardinality().collect()] == [("a", 1)]

    def test_save_and_load(self, spark, tmp_path):
        a = hll.HyperLogLog.build(items(spark, 50), "x", (), 10)
        a.save(str(tmp_path / "s"))
        assert hll.HyperLogLog.load(spark.read.parquet(str(tmp_path / "s"))).equals(a)

    def test_bytes(self, spark):
        s = hll.HyperLogLog.build(items(spark, 100), "x", (), 6)
        raw = bytes(hll.to_bytes(s).first()[0])
        want = registers([f"item_{i}" for i in range(100)], 6)
        assert raw == bytes([6, *[want.get(i, 0) for i in range(64)]])
        text = hll.to_bytes(s).select(hll.serialize(F.col("bytes")).alias("m"), hll.serialize(F.col("bytes"), "base64").alias("b"))
        r = text.first()
        assert r.m == "%%%" + base64.b64encode(raw).decode() and r.b == base64.b64encode(raw).decode()
        for c in ("m", "b"):
            cells = hll.from_bytes(text.select(hll.from_text(F.col(c)).alias("x")), "x")
            assert {q.idx: q["rank"] for q in cells.collect()} == want
        with pytest.raises(ValueError):
            hll.serialize(F.col("bytes"), "pickle")
        bad = spark.createDataFrame([("%%%!!",), ("?",), ("%%%" + base64.b64encode(b"\x06abc").decode(),)], "t string")
        assert hll.from_bytes(bad.select(hll.from_text(F.col("t")).alias("x")), "x").count() == 0


class TestBloom:
    def test_sizing(self):
        assert bloom.sizing(1000, 0.01) == (9586, 7) and bloom.sizing(10_000, 0.01) == (95851, 7)
        for bad in ((0, 0.1), (5, 0.0), (5, 1.0)):
            with pytest.raises(ValueError):
                bloom.sizing(*bad)

    def test_bits_equal_brute_force(self, spark):
        m, k = bloom.sizing(50, 0.05)
        want = {(h64(f"0:item_{i}") % m + j * (h64(f"1:item_{i}") % m)) % m for i in range(40) for j in range(k)}
        f = bloom.BloomFilter.build(items(spark, 40), "x", (), 50, 0.05)
        assert {r.bit for r in f.df.collect()} == want
        words = {r.word: r.bits for r in f.words().collect()}
        assert {w * 64 + j for w, b in words.items() for j in range(64) if b >> j & 1} == want

    @pytest.mark.parametrize("cap,n,rate,most", [(100, 50, 0.01, 0.03), (1000, 1000, 0.01, 0.02), (10_000, 5000, 0.001, 0.005)])
    def test_membership(self, spark, cap, n, rate, most):
        f = bloom.BloomFilter.build(items(spark, n), "x", (), cap, rate)
        got = f.probe(items(spark, n + 4000), "x").groupBy((F.substring("x", 6, 20).cast("long") < n).alias("truly")).agg(F.avg(F.col("maybe").cast("int")).alias("share")).collect()
        share = {r.truly: r.share for r in got}
        assert share[True] == 1.0 and share[False] <= most

    def test_holders(self, spark):
        rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", None)], "k string, x string")
        f = bloom.BloomFilter.build(rows, "x", ("k",), 100, 0.001)
        got = f.holders(spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "x string"), "x")
        assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "y")]

    def test_merge_and_saturation(self, spark):
        a, b = (bloom.BloomFilter.build(items(spark, 100, s), "x", (), 500) for s in (0, 50))
        assert (a + b).equals(bloom.BloomFilter.build(items(spark, 150), "x", (), 500))
        r = a.saturation().first()
        assert r.saturation == pytest.approx(r.bits_set / a.params["bits"]) and r.fpr_from_saturation == pytest.approx(r.saturation ** a.params["hashes"])
        with pytest.raises(ValueError):
            a + bloom.BloomFilter.build(items(spark, 5), "x", (), 600)


class TestCountMin:
    def test_never_below_and_close(self, spark):
        rows = spark.range(3000).select((F.col("id") % F.lit(97)).alias("x"))
        w, d = cms.sizing(0.01, 0.01)
        assert (w, d) == (272, 5)
        got = cms.CountMin.build(rows, "x", (), w, d).estimates(spark.range(120).toDF("x"), "x").collect()
        for r in got:
            true = len([1 for i in range(3000) if i % 97 == r.x])
            assert true <= r.estimate <= true + 0.01 * 3000

    def test_cells_equal_brute_force(self, spark):
        want = {}
        for i in range(20):
            for r in range(3):
                c = (r, h64(f"{r}:item_{i}") % 50)
                want[c] = want.get(c, 0) + 1
        s = cms.CountMin.build(items(spark, 20), "x", (), 50, 3)
        assert {(r.row, r.col): r.cnt for r in s.df.collect()} == want and s.total().first().total == 20

    def test_merge_weights_and_heavy_hitters(self, spark):
        df = spark.createDataFrame([("a", 100), ("b", 5)], "x string, n long")
        s = cms.CountMin.build(df, "x", (), 200, 4, "n")
        assert [tuple(r) for r in (s + s).heavy_hitters(df, "x", 200).select("x", "estimate").collect()] == [("a", 200)]
        with pytest.raises(ValueError):
            s + cms.CountMin.build(df, "x", (), 100, 4)
        with pytest.raises(ValueError):
            cms.CountMin.build(df, "x", (), 0, 4)


class TestTopK:
    def test_top_with_ties(self, spark):
        df = spark.createDataFrame([("a", 70), ("b", 65), ("c", 20), ("d", 20), (None, 99)], "x string, n long")
        t = topk.TopK.build(df, "x", (), 3, "n")
        assert [(r.item, r.freq, r["rank"]) for r in t.top().orderBy("rank").collect()] == [("a", 70, 1), ("b", 65, 2), ("c", 20, 3)]
        merged = t + topk.TopK.build(spark.createDataFrame([("e", 500), ("d", 1)], "x string, n long"), "x", (), 3, "n")  # new items after a merge
        assert [r.item for r in (merged + t).top(2).orderBy("rank").collect()] == ["e", "a"]
        asked = spark.createDataFrame([("d",), ("zz",), ("a",)], "x string")
        assert {r.x: r.freq for r in t.estimates(asked, "x").collect()} == {"d": 20, "zz": 0, "a": 70}
        assert [r.x for r in t.contains(asked, "x").collect()] == ["a"]
        with pytest.raises(ValueError):
            topk.TopK.build(df, "x", (), 0)

    def test_bounded_memory_form(self, spark):
        df = spark.range(1000).select((F.col("id") % F.lit(10) % F.lit(4)).alias("x"))
        assert {r.item for r in topk.approx_top(df, "x", 2).collect()} <= {0, 1, 2, 3}


class TestQuantiles:
    @pytest.mark.parametrize("kind", ["uniform", "normal", "skewed"])
    def test_digest_error(self, spark, kind):
        rng = np.random.default_rng(1)
        x = {"uniform": rng.uniform(0, 1000, 20_000), "normal": rng.normal(100, 20, 20_000), "skewed": rng.exponential(10, 20_000)}[kind]
        df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "v double, k int")
        got = quantile.TDigest.build(df, "v").quantiles({"p50": 0.5, "p99": 0.99, "p999": 0.999, "lo": 0.0, "hi": 1.0}).first()
        for n, q, e in (("p50", 0.5, 0.02), ("p99", 0.99, 0.02), ("p999", 0.999, 0.05)):
            assert abs(got[n] - np.quantile(x, q)) <= e * abs(np.quantile(x, q))
        assert got.lo == x.min() and got.hi == x.max() and got.n == 20_000
        grouped = quantile.TDigest.build(df, "v", ("k",))
        assert grouped.df.count() == 2 and all(len(r.centroids) <= 200 for r in grouped.df.collect())

    def test_merge(self, spark):
        parts = [quantile.TDigest.build(spark.range(s, s + 1000).select(F.col("id").cast("double").alias("v")), "v") for s in (0, 1000, 2000)]
        m = sum(parts)
        assert m.df.first().n == 3000 and len(m.df.first().centroids) <= 200
        assert abs(m.quantiles({"p50": 0.5}).first().p50 - 1500) < 30 and abs(m.cdf({"c": 600.0}).first().c - 0.2) < 0.02
        with pytest.raises(ValueError):
            parts[0] + quantile.TDigest.build(spark.range(3).select(F.col("id").cast("double").alias("v")), "v", (), 50)
        with pytest.raises(ValueError):
            parts[0].quantiles({"x": 1.5})

    def test_empty_and_null(self, spark):
        df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
        assert quantile.TDigest.build(df, "v").df.count() == 0

    def test_stepwise_small(self, spark):
        df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
        q = lambda p: quantile.stepwise_quantile(df, "v", p).first().q
        assert (q(0.0), q(0.25), q(0.5), q(0.6), q(1.0)) == (10.0, 10.0, 20.0, pytest.approx(24.0), 40.0)
        assert math.isclose(df.agg(quantile.cdf_at("v", 25.0).alias("c")).first().c, 0.5)


def test_sized_bloom_queries_keep_their_rate(spark, tmp_path):
    from sumfold.plans import registry

    rows = spark.range(6000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 2 as int)) as ts", "id as user_id", "if(id % 2 = 0, 'error', 'view') as event_type", "95.0d as value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path))
    got = run("bloom_sized_membership").collect()
    assert len(got) == 6000 and all(r.maybe for r in got if r.truly) and sum(r.maybe for r in got if not r.truly) < 0.03 * 3000
    days = run("bloom_sized_user_days").collect()
    assert len(days) == 6000 and sum(r.days - 1 for r in days) < 0.03 * 6000
    assert run("bloom_sized_merge_saturation").first().fpr_from_saturation < 0.02
    assert {r.event_type for r in run("bloom_sized_bits").select("event_type").distinct().collect()} == {"error", "view"}


@pytest.mark.parametrize("cell_rows", [1_000_000, 7])
def test_exact_quantiles_in_cells(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(quantile, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(3)
    rows = [(None if k == 2 else k, float(x)) for k, x in zip(rng.integers(0, 3, 400).tolist(), rng.integers(0, 60, 400).tolist(), strict=True)]
    rows += [(0, 5.0)] * 300 + [(7, None)] * 2 + [(0, None), (8, 1.5)]
    df = spark.createDataFrame(rows, "k long, x double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: tuple(r)[1:] for r in quantile.exact_quantiles(df, "x", qs, ("k",)).collect()}
    for k in (0, 1, None, 8):
        want = np.percentile([x for g, x in rows if g == k and x is not None], [100 * q for q in qs.values()])
        assert np.allclose(got[k], want)
    assert got[7] == (None,) * 5 and len(got) == 5
    assert np.allclose(quantile.exact_quantiles(df, "x", qs).first(), np.percentile([x for _, x in rows if x is not None], [100 * q for q in qs.values()]))
    assert quantile.exact_quantiles(df.limit(0), "x", qs, ("k",)).collect() == [] and quantile.exact_quantiles(df.limit(0), "x", qs).collect() == [(None,) * 5]
