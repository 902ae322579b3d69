"""Queries over distinct-count, membership, frequency and quantile sketches. The SQL twins compute the same cells from the same hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sumfold.operators import bloom, cms, hll, quantile, sketch, topk
from sumfold.plans.registry import query
from sumfold.sources.tables import retain, table


def _h(x: str) -> str:
    return f"('0x' || substr(sha256({x}), 1, 16))::UBIGINT"


def hll_cells(source: str, item: str, keys: str, p: int) -> str:
    """SQL of the registers (keys, idx, rank)."""
    return f"""SELECT {keys}{', ' if keys else ''}(h & {(1 << p) - 1})::INTEGER AS idx, max(least(64 - length(ltrim(bin(h), '0')), {64 - p}) + 1)::INTEGER AS rank
               FROM (SELECT *, {_h(f'{item}::VARCHAR')} AS h FROM {source}) GROUP BY ALL"""


def hll_estimate(p: int) -> str:
    """SQL estimate over grouped register rows."""
    m = 1 << p
    raw = f"({hll.alpha(m) * m * m!r} / (sum(pow(2.0, -rank)) + ({m} - count(*))))"
    return f"floor(CASE WHEN {raw} <= {2.5 * m} AND count(*) < {m} THEN {m} * ln({m} / ({m} - count(*))) ELSE {raw} END)::BIGINT"


@query(f"WITH r AS ({hll_cells('events', 'user_id', 'event_type', 14)}) SELECT event_type, {hll_estimate(14)} AS users FROM r GROUP BY event_type")
def hll_unique_users_by_event_type(spark, d):
    return hll.HyperLogLog.build(table(spark, d, "events"), "user_id", ("event_type",)).cardinality("users")


@query(hll_cells("events", "user_id", "event_type", 12))
def hll_registers(spark, d):
    return hll.HyperLogLog.build(table(spark, d, "events"), "user_id", ("event_type",), 12).df


@query(f"WITH r AS ({hll_cells('events', 'user_id', '', 12)}) SELECT 'all' AS scope, {hll_estimate(12)} AS users, {hll_estimate(12)} AS bulk FROM r")
def hll_merge_equals_bulk(spark, d):
    e = table(spark, d, "events")
    parts = [hll.HyperLogLog.build(e.where(F.pmod("event_id", F.lit(4)) == i), "user_id", (), 12) for i in range(4)]
    merged, bulk = sketch.merge_all(parts).cardinality("users"), hll.HyperLogLog.build(e, "user_id", (), 12).cardinality("bulk")
    key = F.lit("all").alias("scope")
    return merged.select(key, "users").join(bulk.select(key, "bulk"), "scope")


@query(f"""
    WITH r AS ({hll_cells('(SELECT user_id, ts::DATE AS day FROM events)', 'user_id', 'day', 12)}), d AS (SELECT DISTINCT day FROM r),
    w AS (SELECT d.day, idx, max(rank) AS rank FROM d JOIN r ON r.day BETWEEN d.day - 6 AND d.day GROUP BY ALL) SELECT day, {hll_estimate(12)} AS users_7d FROM w GROUP BY day
""")
def hll_daily_trailing_7d(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = hll.HyperLogLog.build(e, "user_id", ("day",), 12)
    ahead = daily.df.select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("_i"), "day", "idx", "rank").select(F.date_add("day", F.col("_i")).alias("day"), "idx", "rank")
    known = daily.df.select("day").distinct()
    return hll.HyperLogLog(hll.HyperLogLog._reduced(ahead.join(known, "day"), ("day",)), ("day",), precision=12).cardinality("users_7d")


_month = "(SELECT user_id, ts::DATE AS day FROM events WHERE ts::DATE > (SELECT max(ts)::DATE FROM events) - {n})"


@query(" UNION ALL ".join(f"SELECT '{name}' AS span, (SELECT {hll_estimate(12)} FROM ({hll_cells(_month.format(n=n), 'user_id', '', 12)})) AS users" for name, n in (("daily", 1), ("weekly", 7), ("monthly", 30))))
def uniques_with_retention(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = None
    for name, n in (("daily", 1), ("weekly", 7), ("monthly", 30)):
        one = hll.HyperLogLog.build(retain(e, n), "user_id", (), 12).cardinality("users").select(F.lit(name).alias("span"), "users")
        out = one if out is None else out.unionByName(one)
    return out


_regs = f"SELECT event_type, list(rank ORDER BY idx) AS ranks, list(idx ORDER BY idx) AS idxs FROM ({hll_cells('events', 'user_id', 'event_type', 8)}) GROUP BY event_type"


@query(f"""
    WITH g AS ({_regs}), s AS (SELECT event_type, '08' || list_aggregate(list_transform(range(256), lambda i: CASE WHEN list_contains(idxs, i::INTEGER) THEN printf('%02X', list_extract(ranks, list_position(idxs, i::INTEGER))) ELSE '00' END), 'string_agg', '') AS hx FROM g)
    SELECT event_type, '%%%' || to_base64(unhex(hx)) AS magic, 257::INTEGER AS bytes, (SELECT sum(x)::BIGINT FROM (SELECT unnest(ranks) AS x)) AS rank_sum FROM s JOIN g USING (event_type)
""")
def hll_magic_roundtrip(spark, d):
    packed = hll.to_bytes(hll.HyperLogLog.build(table(spark, d, "events"), "user_id", ("event_type",), 8))
    text = packed.withColumn("magic", hll.serialize(F.col("bytes"))).withColumn("back", hll.from_text(F.col("magic")))
    cells = hll.from_bytes(text, "back", ("event_type", "magic"))
    sizes = text.select("event_type", F.octet_length("back").alias("bytes"))
    return cells.groupBy("event_type", "magic").agg(F.sum("rank").alias("rank_sum")).join(sizes, "event_type")


_BITS, _HASHES = bloom.sizing(200, 0.01)


def _bits(source: str, item: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    h = lambda s: f"({_h(f'{s!r} || {item}::VARCHAR')} % {_BITS})::BIGINT"
    return f"SELECT DISTINCT {k}((a + i * b) % {_BITS})::BIGINT AS bit FROM (SELECT DISTINCT {k}{h('0:')} AS a, {h('1:')} AS b FROM {source}), range({_HASHES}) AS r(i)"


@query(_bits("events", "user_id", "event_type"))
def bloom_bits(spark, d):
    return bloom.BloomFilter.build(table(spark, d, "events"), "user_id", ("event_type",), 200, 0.01).df


@query(f"""
    WITH f AS ({_bits("(SELECT * FROM events WHERE event_type = 'error' AND value > 90)", 'user_id')}), p AS (SELECT DISTINCT user_id AS u FROM events),
    n AS (SELECT u, ((a + i * b) % {_BITS}) AS bit FROM (SELECT u, ({_h("'0:' || u::VARCHAR")} % {_BITS})::BIGINT AS a, ({_h("'1:' || u::VARCHAR")} % {_BITS})::BIGINT AS b FROM p), range({_HASHES}) AS r(i))
    SELECT u AS user_id, bool_and(bit IN (SELECT bit FROM f)) AS maybe, u IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) AS truly FROM n GROUP BY u
""")
def bloom_membership(spark, d):
    e = table(spark, d, "events")
    held = e.where("event_type = 'error' and value > 90")
    f = bloom.BloomFilter.build(held, "user_id", (), 200, 0.01)
    truth = held.select("user_id", F.lit(True).alias("truly")).distinct()
    return f.probe(e.select("user_id").distinct(), "user_id").join(truth, "user_id", "left").withColumn("truly", F.coalesce("truly", F.lit(False)))


@query(f"""
    SELECT count(*) AS bits_set, round(count(*) / {_BITS}.0, 8) AS saturation, round(pow(1 - exp(-{_HASHES} * (count(*) / {_BITS}.0)), {_HASHES}), 8) AS expected_fpr, round(pow(count(*) / {_BITS}.0, {_HASHES}), 8) AS fpr_from_saturation
    FROM ({_bits('events', 'user_id')})
""")
def bloom_merge_saturation(spark, d):
    e = table(spark, d, "events")
    parts = [bloom.BloomFilter.build(e.where(F.col("event_type") == t), "user_id", (), 200, 0.01) for t in ("view", "click", "error", "purchase", "signup")]
    s = sum(parts).saturation()
    return s.select("bits_set", *[F.round(c, 8).alias(c) for c in ("saturation", "expected_fpr", "fpr_from_saturation")])


@query(f"""
    WITH f AS ({_bits('(SELECT user_id, ts::DATE AS day FROM events)', 'user_id', 'day')}), n AS (SELECT u, ((a + i * b) % {_BITS}) AS bit FROM (SELECT u, ({_h("'0:' || u::VARCHAR")} % {_BITS})::BIGINT AS a, ({_h("'1:' || u::VARCHAR")} % {_BITS})::BIGINT AS b FROM (SELECT DISTINCT user_id AS u FROM events)), range({_HASHES}) AS r(i)),
    k AS (SELECT u, count(DISTINCT bit) AS need FROM n GROUP BY u), m AS (SELECT u, day, count(DISTINCT bit) AS hit FROM n JOIN f USING (bit) GROUP BY ALL)
    SELECT u AS user_id, count(*) AS days FROM m JOIN k USING (u) WHERE hit = need GROUP BY u
""")
def bloom_user_days(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    f = bloom.BloomFilter.build(e, "user_id", ("day",), 200, 0.01)
    return f.holders(e.select("user_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("days"))


def _sized(df, keys=()):
    """A filter of 1 % false positives for as many users as the table holds."""
    return bloom.BloomFilter.build(df, "user_id", keys, bloom.capacity(df, "user_id", keys), 0.01)


@query()
def bloom_sized_membership(spark, d):
    """bloom_membership with a filter sized from the table."""
    e = table(spark, d, "events")
    held = e.where("event_type = 'error' and value > 90")
    truth = held.select("user_id", F.lit(True).alias("truly")).distinct()
    return _sized(held).probe(e.select("user_id").distinct(), "user_id").join(truth, "user_id", "left").withColumn("truly", F.coalesce("truly", F.lit(False)))


@query()
def bloom_sized_user_days(spark, d):
    """bloom_user_days with filters sized from the fullest day."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return _sized(e, ("day",)).holders(e.select("user_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("days"))


@query()
def bloom_sized_bits(spark, d):
    """bloom_bits with filters sized from the fullest event type."""
    return _sized(table(spark, d, "events"), ("event_type",)).df


@query()
def bloom_sized_merge_saturation(spark, d):
    """bloom_merge_saturation with filters sized from all users, so that the merged one keeps its rate."""
    e = table(spark, d, "events")
    n = bloom.capacity(e, "user_id")
    parts = [bloom.BloomFilter.build(e.where(F.col("event_type") == t), "user_id", (), n, 0.01) for t in ("view", "click", "error", "purchase", "signup")]
    s = sum(parts).saturation()
    return s.select("bits_set", *[F.round(c, 8).alias(c) for c in ("saturation", "expected_fpr", "fpr_from_saturation")])


_W, _D = 272, 5


def _cells(source: str, item: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"SELECT {k}r::INTEGER AS row, ({_h(f"r::VARCHAR || ':' || {item}::VARCHAR")} % {_W})::BIGINT AS col, sum(n)::BIGINT AS cnt FROM (SELECT {k}{item}, count(*) AS n FROM {source} GROUP BY ALL), range({_D}) AS t(r) GROUP BY ALL"


def _estimates(source: str, item: str) -> str:
    return f"""SELECT u AS {item}, min(coalesce(cnt, 0))::BIGINT AS estimate FROM (SELECT u, r::INTEGER AS row, ({_h("r::VARCHAR || ':' || u::VARCHAR")} % {_W})::BIGINT AS col
               FROM (SELECT DISTINCT {item} AS u FROM {source}), range({_D}) AS t(r)) LEFT JOIN ({_cells(source, item)}) USING (row, col) GROUP BY u"""


@query(_cells("events", "user_id", "event_type"))
def cms_cells(spark, d):
    return cms.CountMin.build(table(spark, d, "events"), "user_id", ("event_type",), *cms.sizing(0.01, 0.01)).df


@query(f"SELECT user_id, estimate, n AS exact, estimate - n AS over FROM ({_estimates('events', 'user_id')}) JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) USING (user_id)")
def cms_estimate_vs_exact(spark, d):
    e = table(spark, d, "events")
    counts = e.groupBy("user_id").agg(F.count("*").alias("exact"))
    got = cms.CountMin.build(e, "user_id", (), _W, _D).estimates(counts, "user_id")
    return got.withColumn("over", F.col("estimate") - F.col("exact"))


@query(f"SELECT user_id, estimate FROM ({_estimates('events', 'user_id')}) WHERE estimate >= 80")
def cms_heavy_hitters(spark, d):
    e = table(spark, d, "events")
    parts = [cms.CountMin.build(e.where(F.pmod("event_id", F.lit(3)) == i), "user_id", (), _W, _D) for i in range(3)]
    return sketch.merge_all(parts).heavy_hitters(e.select("user_id").distinct(), "user_id", 80)


@query(f"SELECT user_id, estimate, row_number() OVER (ORDER BY estimate DESC, user_id)::INTEGER AS rank FROM ({_estimates('events', 'user_id')}) QUALIFY rank <= 10")
def cms_candidates(spark, d):
    e = table(spark, d, "events")
    best = cms.CountMin.build(e, "user_id", (), _W, _D).estimates(e.select("user_id").distinct(), "user_id").orderBy(F.desc("estimate"), "user_id").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("estimate"), "user_id")))


@query("SELECT user_id AS item, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, user_id)::INTEGER AS rank FROM events GROUP BY user_id QUALIFY rank <= 10")
def topk_items(spark, d):
    return topk.TopK.build(table(spark, d, "events"), "user_id", (), 10).top()


@query("SELECT event_type, user_id AS item, count(*) AS freq, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id)::INTEGER AS rank FROM events GROUP BY event_type, user_id QUALIFY rank <= 5")
def topk_per_group(spark, d):
    return topk.TopK.build(table(spark, d, "events"), "user_id", ("event_type",), 5).top()


@query("SELECT l_partkey AS item, sum(l_quantity)::BIGINT AS freq, row_number() OVER (ORDER BY sum(l_quantity)::BIGINT DESC, l_partkey)::INTEGER AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 20")
def topk_merge(spark, d):
    li = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    parts = [topk.TopK.build(li.where(F.col("l_returnflag") == f), "l_partkey", (), 20, "q") for f in ("A", "N", "R")]
    return sum(parts).top()


@query("SELECT user_id, count(*) AS freq, count(*) >= (SELECT min(freq) FROM (SELECT count(*) AS freq FROM events GROUP BY user_id ORDER BY freq DESC, user_id LIMIT 10)) AND row_number() OVER (ORDER BY count(*) DESC, user_id) <= 10 AS top FROM events GROUP BY user_id")
def topk_lookup(spark, d):
    e = table(spark, d, "events")
    t = topk.TopK.build(e, "user_id", (), 10)
    users = t.estimates(e.select("user_id").distinct(), "user_id")
    top = t.contains(users, "user_id").select("user_id", F.lit(True).alias("top"))
    return users.join(top, "user_id", "left").withColumn("top", F.coalesce("top", F.lit(False)))


@query("""
    WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, lag(value) OVER (PARTITION BY user_id ORDER BY value) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(CASE WHEN r = 1 THEN value ELSE b + (0.9 * n - (r - 1)) * (value - b) END, 6) AS p90 FROM s WHERE r - 1 < 0.9 * n AND 0.9 * n <= r
""")
def quantile_small_n(spark, d):
    e = table(spark, d, "events")
    return quantile.stepwise_quantile(e, "value", 0.9, ("user_id",), "p90").withColumn("p90", F.round("p90", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def quantile_exact(spark, d):
    q = quantile.exact_quantiles(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("event_type",))
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT event_type, round(avg((value <= 10)::INT), 8) AS cdf_10, round(avg((value <= 50)::INT), 8) AS cdf_50, round(avg((value <= 100)::INT), 8) AS cdf_100 FROM events GROUP BY 1")
def cdf_thresholds(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(quantile.cdf_at("value", p), 8).alias(f"cdf_{p}") for p in (10, 50, 100)])


@query()
def tdigest_grouped(spark, d):
    t = quantile.TDigest.build(table(spark, d, "events"), "value", ("event_type",))
    return t.quantiles({"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})


@query()
def tdigest_merged_cdf(spark, d):
    e = table(spark, d, "events")
    parts = [quantile.TDigest.build(e.where(F.pmod("event_id", F.lit(3)) == i), "value", ("event_type",)) for i in range(3)]
    return sum(parts).cdf({"below_10": 10.0, "below_50": 50.0, "below_100": 100.0})


@query()
def native_sketches(spark, d):
    """The engine's own packed sketches: distinct counts, quantiles and heavy hitters in bounded memory."""
    return table(spark, d, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users_hll"), F.approx_count_distinct("user_id").alias("users_hpp"), F.percentile_approx("value", 0.5).alias("p50"))


@query()
def native_set_algebra(spark, d):
    """Users who both viewed and clicked, from the engine's theta sketches."""
    e = table(spark, d, "events")
    of = lambda t: F.theta_sketch_agg(F.when(F.col("event_type") == t, F.col("user_id")))
    s = e.agg(of("view").alias("v"), of("click").alias("c"))
    n = F.theta_sketch_estimate
    return s.select(n("v").alias("viewed"), n("c").alias("clicked"), n(F.theta_intersection("v", "c")).alias("both"), n(F.theta_union("v", "c")).alias("either"), n(F.theta_difference("v", "c")).alias("only_viewed"))


@query(hll_cells("events", "user_id", "event_type", 6))
def hll_json_roundtrip(spark, d):
    s = hll.HyperLogLog.build(table(spark, d, "events"), "user_id", ("event_type",), 6)
    return hll.from_json(hll.to_json(s), "json", ("event_type",)).select("event_type", "idx", "rank")


@query()
def native_quantiles(spark, d):
    """Quantiles of mergeable KLL sketches, built by day and merged by event type."""
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.kll_sketch_agg_double("value").alias("s"))
    merged = daily.groupBy("event_type").agg(F.kll_merge_agg_double("s").alias("s"))
    return merged.select("event_type", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("p50"), F.kll_sketch_get_quantile_double("s", F.lit(0.95)).alias("p95"))
