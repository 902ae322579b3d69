"""Workload queries: dashboards, rollups and streaming forms that combine several aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sumfold.operators import cms, exact, hll, quantile, topk
from sumfold.plans.registry import query
from sumfold.plans.sketches import _D, _W, _estimates, hll_cells, hll_estimate
from sumfold.sources.tables import table
from sumfold.streaming import rollups


@query(f"""
    SELECT e.event_type, n, users, high, low, total, users_est FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(max(value), 6) AS high, round(min(value), 6) AS low, round(sum(value), 4) AS total FROM events GROUP BY 1) e
    JOIN (SELECT event_type, {hll_estimate(14)} AS users_est FROM ({hll_cells('events', 'user_id', 'event_type', 14)}) GROUP BY 1) h USING (event_type)
""")
def event_dashboard(spark, d):
    e = table(spark, d, "events")
    exacts = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.max("value"), 6).alias("high"), F.round(F.min("value"), 6).alias("low"), F.round(F.sum("value"), 4).alias("total"))
    return exacts.join(hll.HyperLogLog.build(e, "user_id", ("event_type",)).cardinality("users_est"), "event_type")


@query("""
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
           CASE WHEN quantile_cont(value, 0.95) < 200 THEN 'PASS' ELSE 'FAIL' END AS sla FROM events GROUP BY event_type
""")
def sla_dashboard(spark, d):
    p = quantile.exact_quantiles(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("event_type",))
    return p.select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")], F.when(F.col("p95") < 200, "PASS").otherwise("FAIL").alias("sla"))


@query("SELECT count(DISTINCT url) AS crawled, count(*) - count(DISTINCT url) AS skipped, count(*) AS pages FROM pages")
def crawler_dedup(spark, d):
    """One page of each URL is crawled: an exact distinct, which no false positive can shorten."""
    per = table(spark, d, "pages").where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("crawled"), (F.sum("n") - F.count("*")).alias("skipped"), F.sum("n").alias("pages"))


@query(f"""
    WITH c AS ({_estimates('events', 'user_id')}), t AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20)
    SELECT user_id, estimate, estimate >= 85 AS suspicious FROM t JOIN c USING (user_id)
""")
def suspicious_users(spark, d):
    e = table(spark, d, "events")
    candidates = topk.TopK.build(e, "user_id", (), 20).top().select(F.col("item").alias("user_id"))
    got = cms.CountMin.build(e, "user_id", (), _W, _D).estimates(candidates, "user_id")
    return got.select("user_id", "estimate", (F.col("estimate") >= 85).alias("suspicious"))


_TOKENS = "(SELECT unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0)) AS token FROM documents)"


def _tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 0)).alias("token"))


@query(f"""
    WITH x AS (SELECT token, count(*) AS n FROM {_TOKENS} GROUP BY 1 ORDER BY n DESC, token LIMIT 20), c AS (SELECT token, n FROM (SELECT token, count(*) AS n FROM {_TOKENS} GROUP BY 1)),
    k AS (SELECT r::INTEGER AS row, (('0x' || substr(sha256(r::VARCHAR || ':' || token), 1, 16))::UBIGINT % 2000)::BIGINT AS col, sum(n)::BIGINT AS cnt FROM c, range(5) AS t(r) GROUP BY ALL)
    SELECT token, n AS exact, min(cnt) AS estimate, min(cnt) - n AS over FROM (SELECT token, n, r::INTEGER AS row, (('0x' || substr(sha256(r::VARCHAR || ':' || token), 1, 16))::UBIGINT % 2000)::BIGINT AS col FROM x, range(5) AS t(r)) JOIN k USING (row, col) GROUP BY token, n
""")
def trending_tokens(spark, d):
    tokens = _tokens(spark, d)
    counts = tokens.groupBy("token").agg(F.count("*").alias("exact"))
    top = topk.TopK.build(counts, "token", (), 20, "exact").top().select(F.col("item").alias("token"), F.col("freq").alias("exact"))
    got = cms.CountMin.build(counts, "token", (), 2000, 5, "exact").estimates(top, "token")
    return got.withColumn("over", F.col("estimate") - F.col("exact"))


@query("""
    WITH h AS (SELECT doc_id, md5(text) AS h, source FROM documents), c AS (SELECT h, count(*) AS copies, min(doc_id) AS first FROM h GROUP BY h), b AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT source, count(*) AS docs, sum((doc_id <> first)::INT)::BIGINT AS duplicates, sum((b.doc_id IS NOT NULL)::INT)::BIGINT AS blocked FROM h JOIN c USING (h) LEFT JOIN b USING (doc_id) GROUP BY source
""")
def spam_block(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "source")
    c = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    b = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("bad"))
    all_ = h.join(c, "h").join(b, "doc_id", "left")
    return all_.groupBy("source").agg(F.count("*").alias("docs"), F.sum((F.col("doc_id") != F.col("first")).cast("long")).alias("duplicates"), F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("blocked"))


_DOMAIN = "split_part(split_part(url, '://', 2), '/', 1)"


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS embeds, count(DISTINCT url) AS urls, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1")
def domain_influence(spark, d):
    p = table(spark, d, "pages").withColumn("domain", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    return p.groupBy("domain").agg(F.count("*").alias("embeds"), F.count_distinct("url").alias("urls"), F.count_distinct("page_id").alias("pages"))


@query(f"""
    WITH l AS (SELECT o_custkey, l_suppkey, o_orderkey, o_totalprice, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey), e AS (SELECT o_custkey, {hll_estimate(12)} AS suppliers_est FROM ({hll_cells('l', 'l_suppkey', 'o_custkey', 12)}) GROUP BY 1)
    SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, sum(l_quantity)::BIGINT AS quantity, round(avg(l_quantity), 6) AS mean_quantity, max(o_totalprice) AS high, min(o_totalprice) AS low, count(DISTINCT l_suppkey) AS suppliers, any_value(suppliers_est) AS suppliers_est
    FROM l JOIN e USING (o_custkey) GROUP BY o_custkey
""")
def customer_engagement(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    x = o.join(li, li.l_orderkey == o.o_orderkey).select("o_custkey", "o_orderkey", "o_totalprice", "l_suppkey", "l_quantity")
    exacts = x.groupBy("o_custkey").agg(
        F.count_distinct("o_orderkey").alias("orders"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"),
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count_distinct("l_suppkey").alias("suppliers"),
    )
    return exacts.join(hll.HyperLogLog.build(x, "l_suppkey", ("o_custkey",), 12).cardinality("suppliers_est"), "o_custkey")


@query("""
    WITH c AS (SELECT user_id % 10 AS campaign, event_type, user_id, value FROM events)
    SELECT campaign, count(*) FILTER (WHERE event_type = 'view') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS conversions,
           round(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view'), 6) AS ctr, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'click'), 6) AS cvr,
           round(sum(value) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'click'), 5) AS cpc, round(1000 * sum(value) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'view'), 3) AS cpm,
           count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS reach, round(count(*) FILTER (WHERE event_type = 'view') / count(DISTINCT user_id) FILTER (WHERE event_type = 'view'), 6) AS frequency,
           round(quantile_cont(value, 0.95) FILTER (WHERE event_type = 'view'), 6) AS load_p95 FROM c GROUP BY campaign
""")
def campaign_funnel(spark, d):
    e = table(spark, d, "events").withColumn("campaign", F.col("user_id") % 10)
    of = lambda t, x=None: F.when(F.col("event_type") == t, F.lit(1) if x is None else F.col(x))
    m = e.groupBy("campaign").agg(
        F.count(of("view")).alias("impressions"), F.count(of("click")).alias("clicks"), F.count(of("purchase")).alias("conversions"), F.sum(of("click", "value")).alias("spend"),
        F.count_distinct(of("view", "user_id")).alias("reach"),
    )
    p = quantile.exact_quantiles(e.withColumn("load", of("view", "value")), "load", {"p95": 0.95}, ("campaign",)).select(F.col("campaign").alias("_c"), F.round("p95", 6).alias("load_p95"))
    m = m.join(p, F.col("campaign").eqNullSafe(F.col("_c")))
    rate = lambda a, b, k, n: F.round(F.try_divide(k * F.col(a), F.col(b)), n)
    return m.select("campaign", "impressions", "clicks", "conversions", rate("clicks", "impressions", 100.0, 6).alias("ctr"), rate("conversions", "clicks", 100.0, 6).alias("cvr"), rate("spend", "clicks", 1.0, 5).alias("cpc"), rate("spend", "impressions", 1000.0, 3).alias("cpm"), "reach", rate("impressions", "reach", 1.0, 6).alias("frequency"), "load_p95")


@query("""
    WITH p AS (SELECT quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders)
    SELECT CASE WHEN o_totalprice >= p95 THEN 'viral' WHEN o_totalprice >= p75 THEN 'great' WHEN o_totalprice >= p50 THEN 'good' WHEN o_totalprice >= p25 THEN 'below_average' ELSE 'poor' END AS class, count(*) AS n, max(o_totalprice) AS high, min(o_totalprice) AS low
    FROM orders, p GROUP BY 1
""")
def engagement_classes(spark, d):
    o = table(spark, d, "orders")
    p = quantile.exact_quantiles(o, "o_totalprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    x = F.col("o_totalprice")
    named = F.when(x >= F.col("p95"), "viral").when(x >= F.col("p75"), "great").when(x >= F.col("p50"), "good").when(x >= F.col("p25"), "below_average").otherwise("poor")
    return o.join(F.broadcast(p), x.isNotNull()).groupBy(named.alias("class")).agg(F.count("*").alias("n"), F.max(x).alias("high"), F.min(x).alias("low"))  # p is one row


@query("""
    WITH u AS (SELECT (props::JSON->>'$.k') AS url, user_id FROM events)
    SELECT url, count(*) AS clicks, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 6) AS clicks_per_user, rank() OVER (ORDER BY count(*) DESC)::INTEGER AS place FROM u GROUP BY url
""")
def url_clicks(spark, d):
    u = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("url"), "user_id")
    c = u.groupBy("url").agg(F.count("*").alias("clicks"), F.count_distinct("user_id").alias("users"))
    sizes = c.groupBy("clicks").agg(F.count("*").alias("n"))  # few different counts, so the global rank is taken over them
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("clicks")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = sizes.select("clicks", (before + 1).cast("int").alias("place"))
    return c.join(place, "clicks").select("url", "clicks", "users", F.round(F.col("clicks") / F.col("users"), 6).alias("clicks_per_user"), "place")


@query("""
    SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share, round(quantile_cont(value, 0.95), 6) AS p95, round(min(CASE WHEN value > 0 THEN value END), 6) AS low_positive FROM events GROUP BY event_type
""")
def error_report(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min(F.when(F.col("value") > 0, F.col("value"))), 6).alias("low_positive"))
    p = quantile.exact_quantiles(e, "value", {"p95": 0.95}, ("event_type",)).select(F.col("event_type").alias("_t"), F.round("p95", 6).alias("p95"))
    g = g.join(p, F.col("event_type").eqNullSafe(F.col("_t")))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("_all"))), F.col("n") > 0).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("share"), "p95", "low_positive")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, max(user_id) AS top_user FROM events GROUP BY 1")
def window_5min(spark, d):
    w = F.window(F.col("ts"), "5 minutes")
    return table(spark, d, "events").groupBy(w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("user_id").alias("top_user")).select(F.col("window.start").alias("start"), "n", "total", "top_user")


@query("SELECT token, count(*) AS tf FROM (SELECT unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0)) AS token FROM documents) GROUP BY token")
def word_tf(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("tf"))


@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 0)) AS token FROM documents)) GROUP BY token")
def word_df(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 0))
    return table(spark, d, "documents").select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query("""
    SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_region_nation(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_acctbal").alias("high"))


@query(f"""
    WITH x AS (SELECT n_name, r_name, c_mktsegment || '/' || (c_custkey % 500) AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), c AS ({hll_cells('x', 'tag', 'r_name, n_name', 10)})
    SELECT 'nation' AS level, n_name AS name, {hll_estimate(10)} AS tags FROM c GROUP BY n_name UNION ALL SELECT 'region', r_name, {hll_estimate(10)} FROM (SELECT r_name, idx, max(rank) AS rank FROM c GROUP BY ALL) GROUP BY r_name
    UNION ALL SELECT 'global', 'all', {hll_estimate(10)} FROM (SELECT idx, max(rank) AS rank FROM c GROUP BY ALL)
""")
def sketch_hierarchy(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 500).cast("string")).alias("tag"))
    low = hll.HyperLogLog.build(x, "tag", ("r_name", "n_name"), 10)
    nation = low.cardinality("tags").select(F.lit("nation").alias("level"), F.col("n_name").alias("name"), "tags")
    region = low.rollup_to("r_name").cardinality("tags").select(F.lit("region").alias("level"), F.col("r_name").alias("name"), "tags")
    whole = low.rollup_to().cardinality("tags").select(F.lit("global").alias("level"), F.lit("all").alias("name"), "tags")
    return nation.unionByName(region).unionByName(whole)


@query("SELECT ts::DATE AS day, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def daily_uniques_exact(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT ts::DATE AS day, round(sum(value), 4) AS total FROM events GROUP BY 1) SELECT day, total, round(sum(total) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 3) AS trailing FROM s
""")
def trailing_sums(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    w = Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-6, 0)  # a row for each day
    return s.select("day", "total", F.round(F.sum("total").over(w), 3).alias("trailing"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100) GROUP BY 1")
def set_algebra(spark, d):
    e = table(spark, d, "events")
    u = lambda c: e.where(c).select("user_id")
    return u("event_type = 'view'").intersect(u("event_type = 'click'")).subtract(u("event_type = 'purchase' and value > 100")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, text, length(text)::BIGINT AS n FROM conversations")
def json_roundtrip(spark, d):
    c = table(spark, d, "conversations")
    j = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("j")).select(F.from_json("j", "conv_id long, turn long, role string, text string").alias("r"))
    return j.select("r.*").withColumn("n", F.length("text").cast("long"))


def _stream(spark, d):
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    return spark.readStream.schema(schema).parquet(source if source.endswith("/") else d, pathGlobFilter="events.parquet")


def _name(tag):
    return f"{tag}_{uuid.uuid4().hex[:12]}"


@query("SELECT time_bucket(INTERVAL '1 day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_daily_windows(spark, d):
    out = rollups.windowed(rollups.timed(_stream(spark, d)), "1 day", None, ("event_type",))
    return rollups.run_once(out, _name("daily")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH r AS ({hll_cells('events', 'user_id', 'event_type', 12)}) SELECT event_type, {hll_estimate(12)} AS users FROM r GROUP BY event_type")
def streaming_unique_users(spark, d):
    cells = rollups.run_once(rollups.registers(_stream(spark, d), "user_id", ("event_type",), 12), _name("hll"))
    return hll.HyperLogLog(cells, ("event_type",), precision=12).cardinality("users")


@query("SELECT user_id AS item, count(*) AS freq FROM events GROUP BY 1 ORDER BY freq DESC, item LIMIT 10")
def topk_streaming(spark, d):
    return rollups.run_once(rollups.frequencies(_stream(spark, d), "user_id"), _name("freq")).orderBy(F.desc("freq"), "item").limit(10)


@query("SELECT DISTINCT user_id FROM events")
def streaming_dedup(spark, d):
    return rollups.run_once(_stream(spark, d).select("user_id").dropDuplicates(["user_id"]), _name("dedup"), "append")


@query("""
    WITH m AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS last_user FROM conversations GROUP BY 1) SELECT conv_id, coalesce(last_user, -1) AS last_user, last_user IS NOT NULL AS is_some FROM m
""")
def option_get_or_else(spark, d):
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("x"))
    return m.select("conv_id", exact.get_or_else("x", F.lit(-1).cast("long")).alias("last_user"), exact.is_some("x").alias("is_some"))
