"""Queries over exact aggregates, optional values and algebraic laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumfold.operators import algebra, exact
from sumfold.plans.registry import query
from sumfold.sources.tables import table


@query("""
    SELECT event_type, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(max(value), '-inf'::DOUBLE), 6) AS high,
           round(coalesce(min(value), 'inf'::DOUBLE), 6) AS low, round(exp(sum(ln(1 + value / 1e6))), 6) AS growth
    FROM events GROUP BY event_type
""")
def sum_product_min_max(spark, d):
    e = table(spark, d, "events")
    growth = exact.product(1 + F.col("value") / 1e6)
    return e.groupBy("event_type").agg(F.round(exact.total("value"), 4).alias("total"), F.round(exact.largest("value"), 6).alias("high"), F.round(exact.smallest("value"), 6).alias("low"), F.round(growth, 6).alias("growth"))


@query("""
    SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + l_discount, 6) AS added, greatest(l_quantity, l_discount, l_tax) AS high,
           least(l_quantity, l_discount, l_tax) AS low, round(l_quantity * l_discount * l_tax, 6) AS multiplied FROM lineitem
""")
def variadic_numbers(spark, d):
    x = table(spark, d, "lineitem")
    c = ("l_quantity", "l_discount", "l_tax")
    return x.select("l_orderkey", "l_linenumber", F.round(exact.add("l_quantity", "l_tax", "l_discount"), 6).alias("added"), exact.max_of(*c).alias("high"), exact.min_of(*c).alias("low"), F.round(exact.multiply(*c), 6).alias("multiplied"))


@query("SELECT event_type, list_sort(list(DISTINCT user_id)) AS users, count(DISTINCT user_id) AS n FROM events WHERE value > 50 GROUP BY event_type")
def set_union_users(spark, d):
    e = table(spark, d, "events").where("value > 50")
    return e.groupBy("event_type").agg(exact.set_of("user_id").alias("users"), F.count_distinct("user_id").alias("n"))


@query("SELECT event_type, user_id IN (SELECT user_id FROM events WHERE event_type = 'error') AS seen, count(*) AS n FROM events GROUP BY ALL")
def set_membership(spark, d):
    e = table(spark, d, "events")
    errors = e.where("event_type = 'error'").select("user_id", F.lit(True).alias("seen")).distinct()
    return e.join(errors, "user_id", "left").groupBy("event_type", F.coalesce("seen", F.lit(False)).alias("seen")).agg(F.count("*").alias("n"))


@query("""
    SELECT user_id, event_id, pos FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER - 1 AS pos FROM events)
""")
def ordered_timeline(spark, d):
    e = table(spark, d, "events")
    t = e.groupBy("user_id").agg(exact.list_of("event_id", F.struct("ts", "event_id")).alias("events"))
    return t.select("user_id", F.posexplode("events").alias("pos", "event_id"))


@query("""
    SELECT user_id, event_id, event_type, recent FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS recent FROM events) WHERE recent <= 3
""")
def recent_events(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("recent")).where("recent <= 3")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def map_merge_counts(spark, d):
    e = table(spark, d, "events").withColumn("n", F.lit(1).cast("long"))
    return exact.merge_map_rows(e, "user_id", "n", "sum", ("event_type",))


@query("SELECT user_id, round(max(value), 6) AS value FROM events GROUP BY user_id")
def map_merge_max(spark, d):
    return exact.merge_map_rows(table(spark, d, "events"), "user_id", "value", "max").withColumn("value", F.round("value", 6))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def map_last_wins(spark, d):
    return exact.merge_map_rows(table(spark, d, "events"), "user_id", "event_type", "last", order_by="event_id")


@query("""
    WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (user_id)
""")
def map_zip_columns(spark, d):
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    m = lambda t: F.map_from_entries(F.collect_list(F.when(F.col("event_type") == t, F.struct("user_id", "n"))))
    by = e.groupBy(F.pmod("user_id", F.lit(16)).alias("g")).agg(m("view").alias("a"), m("click").alias("b"))
    return by.select(F.explode(exact.merge_maps("a", "b", lambda x, y: x + y)).alias("user_id", "n"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role, text) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def string_concat_ordered(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(exact.string_of("role", F.struct("turn", "role", "text"), ">").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("""
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, CASE WHEN c_nationkey < 5 THEN c_nationkey * 100.0 END, 1.0) AS setting,
           coalesce(CASE WHEN c_acctbal > 5000 THEN 'account' END, CASE WHEN c_nationkey < 5 THEN 'nation' END, 'default') AS origin FROM customer
""")
def option_fallback(spark, d):
    c = table(spark, d, "customer")
    first, second = exact.filter_some("c_acctbal", lambda x: x > 5000), F.when(F.col("c_nationkey") < 5, F.col("c_nationkey") * 100.0)
    origin = exact.or_else(exact.map_some(first, lambda x: F.lit("account")), exact.map_some(second, lambda x: F.lit("nation")), F.lit("default"))
    return c.select("c_custkey", exact.get_or_else(exact.or_else(first, second), 1.0).alias("setting"), origin.alias("origin"))


@query("SELECT event_type, round(sum(CASE WHEN value > 90 THEN value END), 4) AS big, count(CASE WHEN value > 90 THEN 1 END) AS n, bool_or(value > 90) AS any_some FROM events GROUP BY 1")
def option_sum_skip_null(spark, d):
    some = exact.filter_some("value", lambda x: x > 90)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(some), 4).alias("big"), F.count(some).alias("n"), F.bool_or(exact.is_some(some)).alias("any_some"))


@query("SELECT user_id, CASE WHEN count(*) = count(CASE WHEN value > 2 THEN 1 END) THEN count(*) END AS n FROM events GROUP BY user_id")
def option_sequence(spark, d):
    some = exact.filter_some("value", lambda x: x > 2)
    return table(spark, d, "events").groupBy("user_id").agg(F.size(exact.sequence_some(some, "event_id")).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("""
    SELECT event_id, CASE WHEN value >= 50 THEN round(sqrt(value), 6) END AS root, CASE WHEN value >= 50 THEN 'some' ELSE 'none' END AS kind FROM events
""")
def option_filter_map(spark, d):
    big = exact.filter_some("value", lambda x: x >= 50)
    e = table(spark, d, "events")
    return e.select("event_id", exact.map_some(big, lambda x: F.round(F.sqrt(x), 6)).alias("root"), F.when(exact.is_some(big), "some").otherwise("none").alias("kind"))


@query("SELECT user_id, arg_min(value, event_id) FILTER (WHERE value > 50) AS first_big FROM events GROUP BY user_id")
def option_first_some(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(exact.first_some(exact.filter_some("value", lambda x: x > 50), "event_id").alias("first_big"))


def _triples(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("x"))
    a, b, c = n.select(F.col("x").alias("a")), n.select(F.col("x").alias("b")), n.select(F.col("x").alias("c"))
    return a.join(b, F.col("b") >= 0).join(c, F.col("c") >= 0)  # 25 nations: fixed sample values of the law checks


_LAWS = {
    "add": ["associativity", "left_identity", "right_identity", "left_inverse", "right_inverse"],
    "max": ["associativity", "left_identity", "right_identity"],
    "min": ["associativity", "left_identity", "right_identity"],
    "multiply": ["associativity", "left_identity", "right_identity"],
    "integers": ["associativity", "left_identity", "right_identity", "left_inverse", "right_inverse", "commutativity", "times_associativity", "left_distributivity", "right_distributivity", "left_unit", "right_unit"],
    "natural": ["associativity", "left_identity", "right_identity", "commutativity", "times_associativity", "left_distributivity", "right_distributivity", "left_unit", "right_unit", "left_annihilator", "right_annihilator"],
    "tropical": ["associativity", "left_identity", "right_identity", "commutativity", "times_associativity", "left_distributivity", "right_distributivity", "left_unit", "right_unit", "left_annihilator", "right_annihilator"],
    "mean": ["associativity"],
}
_N = "(SELECT n_nationkey::DOUBLE AS {0} FROM nation)"
_FROM = f"FROM {_N.format('a')} CROSS JOIN {_N.format('b')} CROSS JOIN {_N.format('c')}"
_OPS = {
    "add": ("({}+{})", "0.0", "(-{})", None, None), "max": ("greatest({},{})", "'-inf'::DOUBLE", None, None, None), "min": ("least({},{})", "'inf'::DOUBLE", None, None, None), "multiply": ("({}*{})", "1.0", None, None, None),
    "integers": ("({}+{})", "0.0", "(-{})", "({}*{})", "1.0"), "natural": ("({}+{})", "0.0", None, "({}*{})", "1.0"), "tropical": ("least({},{})", "'inf'::DOUBLE", None, "({}+{})", "0.0"), "mean": ("(({}+{})/2)", None, None, None, None),
}


def _law_sql(name: str, law: str) -> str:
    plus, zero, neg, times, one = _OPS[name]
    p = plus.format
    t = times.format if times else None
    sides = {
        "associativity": lambda: (p(p("a", "b"), "c"), p("a", p("b", "c"))), "left_identity": lambda: (p(zero, "a"), "a"), "right_identity": lambda: (p("a", zero), "a"),
        "left_inverse": lambda: (p(neg.format("a"), "a"), zero), "right_inverse": lambda: (p("a", neg.format("a")), zero), "commutativity": lambda: (p("a", "b"), p("b", "a")),
        "times_associativity": lambda: (t(t("a", "b"), "c"), t("a", t("b", "c"))), "left_distributivity": lambda: (t("a", p("b", "c")), p(t("a", "b"), t("a", "c"))),
        "right_distributivity": lambda: (t(p("a", "b"), "c"), p(t("a", "c"), t("b", "c"))), "left_unit": lambda: (t(one, "a"), "a"), "right_unit": lambda: (t("a", one), "a"),
        "left_annihilator": lambda: (t(zero, "a"), zero), "right_annihilator": lambda: (t("a", zero), zero),
    }
    left, right = sides[law]()
    return f"SELECT '{name}' AS algebra, '{law}' AS law, bool_and({left} = {right} OR abs({left} - {right}) < 1e-10) AS holds, count(*) AS checked {_FROM}"


@query(" UNION ALL ".join(_law_sql(n, law) for n, laws in _LAWS.items() for law in laws))
def law_checks(spark, d):
    from functools import reduce

    triples = _triples(spark, d).select(*[F.col(c).cast("double").alias(c) for c in "abc"])
    mean = algebra.Algebra("mean", lambda a, b: (a + b) / 2)  # not associative
    known = [algebra.ADD, algebra.MAX, algebra.MIN, algebra.MULTIPLY, algebra.INTEGERS, algebra.NATURAL, algebra.TROPICAL, mean]
    return reduce(lambda a, b: a.unionByName(b), [x.verify_frame(triples) for x in known])


@query("SELECT event_type, (count(*) - count(*) FILTER (WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAY))::BIGINT AS n FROM events GROUP BY event_type")
def group_retraction(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("ts").alias("t"))
    total = e.groupBy("event_type").agg(F.count("*").alias("n"))
    old = e.join(F.broadcast(first), F.col("ts") < F.col("t") + F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))
    return algebra.retract(total, old, ["event_type"], "n")


@query("""
    SELECT c_nationkey AS i, s_nationkey AS j, sum(qty)::BIGINT AS v FROM (SELECT c_nationkey, l_suppkey, sum(l_quantity)::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
""")
def semiring_natural_matmul(spark, d):
    li, o, c = (table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    left = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("i"), F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("long").alias("v"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("j"), F.lit(1).cast("long").alias("v"))
    return algebra.matrix_product(left, right, algebra.NATURAL)


@query("""
    WITH e AS (SELECT DISTINCT c_nationkey AS i, s_nationkey AS j FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50)
    SELECT DISTINCT a.i, b.j, true AS v FROM e a JOIN e b ON a.j = b.i
""")
def semiring_boolean_reach(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    e = li.where("l_quantity >= 50").join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    e = e.select(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j"), F.lit(True).alias("v")).distinct()
    return algebra.matrix_product(e.withColumnRenamed("j", "k"), e.withColumnRenamed("i", "k"), algebra.BOOLEAN)


@query("""
    WITH a AS (SELECT p_brand AS i, l_suppkey AS k, min(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), b AS (SELECT s_suppkey AS k, s_nationkey AS j, s_acctbal AS v FROM supplier)
    SELECT i, j, round(min(a.v + b.v), 4) AS v FROM a JOIN b USING (k) GROUP BY i, j
""")
def semiring_tropical_path(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    a = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("i"), F.col("l_suppkey").alias("k")).agg(F.min("l_extendedprice").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("j"), F.col("s_acctbal").alias("v"))
    return algebra.matrix_product(a, b, algebra.TROPICAL).withColumn("v", F.round("v", 4))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_discount), 4) AS dot FROM lineitem GROUP BY l_orderkey")
def ring_dot_product(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(algebra.INTEGERS.times(F.col("l_extendedprice"), F.col("l_discount"))), 4).alias("dot"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS folded, coalesce(max(length(text)), 0)::BIGINT AS high FROM conversations GROUP BY conv_id")
def array_folds(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(exact.list_of(F.length("text").cast("long"), F.struct("turn", "role")).alias("n"))
    return lists.select("conv_id", algebra.ADD.fold(F.col("n"), F.lit(0).cast("long")).alias("folded"), algebra.MAX.fold(F.col("n"), F.lit(0).cast("long")).alias("high"))


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1")
def one_pass_stats(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))


@query("SELECT event_id, try_cast(round(CASE WHEN user_id % 5 = 0 THEN NULL ELSE value / (user_id % 5) END, 6) AS DOUBLE) AS ratio FROM events")
def safe_division(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.try_divide(F.col("value"), F.col("user_id") % 5), 6).alias("ratio"))
