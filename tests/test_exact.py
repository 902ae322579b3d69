import pytest
from pyspark.sql import functions as F

from sumfold.operators import exact as X


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, None, "y"), ("a", 3, 7, None), ("b", 1, None, "z")], "k string, o int, v int, s string")


def one(df):
    return {r.k: r for r in df.collect()}


def test_numbers(rows):
    got = one(rows.groupBy("k").agg(X.total("v").alias("t"), X.product("v").alias("p"), X.largest("v").alias("hi"), X.smallest("v").alias("lo")))
    assert (got["a"].t, got["a"].p, got["a"].hi, got["a"].lo) == (12, 35.0, 7.0, 5.0)
    assert (got["b"].t, got["b"].p, got["b"].hi, got["b"].lo) == (0, 1.0, float("-inf"), float("inf"))


def test_across_columns(spark):
    r = spark.createDataFrame([(1, None, 3)], "a int, b int, c int").select(X.add("a", "b", "c").alias("s"), X.multiply("a", "b", "c").alias("p"), X.max_of("a", "b", "c").alias("hi"), X.min_of("b").alias("lo")).first()
    assert tuple(r) == (4, 3, 3.0, float("inf"))


def test_collections(rows):
    got = one(rows.groupBy("k").agg(X.set_of("v").alias("set"), X.list_of("s", "o").alias("list"), X.string_of("s", "o", "-").alias("str"), X.last_wins("v", "o").alias("last"), X.first_some("s", "o").alias("first"), X.sequence_some("v", "o").alias("seq")))
    a, b = got["a"], got["b"]
    assert (a.set, a.list, a.str, a.last, a.first, a.seq) == ([5, 7], ["x", "y", None], "x-y", 7, "x", None)
    assert (b.set, b.list, b.str, b.last, b.first, b.seq) == ([], ["z"], "z", None, "z", None)


def test_sequence_of_all(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "o int, v string")
    assert df.agg(X.sequence_some("v", "o").alias("x")).first().x == ["a", "b"]


def test_maps(spark):
    rows = spark.createDataFrame([("x", 1, 1), ("x", 5, 2), ("y", 3, 1)], "k string, n int, o int")
    merge = lambda how, **kw: {r.k: r.n for r in X.merge_map_rows(rows, "k", "n", how, **kw).collect()}
    assert merge("sum") == {"x": 6, "y": 3} and merge("max") == {"x": 5, "y": 3} and merge("min") == {"x": 1, "y": 3} and merge("last", order_by="o") == {"x": 5, "y": 3}
    with pytest.raises(ValueError):
        merge("last")
    with pytest.raises(ValueError):
        merge("mean")
    m = spark.sql("select map('a', 1, 'b', 2) as l, map('b', 10, 'c', 20) as r").select(X.merge_maps("l", "r", lambda a, b: a + b).alias("m")).first().m
    assert m == {"a": 1, "b": 12, "c": 20}


def test_arrays(spark):
    r = spark.sql("select array(1, 2) as a, array(2, 3) as b, cast(null as array<int>) as c, array(1, null, 2) as d").select(X.set_union("a", "b", "c").alias("u"), X.concat_lists("a", "c", "b").alias("l"), X.flatten_some("d").alias("f")).first()
    assert (r.u, r.l, r.f) == ([1, 2, 3], [1, 2, 2, 3], [1, 2])


def test_options(spark):
    df = spark.createDataFrame([(5,), (None,)], "x int")
    got = df.select(X.is_some("x"), X.get_or_else("x", 0), X.map_some("x", lambda v: v * 2), X.filter_some("x", lambda v: v > 9), X.or_else("x", F.lit(1)), X.combine_some("x", F.lit(3), lambda a, b: a + b)).collect()
    assert [tuple(r) for r in got] == [(True, 5, 10, None, 5, 8), (False, 0, None, None, 1, 3)]
    assert df.where("x is not null").select(X.value("x").alias("v")).first().v == 5
    with pytest.raises(Exception, match="no value"):
        df.select(X.value("x")).collect()
