"""Sharding by Hilbert-curve order.

Metadata dimensions are quantised at their exact quantiles, whole values of any type that
has an order: a value's cell is the share of rows with lesser values. A row's cell gets its
index on the Hilbert curve, rows are sorted by that index and the order is cut into runs of
equal counts. Neighbours on the curve are near in every dimension, so minimum and maximum
of each dimension prune whole shards. Only DataFrame operations; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import cut, ranges

BITS, ROW_BYTES = 4, 64


def curve_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell with the given axes, each of `bits` bits (Skilling's transform)."""
    n = len(axes)
    steps = [(1 << q, i) for q in range(bits - 1, 0, -1) for i in range(n)]
    x = F.array(*[a.cast("int") for a in axes])

    def turn(v: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        x0, xi, p = F.get(v, F.lit(0)), F.get(v, i), s["q"] - 1
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        flip = xi.bitwiseAND(q) != 0
        first = F.when(flip, x0.bitwiseXOR(p)).otherwise(x0.bitwiseXOR(swap))
        other = F.when(flip, xi).otherwise(xi.bitwiseXOR(swap))
        # for i = 0 the swap is empty and both rules meet in the first axis
        return F.transform(v, lambda y, j: F.when(j == 0, first).when(j == i, other).otherwise(y))

    todo = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])
    v = F.aggregate(todo, x, turn) if steps else x
    gray = F.aggregate(v, F.array().cast("array<int>"), lambda acc, y: F.array_append(acc, y.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    last = F.element_at(gray, -1)
    t = F.aggregate(F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)] or [F.lit(0)]), F.lit(0), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
    out = F.transform(gray, lambda y: y.bitwiseXOR(t))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda s: F.call_function("shiftright", F.get(out, s["i"]), s["b"]).bitwiseAND(F.lit(1))
    return F.aggregate(order, F.lit(0).cast("long"), lambda acc, s: acc * 2 + bit(s))


def _numbered(ordered: DataFrame, weight: Column) -> tuple[DataFrame, int]:
    """A written table with its rows' places `_at` (partition, row), plus `_before`: the weight of all partitions before a row's own, and the weight of all."""
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.sum(weight).alias("_n"))  # a row for each partition
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("_p", part).join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p"), total


def cells_of(df: DataFrame, value: str, bits: int = BITS) -> Column:
    """The cell of each value of a column, of `bits` bits: its 2**bits-th of the rows, by the share of rows with a lesser value; null is least.

    Values are counted first, and counts are summed in two levels over ranges of values, so
    neither a hot value nor many different ones meet in one task; at most 2**bits least values come to the driver.
    """
    v = F.col(value)
    counts = df.groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    ordered = counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("_at", F.monotonically_increasing_id())
    placed, total = _numbered(cut(ordered, "hilbert-values"), F.col("n"))
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_p").orderBy("_at")) - F.col("n")
    cell = F.expr(f"cast((_upto << {bits}) div {max(1, total)} as int)")
    least = placed.withColumn("_upto", upto).groupBy(cell.alias("c")).agg(F.min("v").alias("v")).where("v is not null").orderBy("c").collect()
    kind = dict(df.dtypes)[value]
    out = F.lit(0)
    for r in least:
        out = F.when(v >= F.lit(r.v).cast(kind), F.lit(r.c)).otherwise(out)
    return out


def shards(docs: DataFrame, n_shards: int, dims: tuple[str, ...] = ("source", "lang", "size"), doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot for every row; none for an empty table.

    size is the text's UTF-8 bytes plus 8 and is a dimension itself; null texts count as
    empty in it and have crc32 0, null metadata is least. Rows are ordered by curve index,
    then the text's crc32, then size and id (null first), so equal texts of one cell stay together, unless a cut
    between shards goes through them: the law counts rows, and a large group of copies fits in no shard.
    Equal texts of different metadata lie where their metadata are. Counts of shards differ by
    one at most. Repeated rows are rows; a hot cell is split like any other run, as texts and ids take part in the order.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).alias("text_crc32"), *[F.col(f"`{d}`").alias(f"_d_{d}") for d in dims if d != "size"],
    )
    base = cut(base, "hilbert-meta")
    axes = {f"_q_{d}": cells_of(base, "size" if d == "size" else f"_d_{d}", bits) for d in dims}
    cells = base.select("doc_id", "size", "text_crc32", *[c.alias(a) for a, c in axes.items()])
    curve = cells.select(*axes).distinct().withColumn("curve", curve_index([F.col(a) for a in axes], bits))  # 2 ** (dims * bits) rows at most
    cells = cells.join(F.broadcast(curve), list(axes)).select("doc_id", "size", "text_crc32", "curve")
    order = ["curve", "text_crc32", "size", "doc_id"]
    ordered = cells.repartitionByRange(ranges(spark, base.count() * ROW_BYTES), *order).sortWithinPartitions(*order)
    placed, total = _numbered(cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "hilbert-order"), F.lit(1))
    # rank r of n goes to shard r * k div n: shard j holds the ranks from ceil(j * n / k)
    placed = placed.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.withColumn("shard", F.expr(f"cast(_rank * {n_shards} div {max(1, total)} as int)"))
    start = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("_rank") - start).alias("slot"))
