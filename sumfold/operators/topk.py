"""Heavy hitters: exact frequency rows with a deterministic top k, and the engine's bounded-memory sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumfold.operators.sketch import Sketch


class TopK(Sketch):
    cells, value, merge = ("item",), "freq", "sum"

    @classmethod
    def build(cls, df: DataFrame, item: str, keys: tuple[str, ...] = (), k: int = 10, count: str | None = None) -> TopK:
        """Frequencies by group and item; null items do not count. Items can be added after any merge."""
        if k <= 0:
            raise ValueError("k must be positive")
        n = F.sum(count) if count else F.count(F.lit(1))
        rows = df.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("item")).agg(n.alias("freq"))
        return cls(rows, keys, k=k)

    def top(self, n: int | None = None) -> DataFrame:
        """The n (at most k) most frequent items of each group with their rank; ties by item."""
        n = min(n or self.params["k"], self.params["k"])
        if not self.keys:
            best = self.df.orderBy(F.desc("freq"), "item").limit(n)
            order = Window.orderBy(F.desc("freq"), "item")  # over the n rows kept
        else:
            best, order = self.df, Window.partitionBy(*self.keys).orderBy(F.desc("freq"), "item")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def estimates(self, items: DataFrame, item: str, name: str = "freq") -> DataFrame:
        """items plus their exact frequency, 0 if absent."""
        got = self.df.select(*self.keys, F.col("item").alias(item), F.col("freq").alias(name))
        return items.join(got, [*self.keys, item], "left").withColumn(name, F.coalesce(name, F.lit(0)))

    def contains(self, items: DataFrame, item: str) -> DataFrame:
        """Rows of items that are in the current top k."""
        return items.join(self.top().select(*self.keys, F.col("item").alias(item)), [*self.keys, item], "left_semi")


def approx_top(df: DataFrame, item: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bounded-memory heavy hitters by the built-in sketch: (keys, item, freq)."""
    return df.groupBy(*keys).agg(F.expr(f"approx_top_k({item}, {int(k)})").alias("_t")).select(*keys, F.inline("_t")).toDF(*keys, "item", "freq")
