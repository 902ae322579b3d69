"""Count-Min sketches as rows (row, col, cnt)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.functions import hashing
from sumfold.operators.sketch import Sketch


def sizing(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth) so that an estimate exceeds the truth by at most epsilon * N with probability 1 - delta."""
    if not (0 < epsilon < 1 and 0 < delta < 1):
        raise ValueError("epsilon and delta must be between 0 and 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def columns(item: Column, width: int, depth: int) -> Column:
    """Array of (row, col), one for each row."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), hashing.modulo(hashing.seeded_digest(r, item), width).alias("col")))


class CountMin(Sketch):
    cells, value, merge = ("row", "col"), "cnt", "sum"

    @classmethod
    def build(cls, df: DataFrame, item: str, keys: tuple[str, ...] = (), width: int = 1000, depth: int = 5, count: str | None = None) -> CountMin:
        """Cells of each group; items are counted first, so each distinct item is hashed once. Null items do not count."""
        if width <= 0 or depth <= 0:
            raise ValueError("width and depth must be positive")
        n = F.sum(count) if count else F.count(F.lit(1))
        items = df.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("_item")).agg(n.alias("_n"))
        rows = items.select(*keys, F.inline(columns(F.col("_item"), width, depth)), F.col("_n").alias("cnt"))
        return cls(cls._reduced(rows, keys), keys, width=width, depth=depth)

    def estimates(self, candidates: DataFrame, item: str, name: str = "estimate") -> DataFrame:
        """candidates plus the estimated count of the item (in the row's group): the least of its cells, 0 for a cell that is absent."""
        asked = candidates.select(*self.keys, F.col(item).alias("_item")).distinct()
        need = asked.select(*self.keys, "_item", F.inline(columns(F.col("_item"), self.params["width"], self.params["depth"])))
        got = need.join(self.df, [*self.keys, "row", "col"], "left").groupBy(*self.keys, "_item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias(name))
        return candidates.join(got.withColumnRenamed("_item", item), [*self.keys, item], "left").withColumn(name, F.coalesce(name, F.lit(0)))

    def total(self) -> DataFrame:
        """Number of counted items: any row of the matrix holds it."""
        return self.df.where("row = 0").groupBy(*self.keys).agg(F.sum("cnt").alias("total"))

    def heavy_hitters(self, candidates: DataFrame, item: str, threshold: int) -> DataFrame:
        """Candidates whose estimate reaches the threshold."""
        return self.estimates(candidates, item).where(F.col("estimate") >= threshold)
