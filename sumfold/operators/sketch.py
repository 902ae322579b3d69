"""Mergeable sketches as rows.

A sketch is a DataFrame of grouping columns, cell columns and one value column; merging is
a union and one aggregate, so partial aggregation, spilling and streaming come from the
engine. Parameters travel with the sketch and are compared before a merge is planned.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sketch:
    cells: tuple[str, ...] = ()
    value: str | None = None  # None: a cell's presence is all there is
    merge = "max"

    def __init__(self, df: DataFrame, keys: tuple[str, ...] = (), **params: Any):
        self.df, self.keys, self.params = df, tuple(keys), params

    def _same(self, other: Sketch) -> None:
        if type(self) is not type(other):
            raise TypeError(f"cannot combine {type(self).__name__} with {type(other).__name__}")
        if self.params != other.params or self.keys != other.keys:
            raise ValueError(f"parameters differ: {self.params} {self.keys} and {other.params} {other.keys}")

    @classmethod
    def _reduced(cls, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        if cls.value is None:
            return df.select(*keys, *cls.cells).distinct()
        return df.groupBy(*keys, *cls.cells).agg(getattr(F, cls.merge)(cls.value).alias(cls.value))

    def combine(self, *others: Sketch) -> Sketch:
        for o in others:
            self._same(o)
        df = reduce(lambda a, b: a.unionByName(b), [o.df for o in others], self.df)
        return self._like(self._reduced(df, self.keys))

    def _like(self, df: DataFrame, keys: tuple[str, ...] | None = None) -> Sketch:
        return type(self)(df, self.keys if keys is None else keys, **self.params)

    def rollup_to(self, *keys: str) -> Sketch:
        """The same sketch for fewer grouping columns."""
        if not set(keys) <= set(self.keys):
            raise ValueError(f"{keys} are not among {self.keys}")
        return self._like(self._reduced(self.df, keys), keys)

    def __add__(self, other):
        return self if isinstance(other, int) and other == 0 else self.combine(other)

    __radd__ = __add__

    def zero(self) -> Sketch:
        return self._like(self.df.limit(0))

    def is_zero(self) -> bool:
        return self.df.isEmpty()

    def equals(self, other: Sketch) -> bool:
        """Same parameters and cells."""
        return self.params == other.params and self.df.exceptAll(other.df.select(*self.df.columns)).isEmpty() and other.df.select(*self.df.columns).exceptAll(self.df).isEmpty()

    def save(self, path: str, partition_by: tuple[str, ...] = ()) -> None:
        """Write as Parquet with the parameters as columns."""
        df = self.df
        for k, v in self.params.items():
            df = df.withColumn(f"param_{k}", F.lit(v))
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)

    @classmethod
    def load(cls, df: DataFrame, keys: tuple[str, ...] = ()) -> Sketch:
        """From a table that save() wrote; mixed parameters are an error."""
        names = [c for c in df.columns if c.startswith("param_")]
        found = df.select(*names).distinct().limit(2).collect()
        if len(found) > 1:
            raise ValueError("the table mixes sketches of different parameters")
        params = {n.removeprefix("param_"): found[0][n] for n in names} if found else {}
        return cls(df.drop(*names), keys, **params)


def merge_all(sketches: list[Sketch]) -> Sketch:
    """One union and one aggregate for any number of sketches."""
    if not sketches:
        raise ValueError("nothing to merge")
    return sketches[0].combine(*sketches[1:])
