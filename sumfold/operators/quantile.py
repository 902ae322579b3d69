"""Quantiles: exact ones in SQL and mergeable t-digests.

A digest is an array of centroids (mean, weight) plus true minimum and maximum. Partial
digests are built for each partition and group, then merged, so no group has to fit in
one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CENTROIDS = "array<struct<mean:double,weight:double>>"


def compress(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted centroids so that each spans less than one step of the scale function k(q) = d / pi * asin(2 q - 1)."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    if len(m) <= compression:
        return m, w
    total, scale = w.sum(), compression / np.pi
    k = lambda q: scale * np.arcsin(2 * min(1.0, max(0.0, q)) - 1)
    out_m, out_w, done = [m[0]], [w[0]], 0.0
    limit = k(0.0) + 1
    for a, b in zip(m[1:].tolist(), w[1:].tolist(), strict=True):
        if k((done + out_w[-1] + b) / total) <= limit:
            out_w[-1] += b
            out_m[-1] += (a - out_m[-1]) * b / out_w[-1]
        else:
            done += out_w[-1]
            limit = k(done / total) + 1
            out_m.append(a)
            out_w.append(b)
    return np.array(out_m), np.array(out_w)


def quantile_of(means, weights, q: float, low: float, high: float) -> float | None:
    """Linear interpolation between centroid middles, from the true minimum to the true maximum."""
    m, w = np.asarray(means, float), np.asarray(weights, float)
    if not len(m):
        return None
    at = np.concatenate([[0.0], np.cumsum(w) - w / 2, [w.sum()]])
    return float(np.interp(q * w.sum(), at, np.concatenate([[low], m, [high]])))


def cdf_of(means, weights, x: float, low: float, high: float) -> float | None:
    m, w = np.asarray(means, float), np.asarray(weights, float)
    if not len(m):
        return None
    if x < low:
        return 0.0
    if x >= high:
        return 1.0
    at = np.concatenate([[0.0], np.cumsum(w) - w / 2, [w.sum()]])
    return float(np.interp(x, np.concatenate([[low], m, [high]]), at) / w.sum())


class TDigest:
    """Digests as rows: keys, n, low, high, centroids."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], compression: float):
        self.df, self.keys, self.compression = df, tuple(keys), compression

    @staticmethod
    def _schema(df: DataFrame, keys: tuple[str, ...]) -> T.StructType:
        kept = [df.schema[k] for k in keys]
        tail = T.StructType.fromDDL(f"n double, low double, high double, centroids {CENTROIDS}")
        return T.StructType([*kept, *tail.fields])

    @classmethod
    def build(cls, df: DataFrame, value: str, keys: tuple[str, ...] = (), compression: float = 100, weight: str | None = None) -> TDigest:
        """Digest of each group; null and NaN values do not count."""
        if compression <= 0:
            raise ValueError("compression must be positive")
        keys = tuple(keys)
        rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for pdf in batches:
                for key, g in pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]:
                    m, w, low, high = held.get(key, (np.empty(0), np.empty(0), np.inf, -np.inf))
                    x = g["_x"].to_numpy()
                    if not len(x):
                        continue
                    m, w = compress(np.concatenate([m, x]), np.concatenate([w, g["_w"].to_numpy()]), compression)
                    held[key] = (m, w, min(low, x.min()), max(high, x.max()))
            if held:
                yield _frame(held, keys)

        schema = cls._schema(rows, keys)
        return cls(rows.mapInPandas(partial, schema), keys, compression)._merged(schema)

    def _merged(self, schema: T.StructType) -> TDigest:
        keys, compression = self.keys, self.compression

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            cs = [c for cell in pdf["centroids"] for c in cell]
            m, w = compress(np.array([c["mean"] for c in cs]), np.array([c["weight"] for c in cs]), compression)
            out = _frame({(): (m, w, pdf["low"].min(), pdf["high"].max())}, ())
            for k in reversed(keys):
                out.insert(0, k, [pdf[k].iloc[0]])
            return out

        grouped = self.df.groupBy(*keys) if keys else self.df.groupBy(F.lit("all"))
        return TDigest(grouped.applyInPandas(merge, schema), keys, compression)

    def combine(self, *others: TDigest) -> TDigest:
        """The merged digest is compressed again, so its size stays bounded."""
        df = self.df
        for o in others:
            if (o.keys, o.compression) != (self.keys, self.compression):
                raise ValueError("compression or keys differ")
            df = df.unionByName(o.df)
        return TDigest(df, self.keys, self.compression)._merged(self._schema(df, self.keys))

    def __add__(self, other):
        return self if isinstance(other, int) and other == 0 else self.combine(other)

    __radd__ = __add__

    def quantiles(self, qs: dict[str, float]) -> DataFrame:
        """A column for each named quantile."""
        if any(not 0 <= q <= 1 for q in qs.values()):
            raise ValueError("quantiles must be between 0 and 1")

        @F.pandas_udf("array<double>")
        def of(c: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
            return pd.Series([[quantile_of([x["mean"] for x in v], [x["weight"] for x in v], q, a, b) for q in qs.values()] for v, a, b in zip(c, low, high, strict=True)])

        got = self.df.withColumn("_q", of("centroids", "low", "high"))
        return got.select(*self.keys, "n", "low", "high", *[F.col("_q")[i].alias(name) for i, name in enumerate(qs)])

    def cdf(self, points: dict[str, float]) -> DataFrame:
        """A column for each named point: the share of values up to it."""

        @F.pandas_udf("array<double>")
        def of(c: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
            return pd.Series([[cdf_of([x["mean"] for x in v], [x["weight"] for x in v], p, a, b) for p in points.values()] for v, a, b in zip(c, low, high, strict=True)])

        got = self.df.withColumn("_p", of("centroids", "low", "high"))
        return got.select(*self.keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(points)])


def _frame(held: dict, keys: tuple[str, ...]) -> pd.DataFrame:
    rows = []
    for key, (m, w, low, high) in held.items():
        key = key if isinstance(key, tuple) else (key,)
        rows.append((*key, float(w.sum()), float(low), float(high), [{"mean": a, "weight": b} for a, b in zip(m.tolist(), w.tolist(), strict=True)]))
    return pd.DataFrame(rows, columns=[*keys, "n", "low", "high", "centroids"])


CELL_ROWS, MOST_CELLS = 1_000_000, 256


def _cell(cuts: list[float], x: Column, first: int = 0) -> Column:
    """How many cuts are below x, by halving; cuts ascend."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(x <= F.lit(cuts[m]), _cell(cuts[:m], x, first)).otherwise(_cell(cuts[m + 1 :], x, first + m + 1))


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles, interpolated between neighbours; null for a group without values.

    Values are counted first, then counts are cumulated in two levels: over cells of the value's range (about
    CELL_ROWS rows each, MOST_CELLS at most), then by sorting within the cells that hold a wanted rank only. No task holds a
    group's values in memory. The cells' borders are approximate; they change the work of a task, not the result.
    """
    x = F.col(value).cast("double")
    n = df.agg(F.count(value)).first()[0]
    cells = max(1, min(MOST_CELLS, n // CELL_ROWS))
    cuts = sorted(set(df.agg(F.percentile_approx(x, [i / cells for i in range(1, cells)])).first()[0])) if cells > 1 else []
    counts = df.groupBy(*keys, x.alias("_x")).agg(F.count(value).alias("_n")).withColumn("_cell", F.when(F.col("_x").isNull(), -1).otherwise(_cell(cuts, F.col("_x"))))
    per = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell"))
    per = per.withColumns({"_before": upto - F.col("_c"), "_all": F.sum("_c").over(Window.partitionBy(*keys))})
    at = [F.lit(float(q)) * (F.col("_all") - 1) for q in qs.values()]
    wanted = functools.reduce(lambda m, p: m | ((F.col("_before") <= F.ceil(p)) & (F.col("_before") + F.col("_c") > F.floor(p))), at, F.col("_cell") == -1)
    per = per.where(wanted).select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, "_cell")], "_before", "_all")
    same = functools.reduce(lambda m, c: m & F.col(c).eqNullSafe(F.col(f"_at_{c}")), keys, F.col("_cell") == F.col("_at__cell"))
    hot = counts.join(per, same).select(*keys, "_x", "_n", "_cell", "_before", "_all")
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy("_x"))
    hot = hot.withColumn("_end", end)
    holds = lambda p: F.max(F.when((F.col("_end") - F.col("_n") <= p) & (p < F.col("_end")), F.col("_x")))
    low = [holds(F.floor(p)).alias(f"_l{i}") for i, p in enumerate(at)]
    high = [holds(F.ceil(p)).alias(f"_h{i}") for i, p in enumerate(at)]
    got = hot.groupBy(*keys).agg(F.max("_all").alias("_all"), *low, *high)

    def between(i: int, p: Column) -> Column:
        a, b = F.col(f"_l{i}"), F.col(f"_h{i}")
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return got.select(*keys, *[between(i, p).alias(name) for i, (name, p) in enumerate(zip(qs, at, strict=True))])


def stepwise_quantile(df: DataFrame, value: str, q: float, keys: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """The quantile of an uncompressed digest: the value at which the cumulative count reaches q * n, interpolated from the one before."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), F.row_number().over(w).alias("_r"), F.lag(F.col(value).cast("double")).over(w).alias("_before"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    at = F.lit(float(q)) * F.col("_n")
    hit = ((F.col("_r") - 1 < at) & (at <= F.col("_r"))) if q > 0 else F.col("_r") == 1
    x = F.when(F.col("_r") == 1, F.col("_x")).otherwise(F.col("_before") + (at - (F.col("_r") - 1)) * (F.col("_x") - F.col("_before")))
    return rows.where(hit).select(*keys, x.alias(name))


def cdf_at(value: str, point: float) -> Column:
    """Exact share of values up to the point, as an aggregate."""
    return F.avg(F.when(F.col(value).isNotNull(), (F.col(value) <= point).cast("double")))
