"""MinHash signatures, exact and weighted Jaccard similarity.

A signature is an array of 32-bit values, computed row by row from an array of items.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.functions import hashing

EMPTY = hashing.WORD - 1


def coefficients(num_perm: int = 128, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from a generator of its own."""
    if num_perm <= 0:
        raise ValueError("num_perm must be positive")
    rng = random.Random(seed)
    return [(rng.randint(0, hashing.WORD - 1), rng.randint(0, hashing.WORD - 1)) for _ in range(num_perm)]


def item_hashes(items: Column) -> Column:
    """32-bit hashes of an array of items."""
    return F.transform(items, lambda x: hashing.high(hashing.digest(x)))


def signature(items: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """Least (a * h + b) mod 2**32 of each permutation over the items; all 2**32 - 1 for no items."""
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(num_perm, seed)])
    with_hashes = F.transform(F.array(item_hashes(F.array_distinct(F.coalesce(items, F.array().cast("array<string>"))))), lambda hs: F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(hs, lambda h: hashing.affine32(p["a"], h, p["b"]))), F.lit(EMPTY))))
    return with_hashes[0]


def signature_arrow(items: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """The same values by numpy over Arrow batches; quicker for many permutations."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(num_perm, seed), strict=True))

    @F.pandas_udf("array<long>")
    def of(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h if h is not None else [], np.uint64)
            out.append(((a[:, None] * h[None, :] + b[:, None]) & np.uint64(EMPTY)).min(axis=1).astype(np.int64).tolist() if len(h) else [EMPTY] * len(a))
        return pd.Series(out)

    # marked so that the optimizer neither repeats the call nor moves it into a lambda or generator
    return of.asNondeterministic()(item_hashes(F.array_distinct(items)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def merged(a: Column, b: Column) -> Column:
    """Signature of the union."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def merge_rows(df: DataFrame, sig: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One signature for each group: that of the union of the rows' items."""
    cells = df.select(*keys, F.posexplode(sig).alias("pos", "h")).groupBy(*keys, "pos").agg(F.min("h").alias("h"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "h")))
    return cells.groupBy(*keys).agg(F.transform(rows, lambda r: r["h"]).alias(sig))


def exact_jaccard(a: Column, b: Column) -> Column:
    """Of two item arrays; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def exact_weighted_jaccard(weights: DataFrame, key: str, item: str, weight: str, pairs: DataFrame) -> DataFrame:
    """Sum of minima over sum of maxima for pairs (a, b) of keys, by joins on the items that both have.

    Weights must not be negative; zero ones do not count.
    """
    w = weights.where(F.col(weight) > 0)
    total = w.groupBy(key).agg(F.sum(weight).alias("t"))
    left = w.select(F.col(key).alias("a"), F.col(item).alias("i"), F.col(weight).alias("x"))
    right = w.select(F.col(key).alias("b"), F.col(item).alias("i"), F.col(weight).alias("y"))
    low = pairs.join(left, "a").join(right, ["b", "i"]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("low"))
    out = pairs.join(low, ["a", "b"], "left").join(total.withColumnsRenamed({key: "a", "t": "ta"}), "a").join(total.withColumnsRenamed({key: "b", "t": "tb"}), "b")
    least = F.coalesce("low", F.lit(0.0))
    return out.select("a", "b", (least / (F.col("ta") + F.col("tb") - least)).alias("jaccard"))


def weighted_signature(items: Column, weights: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """Consistent weighted samples (item hash, t, a) of each permutation; items of weight 0 are left out.

    Equal (hash, t) pairs have the weighted Jaccard similarity as their probability. The signature of a
    union by maximum weight is the place-wise minimum by a.
    """

    @F.pandas_udf("array<struct<h:long,t:long,a:double>>")
    def of(hashes: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for h, w in zip(hashes, weights, strict=True):
            h, w = np.asarray(h if h is not None else [], np.uint64), np.asarray(w if w is not None else [], float)
            if (w < 0).any():
                raise ValueError("weights must not be negative")
            h, w = h[w > 0], w[w > 0]
            if not len(h):
                out.append([])
                continue
            order = np.argsort(h)  # so that the first least a has the least hash
            h, w = h[order], w[order]
            u = [_uniform(h[None, :], (seed * 1_000_003 + 8 * np.arange(num_perm) + n)[:, None]) for n in range(5)]
            r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
            t = np.floor(np.log(w) / r + beta)
            a = np.log(c) - r * (t - beta) - r
            i, row = a.argmin(axis=1), np.arange(num_perm)
            out.append([{"h": x, "t": y, "a": z} for x, y, z in zip(h[i].astype(np.int64).tolist(), t[row, i].astype(np.int64).tolist(), a[row, i].tolist(), strict=True)])
        return pd.Series(out)

    return of(item_hashes(items), weights)


def _uniform(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on the hash and the salt alone."""
    salt = salt.astype(np.uint64)
    x = (h + salt) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x = (x + salt) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two empty signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x["h"] == y["h"]) & (x["t"] == y["t"])), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.greatest(F.size(a), F.size(b)))


def weighted_merged(a: Column, b: Column) -> Column:
    """Place-wise sample of smaller a; an empty signature is the identity."""
    both = F.zip_with(a, b, lambda x, y: F.when(x["a"] <= y["a"], x).otherwise(y))
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(both)
