"""Exact top-k inner-product search with MaxScore.

Each dimension of a vector is a term, the quantised component its impact. For a query
the contribution of a term lies within bounds known for the shard at hand. Terms are
split by those bounds: the essential ones are traversed for every row of the shard; the
others are probed, largest bound first, only for rows whose partial score plus the
remaining bounds can still reach the k-th best score so far. Shards are merged by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import cut

PROBE = 8


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    ok = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ok).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(a * F.lit(float(scale)))).alias("v")
    )


def _matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows padded with zeros to one width."""
    vectors = list(vectors)
    d = max([width or 0, *(len(v) for v in vectors)], default=0)
    if all(len(v) == d for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), d)
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def floor(self, q: int) -> int | None:
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else None

    def offer(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[keep], ids[keep]
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]


def maxscore(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> int:
    """Offer a shard's rows to all queries; returns how many components were read."""
    d = queries.shape[1]
    big = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(rows).max(initial=0))) * max(1, d)
    kind = np.float64 if big < 1 << 53 else np.int64  # floats are exact up to there
    x, hi, lo, read = np.ascontiguousarray(rows.T).astype(kind), rows.max(axis=0), rows.min(axis=0), 0
    for j, q in enumerate(queries):
        upper, lower = np.maximum(q * hi, q * lo), np.minimum(q * hi, q * lo)
        terms = np.argsort(lower - upper, kind="stable")
        rest = np.concatenate([np.cumsum(upper[terms][::-1])[::-1], [0]])  # most that terms from here on can add
        qk, least = q.astype(kind), best.floor(j)
        mid = d if least is None else int(np.argmax(rest < least)) if (rest < least).any() else d  # the terms from here on cannot reach the k-th best alone
        if mid == 0:
            continue  # nor can all of them
        score = qk[terms[:mid]] @ x[terms[:mid]]
        read += mid * len(ids)
        live = None
        while mid < d:
            keep = score + rest[mid] >= least
            live = np.flatnonzero(keep) if live is None else live[keep]
            score = score[keep]
            if not len(live):
                break
            more = terms[mid : mid + PROBE]
            score = score + qk[more] @ x[more][:, live]
            read += len(more) * len(live)
            mid += len(more)
        who = ids if live is None else ids[live]
        ok = who != own[j]
        best.offer(j, score[ok].astype(np.int64), who[ok])
    return read


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16_384) -> DataFrame:
    """The k rows of highest inner product for each query: query_id, rank, vec_id, score.

    Both inputs have (vec_id, v array<long>). Ties go to the smaller vec_id; rows with the
    query's id are no candidates; fewer candidates give fewer rows. Queries go out in
    blocks of at most `block` vectors, each block against all rows; only a block is ever
    broadcast. Repeated query ids count once (least vector).
    """
    spark = vectors.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:  # hashed blocks differ a little in size
        blocks = -(-blocks * 5 // 4)
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((part["vec_id"].to_numpy(np.int64), _matrix(part["v"])))

        def scored(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own, qs = sent.value
            best = Best(len(own), k)
            for pdf in batches:
                if len(pdf) and len(own):
                    rows = _matrix(pdf["v"], qs.shape[1])
                    wide = np.pad(qs, ((0, 0), (0, rows.shape[1] - qs.shape[1])))
                    maxscore(wide, own, pdf["vec_id"].to_numpy(np.int64), rows, best)
            if len(own):
                n = [len(s) for s in best.score]
                yield pd.DataFrame({"query_id": np.repeat(own, n), "vec_id": np.concatenate(best.id), "score": np.concatenate(best.score)})

        part = vectors.mapInPandas(scored, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            part = cut(part, "topk")
            sent.unpersist()
        found = part if found is None else found.unionAll(part)
    return found
