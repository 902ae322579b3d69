"""Document fingerprints by winnowing.

A text is read as code points. Every k-gram gets a rolling hash, every window of w
consecutive hashes selects its minimum (ties: the rightmost), and each selected hash is
kept with its position. Two texts that share w + k - 1 consecutive code points share at
least one selected hash. Texts shorter than k give one hash of the whole text at
position 0; empty and null texts give an empty fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import ranges, small_batches

K, W = 24, 41
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram, mod 2**64, by doubling."""
    have, size, offset = None, 0, 0
    step, width = x, 1
    while True:
        if k & width:
            if have is None:
                have, size = step, width
            else:  # the gram so far, then the next block of this width
                n = len(x) - (size + width) + 1
                have = have[:n] * np.uint64(pow(BASE, width, 1 << 64)) + step[size : size + n]
                size += width
        if size == k:
            return have
        step = step[: len(step) - width] * np.uint64(pow(BASE, width, 1 << 64)) + step[width:]
        width *= 2


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def winnow(text: str | None, k: int = K, w: int = W) -> np.ndarray:
    """Selected grams as (hash << 32 | position), in order of position."""
    if not text:
        return np.empty(0, np.uint64)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x += np.uint64(1)
    h = _rolled(x, min(k, len(x)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFF00000000)
    last = np.uint64(0xFFFFFFFF)
    h |= last - np.arange(len(h), dtype=np.uint64)  # the smallest is the rightmost among equal hashes
    m = _window_min(h, min(w, len(h)))
    keep = np.empty(len(m), bool)
    keep[0] = True
    np.not_equal(m[1:], m[:-1], out=keep[1:])
    return m[keep] ^ last


def packed(fp: np.ndarray) -> str:
    """16 hex digits for each selected gram: its hash, then its position."""
    return fp.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the selected hashes; 1 for two empty fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    x, y = set((a >> np.uint64(32)).tolist()), set((b >> np.uint64(32)).tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def fingerprints(df: DataFrame, text: str = "text", k: int = K, w: int = W, into: str = "fingerprint") -> DataFrame:
    """df plus the column `into` (see packed), which replaces one of that name. Row-local: no shuffle, rows and other columns are kept; null and empty texts give an empty string."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([packed(winnow(x, k, w)) for x in s], dtype="object")

    return df.withColumn(into, of(F.col(f"`{text}`")))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as many code points from the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def successor_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's start.

    The next document follows in descending doc_id; the last is followed by the first, a
    single document by itself. Null texts count as empty, null ids come last, rows with
    one id stand in order of text, repeated rows one after the other; an empty table gives no rows. The rows are dealt
    once into id ranges (quantile cut points over the ids alone, as many as the bytes of all texts ask for); each range also gets the
    first document of the range after it, so no task sees more than its range and one row. Rows of one id lie in one range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    n = ranges(spark, rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    rows = rows.withColumn("key", F.coalesce("i", F.lit(-(1 << 63))))
    at = [(j + 1) / n for j in range(n - 1)]
    cuts = rows.agg(F.percentile_approx("key", at, max(10_000, 10 * n)).alias("c")).first().c if at else []
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    by = Bucketizer(splits=splits, inputCol="d", outputCol="b")

    def dealt(df: DataFrame) -> DataFrame:
        low = by.transform(df.withColumn("d", F.col("key").cast("double")))
        return low.withColumn("p", F.lit(len(splits) - 2) - F.col("b").cast("int")).drop("d", "b")

    first = sorted((r.p, r.k) for r in dealt(rows.select("key")).groupBy("p").agg(F.max("key").alias("k")).collect())
    heads = [(key, first[j - 1][0]) for j, (_, key) in enumerate(first)]
    heads = spark.createDataFrame(heads, "key long, before int")  # a row for each range
    own = F.struct(F.col("p").alias("p"), F.lit(False).alias("tail"))
    also = F.struct(F.col("before").alias("p"), F.lit(True).alias("tail"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))
    laid = dealt(rows).join(F.broadcast(heads), "key", "left").select("i", "key", "t", F.inline(both))
    laid = laid.repartitionById(len(splits) - 1, F.col("p")).sortWithinPartitions("p", "tail", F.desc("key"), "t")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # range, id, text, fingerprint of the row that waits for its next
        for pdf in batches:
            out = []
            for i, t, p, tail in zip(pdf["i"], pdf["t"], pdf["p"], pdf["tail"], strict=True):
                if tail and held is None:
                    continue  # a further row with the head's id
                fp = winnow(t, k, w)
                if held is not None:
                    i0, t0, f0 = held
                    e = edited(t0, t)
                    fe = winnow(e, k, w)
                    out.append((i0, len(t0), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), packed(f0), packed(fe), likeness(f0, fe), likeness(f0, fp)))
                held = None if tail else (None if pd.isna(i) else int(i), t, fp)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return laid.select("i", "t", "p", "tail").mapInPandas(chain, SCHEMA)
