"""Exact similarity join of sets, packed: sets are numbered, stored once in blocks by size, and pairs of blocks are joined in memory.

Nothing is kept for a candidate pair: a task reads two blocks, counts the shared items of their prefixes, and yields only
pairs that reach the threshold. Items are 64-bit hashes until they are numbered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from sumfold.sources.tables import once

CELLS = 3 << 19  # most items of a block; about 200 MB in a worker
LEAST_CELLS = 1 << 19
DENSE = 1 << 23  # up to this number items are looked up by place
HITS, COUNTERS = 1 << 19, 1 << 21
LONGER = 20  # prefixes are longer by size / LONGER, so that a candidate needs as many more shared items


@contextmanager
def _batches(spark: SparkSession, rows: int, size: int = 16 << 20):
    """Arrow batches of at most `rows` rows and about `size` bytes for what runs inside."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"}
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _blobs(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint8) for b in column.to_pylist()]


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, …"""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _dealer(ranges: int):
    """The items of each Arrow batch by ranges of hashes; range 0 also has the batch's keys."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            if not b.num_rows:
                continue
            items, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            r = (items.view(np.uint64) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(r, kind="stable")
            items, at = items[order], np.repeat(np.arange(b.num_rows, dtype=np.int32), sizes)[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=ranges))])
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(range(ranges), pa.int32()), pa.array([part << 32 | i] * ranges, pa.int64()),
                pa.array([items[p:q].tobytes() for p, q in spans], pa.binary()), pa.array([zlib.compress(np.diff(at[p:q], prepend=np.int32(0)).astype("<i4").tobytes(), 1) for p, q in spans], pa.binary()),
                _lists(b.column(0), [b.num_rows] + [0] * (ranges - 1)),
            ], ["r", "chunk", "items", "at", "keys"])

    return deal


def _numberer(ranges: int):
    """Numbers for a range's items, and about the logarithm of how many sets have each (0: one)."""

    def number(t: pa.Table) -> pa.Table:
        got = [b.view(np.int64) for b in _blobs(t["items"])]
        _, ids, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        if len(n) * ranges >= 1 << 32:
            raise ValueError("too many different items for 32-bit numbers")
        codes = np.minimum(255, np.ceil(np.log2(n) * 8)).astype(np.uint8)[ids]
        place = np.empty(len(n), np.int64)
        place[np.argsort(n == 1, kind="stable")] = np.arange(len(n))  # shared items have the low numbers
        ids = (place[ids] * ranges + t["r"][0].as_py()).astype("<u4")
        ends = np.cumsum([len(g) for g in got])
        spans = [(e - len(g), e) for g, e in zip(got, ends, strict=True)]
        return pa.table({"chunk": t["chunk"], "ids": pa.array([ids[p:q].tobytes() for p, q in spans], pa.binary()), "codes": pa.array([zlib.compress(codes[p:q].tobytes(), 1) for p, q in spans], pa.binary()), "at": t["at"], "keys": t["keys"]})

    return number


def _assemble(t: pa.Table) -> pa.Table:
    """A batch's sets: key, n items, of which `alone` in no other set, digest, and the numbers of the rest, rare ones first. Of equal sets only one row has the numbers."""
    ids = np.concatenate([b.view("<u4") for b in _blobs(t["ids"])])
    codes = np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for b in t["codes"].to_pylist()])
    at = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(b), "<i4")) for b in t["at"].to_pylist()])
    keys = t["keys"].combine_chunks()
    keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).flatten()
    order = np.lexsort((ids, codes, at))
    ids, n = ids[order], np.bincount(at, minlength=len(keys))
    alone = np.bincount(at[codes == 0], minlength=len(keys))
    ends, seen, digests, rest = np.cumsum(n), set(), [], []
    for e, k, u in zip(ends, n, alone, strict=True):
        digests.append(blake2b(ids[e - k : e].tobytes(), digest_size=16).digest())
        rest.append(None if digests[-1] in seen else ids[e - k + u : e].tobytes())
        seen.add(digests[-1])
    return pa.table({"key": keys, "n": pa.array(n, pa.int32()), "alone": pa.array(alone, pa.int32()), "digest": pa.array(digests, pa.binary()), "ids": pa.array(rest, pa.binary())})


def numbered(sets: DataFrame) -> DataFrame:
    """(key, n, alone, digest, ids), stored, of the sets (key, words) that are not empty. Equal sets have one digest; at least one of them has the ids."""
    spark = sets.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ArrayType(sets.schema["key"].dataType)
    hashed = sets.where(F.size("words") > 0).select("key", F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("items"))
    dealt = hashed.mapInArrow(_dealer(ranges), StructType([StructField("r", IntegerType()), StructField("chunk", LongType()), StructField("items", BinaryType()), StructField("at", BinaryType()), StructField("keys", keys)]))
    known = dealt.groupBy("r").applyInArrow(_numberer(ranges), StructType([StructField("chunk", LongType()), StructField("ids", BinaryType()), StructField("codes", BinaryType()), StructField("at", BinaryType()), StructField("keys", keys)]))
    rows = StructType([StructField("key", keys.elementType), StructField("n", IntegerType()), StructField("alone", IntegerType()), StructField("digest", BinaryType()), StructField("ids", BinaryType())])
    with _batches(spark, 10_000):
        return once(known.groupBy("chunk").applyInArrow(_assemble, rows), "sets")


def _pack(t: pa.Table) -> pa.Table:
    """One block of different sets in order of size; of equal sets the least key stands."""
    key, digest, ids = t["key"].to_pylist(), t["digest"].to_pylist(), t["ids"].to_pylist()
    least, where = {}, {}
    for i, d in enumerate(digest):
        least[d] = key[i] if d not in least else min(least[d], key[i])
        if ids[i] is not None:
            where[d] = i
    n, alone = t["n"].to_numpy(), t["alone"].to_numpy()
    rows = sorted(where.values(), key=lambda i: (n[i], digest[i]))
    return pa.table({
        "no": pa.array([t["no"][0].as_py()], pa.int64()), "least": pa.array([n[rows].min()], pa.int32()), "most": pa.array([n[rows].max()], pa.int32()), "keys": _lists(pa.array([least[digest[i]] for i in rows], t.schema.field("key").type), [len(rows)]),
        "n": pa.array([n[rows].astype("<i4").tobytes()], pa.binary()), "alone": pa.array([alone[rows].astype("<i4").tobytes()], pa.binary()), "ids": pa.array([b"".join(ids[i] for i in rows)], pa.binary()),
    })


def blocks(stored: DataFrame) -> DataFrame:
    """(no, least, most, keys, n, alone, ids): different sets in blocks of similar size, stored. Sizes of two blocks overlap only if both have sets of one and the same size."""
    sizes = stored.groupBy("n").agg(F.sum(F.coalesce(F.length("ids"), F.lit(0)) + 8).alias("b")).orderBy("n").collect()
    key = stored.schema["key"].dataType
    rows = StructType([StructField("no", LongType()), StructField("least", IntegerType()), StructField("most", IntegerType()), StructField("keys", ArrayType(key)), StructField("n", BinaryType()), StructField("alone", BinaryType()), StructField("ids", BinaryType())])
    if not sizes:
        return stored.sparkSession.createDataFrame([], rows)
    total = sum(r.b for r in sizes) // 4
    most = min(CELLS, max(LEAST_CELLS, total // 10)) * 4
    edges, parts, now = [], [], most
    for r in sizes:  # a size with more than a block's items is dealt over several blocks of that size only
        if r.b > most or now + r.b > most:
            edges.append(r.n)
            parts.append(-(-r.b // most))
            now = 0
        now = most if parts[-1] > 1 else now + r.b
    e, p = F.array(*[F.lit(x) for x in edges]), F.array(*[F.lit(x).cast("long") for x in parts])
    at = F.size(F.filter(e, lambda x: x <= F.col("n")))
    no = at.cast("long") * (1 << 32) + F.pmod(F.xxhash64("digest"), F.element_at(p, at))
    return once(stored.withColumn("no", no).groupBy("no").applyInArrow(_pack, rows), "blocks")


class Block:
    """Sets in order of size, their items by number, rare ones first."""

    def __init__(self, keys: pa.Array, n: bytes, alone: bytes, ids: bytes):
        self.keys, self.n, self.alone, self.ids = keys, np.frombuffer(n, "<i4").astype(np.int64), np.frombuffer(alone, "<i4").astype(np.int64), np.frombuffer(ids, "<u4")
        self.size = self.n - self.alone
        self.start = np.cumsum(self.size) - self.size

    def prefix(self, share: float) -> np.ndarray:
        """How long the prefix of each set is of which a partner with `share` of its items must have one, and a little more. Items that no other set has count."""
        return np.minimum(self.n, self.n - np.ceil(np.round(share * self.n, 6)).astype(np.int64) + 1 + self.n // LONGER)

    def cells(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and sets of the items in the prefixes."""
        k = np.maximum(0, prefix - self.alone)
        return self.ids[np.repeat(self.start, k) + _ramp(k)], np.repeat(np.arange(len(k)), k)


class Index:
    """Prefixes of a block's sets by item, for partners that are at least as large."""

    def __init__(self, block: Block, t: float):
        self.block, self.prefix = block, block.prefix(2 * t / (1 + t))
        ids, sets = block.cells(self.prefix)
        order = np.argsort(ids, kind="stable")
        self.sets, ids = sets[order], ids[order]
        self.first = None
        self.known, at = np.unique(ids, return_index=True)
        self.at = np.append(at, len(ids))
        if len(ids) and int(ids[-1]) < DENSE:
            self.first = np.zeros(int(ids[-1]) + 3, np.int32)
            self.first[self.known.astype(np.int64) + 1] = np.diff(self.at)
            np.cumsum(self.first, out=self.first)

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sets of each item start and end."""
        if self.first is not None:
            i = np.minimum(ids, len(self.first) - 1).astype(np.int64)
            return self.first[i], self.first[np.minimum(i + 1, len(self.first) - 1)]
        i = np.searchsorted(self.known, ids)
        has = np.append(self.known, np.uint32(0))[i] == ids
        has &= i < len(self.known)
        i = np.where(has, i, 0)
        return np.where(has, self.at[i], 0), np.where(has, self.at[np.minimum(i + 1, len(self.at) - 1)], 0)


def linked(index: Index, y: Block, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in both blocks and similarities of all pairs of at least t. No set of y is smaller than one of the index; if both are one block, pairs count once."""
    x, py = index.block, y.prefix(t)
    ids, sets = y.cells(py)
    lo, hi = index.spans(ids)
    hits = hi - lo
    some = hits > 0
    lo, hits, sets = lo[some], hits[some], sets[some]
    of = np.searchsorted(sets, np.arange(len(y.n) + 1))
    each = np.concatenate([[0], np.cumsum(hits)])[of]
    a, nx = 0, len(x.n)
    while a < len(y.n):
        b = a + max(1, min(COUNTERS // nx, int(np.searchsorted(each, each[a] + HITS, "right")) - 1 - a))
        b = min(b, len(y.n))
        p, q = of[a], of[b]
        if each[b] > each[a]:
            met = index.sets[np.repeat(lo[p:q], hits[p:q]) + _ramp(hits[p:q])]
            shared = np.bincount(np.repeat(sets[p:q] - a, hits[p:q]) * nx + met, minlength=(b - a) * nx)
            least = max(int(x.n[0]), int(np.floor(t * y.n[a] - 1e-6)))  # the smaller set's size; the condition below needs as many shared items
            floor = max(1, min(1 + least // LONGER, int(2 * t / (1 + t) * least)))
            pair = np.flatnonzero(shared >= floor)
            j, i = pair // nx + a, pair % nx
            ok = x.n[i] >= t * y.n[j] - 1e-6
            if same:
                ok &= i < j
            # an item that both have and that was not counted lies behind the prefix that ends first in the common order
            need = np.ceil(np.round(t / (1 + t) * (x.n[i] + y.n[j]), 6))
            ok &= shared[pair] + np.maximum(x.n[i] - index.prefix[i], y.n[j] - py[j]) >= need
            i, j = i[ok], j[ok]
            if len(i):
                both = _common(x, i, y, j)
                sim = both / (x.n[i] + y.n[j] - both)
                ok = sim >= t
                yield i[ok], j[ok], sim[ok]
        a = b


def _common(x: Block, i: np.ndarray, y: Block, j: np.ndarray) -> np.ndarray:
    """How many items sets i of x share with sets j of y; j ascends."""
    out, cuts = np.zeros(len(i), np.int64), np.concatenate([[0], np.flatnonzero(np.diff(j)) + 1, [len(j)]])
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.sort(y.ids[y.start[j[p]] : y.start[j[p]] + y.size[j[p]]])
        for s in range(p, q, 4096):
            e = min(q, s + 4096)
            k = x.size[i[s:e]]
            cells = x.ids[np.repeat(x.start[i[s:e]], k) + _ramp(k)]
            has = own[np.minimum(np.searchsorted(own, cells), len(own) - 1)] == cells
            out[s:e] = np.bincount(np.repeat(np.arange(e - s), k), weights=has, minlength=e - s)
    return out


def pairs(stored: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, stored: all pairs of different sets of at least the threshold; equal sets stand with their least key. stored: from numbered."""
    spark, key = stored.sparkSession, stored.schema["key"].dataType
    packed = blocks(stored)
    cols = ["no", "least", "most", "keys", "n", "alone", "ids"]
    left, right = packed.select(*[F.col(c).alias(f"x_{c}") for c in cols]), packed.select(*[F.col(c).alias(f"y_{c}") for c in cols])
    # every pair of blocks meets once and is read from the stored table, so nothing is copied to disk
    met = left.hint("shuffle_replicate_nl").join(right, (F.col("x_no") <= F.col("y_no")) & (F.col("x_most") >= F.lit(float(threshold)) * F.col("y_least") - 1e-6))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for b in batches:
            for r in range(b.num_rows):
                c = dict(zip(b.schema.names, [col[r] for col in b.columns], strict=True))
                x, y = [Block(c[f"{s}_keys"].values, *(c[f"{s}_{k}"].as_py() for k in ("n", "alone", "ids"))) for s in "xy"]
                if c["x_no"].as_py() != last:
                    last, index = c["x_no"].as_py(), Index(x, threshold)
                for i, j, s in linked(index, y, threshold, c["y_no"].as_py() == last):
                    for a in range(0, len(i), 10_000):
                        yield pa.RecordBatch.from_arrays([x.keys.take(pa.array(i[a : a + 10_000])), y.keys.take(pa.array(j[a : a + 10_000])), pa.array(s[a : a + 10_000])], ["x", "y", "similarity"])

    with _batches(spark, 1):
        got = once(met.mapInArrow(join, StructType([StructField("x", key), StructField("y", key), StructField("similarity", DoubleType())])), "pairs")
    return got.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
