"""Best-fit packing of token sequences, bulk-synchronous.

`pack` matches runs of equal documents with runs of equal gaps, which takes a count for each size
only. `pack_by_sweeps` matches documents one by one, as DataFrame jobs:

Documents are taken in classes of falling size. A superstep range-sorts the documents of a
class that are still unplaced, together with the gaps of all open sequences, by falling
size and matches every document with its successor, the least free gap that holds it:

* each range is swept on its own; a gap is put on a stack, a document takes the top one;
* what a range leaves over, documents without a gap and gaps without a document, is
  matched across ranges by rank: a document takes the gap at its level of the stack
  that the ranges before have left, and two that want one gap are told apart by their rank.

Then gaps are updated and the next superstep follows. A class meets the open sequences first; what is left
then meets them and as many empty ones as it may need, which are the last to be taken; those that nobody takes are forgotten.
The last class, of short documents, gets empty ones only for those that are larger than any gap.
A gap that surely holds several documents of the class is offered as
often. Supersteps are DataFrame jobs; the driver sees counts by size, by range and by superstep only.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumfold.llm.common import cut, small_batches

CAPACITY, FINE, ROW_BYTES, RANGE, RANKED = 2048, 6, 64, 4 << 20, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a tokenizers file, if it is a byte-level BPE whose ids follow its merges; else None."""
    spec = json.loads(Path(path).read_text())
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("unk_token"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    """Token ids as the tokenizers file gives them.

    Where the file is a byte-level BPE with ids in merge order, plain texts go through a faster engine for
    the same merges. Texts with characters on which pattern engines may differ, with a special
    token's string or with runs so long that the faster engine's merging would be quadratic go
    through tokenizers itself.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PLAIN = re.compile("[\\x20-\\x7e\\n\\t\\r\u00a1-\u00ac\u00ae-\u017f]*")
    LONG = re.compile(r"\S{1000}|\s{1000}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, ranks = Tokenizer.from_file(path), _byte_ranks(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None if ranks is None else tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or not self.PLAIN.fullmatch(text) or self.LONG.search(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces: its ids, then `end`. Only longer ones are cut; the first piece takes the remainder.

    A null text is an empty one and gives just `end`; ids may be null or repeated, repeated rows give their pieces each; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out = []
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                ids = np.array([*enc.ids(t or ""), end], "<u4")
                first = (len(ids) - 1) % capacity + 1
                at = 0
                for k in range(1 + (len(ids) - first) // capacity):
                    n = capacity if k else first
                    out.append((None if pd.isna(i) else int(i), k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInPandas(cuts, PIECES)


EVENT = "room long, kind int, sequence_id long, copy int, nameless boolean, " + PIECES
SWEPT = "state int, range int, at long, " + EVENT
MATCHED, UNPLACED, FREE = range(3)


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A range of events by falling size: gaps (kind 0) go on a stack, documents (kind 1) take its top. `at` counts what is left over, documents first."""
    here, stack, alone = TaskContext.get().partitionId(), [], 0
    for pdf in batches:
        taken, state, at = [], [], []
        for kind, gap in zip(pdf["kind"].tolist(), zip(pdf["sequence_id"].tolist(), pdf["copy"].tolist(), pdf["room"].tolist(), strict=True), strict=True):
            if kind == 0:
                stack.append(gap)
            elif stack:
                taken.append(stack.pop())
                state.append(MATCHED)
                at.append(0)
            else:
                taken.append((0, 0, 0))
                state.append(UNPLACED)
                at.append(alone)
                alone += 1
        docs = pdf[pdf["kind"] == 1]
        if len(docs):
            got = np.array(taken, np.int64).reshape(-1, 3)
            yield docs.assign(state=state, range=here, at=at, sequence_id=got[:, 0], copy=got[:, 1], room=got[:, 2])[_names(SWEPT)]
    for a in range(0, len(stack), 10_000):
        got = np.array(stack[a : a + 10_000], np.int64)
        free = dict.fromkeys(_names(SWEPT), 0) | {"state": FREE, "range": here, "at": np.arange(a, a + len(got)), "sequence_id": got[:, 0], "copy": got[:, 1], "room": got[:, 2], "nameless": False}
        yield pd.DataFrame(free)[_names(SWEPT)]


def _ranges(rows: int) -> int:
    """Ranges of about RANGE bytes, more of them on larger tables only up to 20000."""
    return min(20_000, -(-rows * ROW_BYTES // RANGE))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _superstep(todo: DataFrame, gaps: DataFrame, n: int, k: int, least: int, most: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Match the documents todo, n rows of lengths from least to most, with gaps (sequence_id, room), k of which hold the least: what was matched and where, what was not, the gaps after it, and how many were not."""
    spark = todo.sparkSession
    able = gaps.where(F.col("room") >= least)
    copies = F.greatest(F.lit(1), F.least(F.expr(f"room div {most}"), F.lit(-(-n // max(1, k)))))  # so often it holds a document of any length here
    none = [F.lit(False).alias("nameless"), *[F.lit(0).cast(t).alias(c) for c, t in (x.split() for x in PIECES.split(", "))]]
    offered = able.select("room", F.lit(0).alias("kind"), "sequence_id", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"), *none)
    asked = todo.select(F.col("length").alias("room"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).alias("copy"), "nameless", *_names(PIECES))
    order = [F.desc("room"), *_names(EVENT)[1:]]
    events = offered.unionAll(asked).repartitionByRange(_ranges(n + k), *order).sortWithinPartitions(*order)
    swept = cut(events.mapInPandas(_swept, SWEPT), "pack-swept")
    # the stack's height before each range, from two counts of a range
    sizes = swept.where(F.col("state") != MATCHED).groupBy("range").agg(F.count_if(F.col("state") == UNPLACED).alias("a"), F.count_if(F.col("state") == FREE).alias("b"))
    height, before, missed = 0, [], 0
    for r in sorted(sizes.collect()):
        before.append((r.range, height, max(0, height - r.a)))
        missed += max(0, r.a - height)
        height = max(0, height - r.a) + r.b
    before = spark.createDataFrame(before, "range int, high long, low long")
    rest = swept.where(F.col("state") != MATCHED).join(F.broadcast(before), "range")
    level = F.when(F.col("state") == UNPLACED, F.col("high") - F.col("at")).otherwise(F.col("low") + F.col("at") + 1)
    rest = rest.withColumn("level", level).drop("high", "low")
    told = Window.partitionBy("level").orderBy("range", "state")  # a range's documents come before its free gaps
    gap = F.lag(F.struct("sequence_id", "copy", "room")).over(told)
    across = rest.where("level > 0").withColumn("gap", gap).where(F.col("state") == UNPLACED)
    columns = ["sequence_id", "copy", "room", "nameless", *_names(PIECES)]
    across = across.select(F.col("gap.sequence_id").alias("sequence_id"), F.col("gap.copy").alias("copy"), F.col("gap.room").alias("room"), *columns[3:])
    matched = swept.where(F.col("state") == MATCHED).select(*columns).unionAll(across)
    inside = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("copy")) - F.col("length")
    matched = cut(matched.withColumn("inside", inside), "pack-matched")
    left = rest.where((F.col("state") == UNPLACED) & (F.col("level") <= 0)).select("nameless", *_names(PIECES))
    used = matched.select("sequence_id", (-F.col("length")).alias("room"))
    gaps = gaps.unionAll(used).groupBy("sequence_id").agg(F.sum("room").alias("room")).where(f"room between 1 and {capacity - 1}")
    return matched, left, cut(gaps, "pack-gaps"), missed


def pack_by_sweeps(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (gapless in each sequence) to rows as `pieces` gives them.

    Lengths are from 1 to the capacity. Equal lengths are told apart by id, piece and checksum, repeated rows are packed
    each, an empty table gives no rows. Events are dealt by size and then by id, so a size that holds a third of all rows is no single task.
    """
    spark = parts.sparkSession
    parts = cut(parts.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))}).select("nameless", *_names(PIECES)), "pack-pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each size
    gaps, opened, found = spark.createDataFrame([], "sequence_id long, room long"), 0, []
    while counts:
        most = max(counts)
        fits = capacity // most
        floor = capacity // (fits + 1) if fits < FINE else 0  # a class: lengths of which as many fit; of short ones, all
        here = {s: c for s, c in counts.items() if s > floor}
        counts = {s: c for s, c in counts.items() if s <= floor}
        todo, n, least, tried = parts.where(F.col("length").between(floor + 1, most)), sum(here.values()), min(here), False
        while n:
            k, widest = gaps.agg(F.count_if(F.col("room") >= least), F.coalesce(F.max("room"), F.lit(0))).first()
            new = 0
            if fits < FINE:
                new = -(-n // fits) if tried or not k else 0
            elif widest < most:  # some are larger than any gap: at least what their tokens need
                new = -(-(todo.where(F.col("length") > widest).agg(F.sum("length")).first()[0] or 0) // capacity)
            if new:
                gaps = gaps.unionAll(spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("room")))
                opened, k = opened + new, k + new
            matched, todo, gaps, n = _superstep(todo, gaps, n, k, least, most, capacity)
            found.append(matched)
            tried = True
            if n and fits >= FINE:
                least, most = todo.agg(F.min("length"), F.max("length")).first()
    out = found[0] if found else spark.createDataFrame([], "sequence_id long, copy int, room long, nameless boolean, " + PIECES + ", inside long")
    for part in found[1:]:
        out = out.unionAll(part)
    own = F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id")
    return out.select(own, *_names(PIECES)[1:], "sequence_id", (F.lit(capacity) - F.col("room") + F.col("inside")).alias("offset"))


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for runs of documents: rows of (size, first rank, documents, first sequence, documents in each sequence, offset of the first).

    Best fit with documents in descending size. A gap that holds m documents of the size takes
    m of them before the next gap is touched, as best fit does one by one.
    """
    sizes: list[int] = []  # gap sizes that occur, sorted
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, how many)
    plan, opened = [], 0

    def leave(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            gap = sizes[at] if at < len(sizes) else capacity
            per = gap // size
            want = max(1, left // per)
            if at < len(sizes):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                if n > want:
                    leave(gap, first + want, n - want)
                    n = want
            else:
                first, n = opened, want
                opened += n
            placed = min(left, n * per)
            plan.append((size, rank, placed, first, per, capacity - gap))
            leave(gap - size * min(per, placed), first, n)
            rank, left = rank + placed, left - placed
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (gapless in each sequence) to rows as `pieces` gives them: the same matching over runs of equal sizes and equal gaps.

    The plan's supersteps see one count for each size, so they run on the driver; documents are ranked and placed on the executors. An empty table gives no rows. Ranks within a size are counted by hashed buckets of about RANKED rows, so a size that
    holds a third of all rows is no single task. Repeated rows are packed each.
    """
    spark = parts.sparkSession
    parts = cut(parts, "pack-pieces")
    n = max(1, parts.count() // RANKED)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)))
    sizes = cut(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-sizes")  # sizes times buckets
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each size
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("in_bucket", F.row_number().over(order) - 1)
    ranked = ranked.join(sizes.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    plan = best_fit_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = sent.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            row = plan[np.searchsorted(keys, (size << 44) + rank, side="right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            t = rank - row[:, 1]
            yield pdf.drop(columns="rank").assign(sequence_id=row[:, 3] + t // row[:, 4], offset=row[:, 5] + t % row[:, 4] * size)

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_bucket")).alias("rank"))
    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
