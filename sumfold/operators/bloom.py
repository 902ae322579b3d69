"""Bloom filters as rows of set bits, with a packed form for probing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.functions import hashing
from sumfold.operators.sketch import Sketch

PACKED_LIMIT = 8 << 20  # bits of a filter that may be broadcast as words


def sizing(capacity: int, error_rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for a capacity and a false-positive rate."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if not 0 < error_rate < 1:
        raise ValueError("error_rate must be between 0 and 1")
    bits = math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2)
    return bits, max(1, math.ceil(bits / capacity * math.log(2)))


def capacity(df: DataFrame, item: str, keys: tuple[str, ...] = ()) -> int:
    """A capacity for the items of every group: the largest approximate distinct count and a tenth more, 1 at least."""
    n = df.groupBy(*keys).agg(F.approx_count_distinct(item, 0.02).alias("n")).agg(F.max("n").alias("n")).first().n
    return max(1, math.ceil(1.1 * (n or 0)))


def positions(item: Column, bits: int, hashes: int) -> Column:
    """Bit numbers of an item: (h1 + i * h2) mod bits, both hashes seeded."""
    a, b = hashing.modulo(hashing.seeded_digest(0, item), bits), hashing.modulo(hashing.seeded_digest(1, item), bits)
    pair = F.struct(a.alias("a"), b.alias("b"))
    return F.transform(F.array(pair), lambda p: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(p["a"] + i * p["b"], F.lit(bits))))[0]


class BloomFilter(Sketch):
    cells, value = ("bit",), None

    @classmethod
    def build(cls, df: DataFrame, item: str, keys: tuple[str, ...] = (), capacity: int = 10_000, error_rate: float = 0.01) -> BloomFilter:
        """Bits of each group's items; null items are left out. Items are made distinct before they are hashed."""
        bits, hashes = sizing(capacity, error_rate)
        items = df.where(F.col(item).isNotNull()).select(*keys, F.col(item).alias("_item")).distinct()
        rows = items.select(*keys, F.explode(positions(F.col("_item"), bits, hashes)).alias("bit"))
        return cls(cls._reduced(rows, keys), keys, bits=bits, hashes=hashes)

    def probe(self, df: DataFrame, item: str, name: str = "maybe") -> DataFrame:
        """df plus whether the filter may hold the item (of the row's group). Null items are not held.

        An item is held if all its bits are rows of the sketch: the distinct items' bits are joined with the sketch
        and counted, so neither side has to fit in memory.
        """
        bits, hashes = self.params["bits"], self.params["hashes"]
        asked = df.where(F.col(item).isNotNull()).select(*self.keys, F.col(item).alias("_item")).distinct()
        need = asked.select(*self.keys, "_item", F.explode(F.array_distinct(positions(F.col("_item"), bits, hashes))).alias("bit"))
        held = need.join(self.df.select(*self.keys, "bit", F.lit(1).alias("_hit")), [*self.keys, "bit"], "left")
        held = held.groupBy(*self.keys, "_item").agg((F.count("_hit") == F.count(F.lit(1))).alias(name))
        return df.join(held.withColumnRenamed("_item", item), [*self.keys, item], "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def holders(self, df: DataFrame, item: str) -> DataFrame:
        """(keys, item): the groups whose filter may hold each distinct item of df. Groups and items meet on their bits, never all with all."""
        bits, hashes = self.params["bits"], self.params["hashes"]
        asked = df.where(F.col(item).isNotNull()).select(F.col(item).alias("_item")).distinct()
        need = asked.select("_item", F.array_distinct(positions(F.col("_item"), bits, hashes)).alias("_bits"))
        hits = need.select("_item", F.size("_bits").alias("_need"), F.explode("_bits").alias("bit")).join(self.df, "bit")
        full = hits.groupBy(*self.keys, "_item", "_need").agg(F.count("*").alias("_n")).where("_n = _need")
        return full.select(*self.keys, F.col("_item").alias(item))

    def saturation(self) -> DataFrame:
        """bits set, saturation, and two estimates of the false-positive rate: by saturation as load, and by set bits."""
        m, k = self.params["bits"], self.params["hashes"]
        s = F.col("saturation")
        out = self.df.groupBy(*self.keys).agg(F.count("*").alias("bits_set")).withColumn("saturation", F.col("bits_set") / m)
        return out.withColumn("expected_fpr", F.pow(1 - F.exp(-k * s), F.lit(k))).withColumn("fpr_from_saturation", F.pow(s, F.lit(k)))

    def words(self) -> DataFrame:
        """Packed form: rows (word number, 64 bits)."""
        word = F.floor(F.col("bit") / 64).cast("long").alias("word")
        return self.df.groupBy(*self.keys, word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
