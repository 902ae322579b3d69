"""HyperLogLog distinct counts: registers as rows (idx, rank)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumfold.functions import hashing
from sumfold.operators.sketch import Sketch

#: Bias corrections of small register counts.
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}


def alpha(m: int) -> float:
    return ALPHA.get(m, 0.7213 / (1 + 1.079 / m))


def standard_error(p: int) -> float:
    return 1.04 / math.sqrt(1 << p)


def _checked(p: int) -> int:
    if not 4 <= p <= 16:
        raise ValueError("precision must be 4 to 16")
    return p


def register(item: Column, p: int) -> tuple[Column, Column]:
    """(idx, rank): the low p bits pick the register; rank is the leading zeros of the rest, plus one."""
    h = hashing.digest(item)
    idx = hashing.low(h).bitwiseAND(F.lit((1 << p) - 1)).cast("int")
    return idx, (F.least(hashing.leading_zeros(h), F.lit(64 - p)) + 1).cast("int")


class HyperLogLog(Sketch):
    cells, value, merge = ("idx",), "rank", "max"

    @classmethod
    def build(cls, df: DataFrame, item: str, keys: tuple[str, ...] = (), precision: int = 14) -> HyperLogLog:
        """Registers for each group; null items do not count."""
        idx, rank = register(F.col(item), _checked(precision))
        rows = df.where(F.col(item).isNotNull()).select(*keys, idx.alias("idx"), rank.alias("rank"))
        return cls(cls._reduced(rows, keys), keys, precision=precision)

    def cardinality(self, name: str = "cardinality", large_range: bool = False) -> DataFrame:
        """Estimates by group. large_range applies the correction for 32-bit hashes, which 64-bit hashes do not need."""
        m = 1 << self.params["precision"]
        got = self.df.groupBy(*self.keys).agg(F.count("*").alias("_used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_sum"))
        return got.select(*self.keys, estimate(F.col("_used"), F.col("_sum"), m, large_range).alias(name))


def estimate(used: Column, inverse_sum: Column, m: int, large_range: bool = False) -> Column:
    """Estimate from the number of registers set and their sum of 2**-rank."""
    zeros = m - used
    raw = F.lit(alpha(m) * m * m) / (F.coalesce(inverse_sum, F.lit(0.0)) + zeros)
    full = raw
    if large_range:
        two32 = float(1 << 32)
        full = F.when(raw > two32 / 30, -two32 * F.log(1 - raw / two32)).otherwise(raw)
    small = F.when((raw <= 2.5 * m) & (zeros > 0), m * F.log(m / F.when(zeros > 0, zeros)))
    return F.floor(F.coalesce(small, full)).cast("long")


def estimate_cardinality(df: DataFrame, item: str, precision: int = 14) -> DataFrame:
    return HyperLogLog.build(df, item, (), precision).cardinality()


# serialization: one byte of precision, then a byte for each register; text form: %%% and base64
MAGIC = "%%%"


def to_bytes(sketch: HyperLogLog, name: str = "bytes") -> DataFrame:
    """The registers of each group as binary."""
    p = sketch.params["precision"]
    pairs = F.map_from_entries(F.collect_list(F.struct("idx", "rank")))
    packed = sketch.df.groupBy(*sketch.keys).agg(pairs.alias("_m"))
    hexed = F.transform(F.sequence(F.lit(0), F.lit((1 << p) - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0))), 2, "0"))
    return packed.select(*sketch.keys, F.unhex(F.concat(F.lit(f"{p:02X}"), F.array_join(hexed, ""))).alias(name))


def to_magic(binary: Column) -> Column:
    return F.concat(F.lit(MAGIC), F.regexp_replace(F.base64(binary), r"\s", ""))


def from_text(text: Column) -> Column:
    """Binary from a magic string or plain base64; null if it is neither."""
    return F.call_function("try_to_binary", F.when(text.startswith(MAGIC), F.substring(text, 4, 1 << 30)).otherwise(text), F.lit("base64"))


def serialize(binary: Column, form: str = "magic") -> Column:
    if form not in ("magic", "base64"):
        raise ValueError(f"unknown format {form!r}")
    return to_magic(binary) if form == "magic" else F.regexp_replace(F.base64(binary), r"\s", "")


def from_bytes(df: DataFrame, binary: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Registers (keys, precision, idx, rank) of binaries; invalid ones give no rows."""
    h = F.hex(F.col(binary))
    p = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    good = df.where(F.col(binary).isNotNull() & p.between(4, 16) & (F.octet_length(binary) == 1 + F.expr(f"shiftleft(1, cast(conv(substring(hex({binary}), 1, 2), 16, 10) as int))")))
    cells = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length(binary) - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).alias("idx", "rank")
    return good.select(*keys, p.alias("precision"), cells).where("rank > 0")


def to_json(sketch: HyperLogLog, name: str = "json") -> DataFrame:
    """{"precision": p, "registers": [{"idx", "rank"}, …]} of each group, registers in order."""
    cells = F.sort_array(F.collect_list(F.struct("idx", "rank")))
    return sketch.df.groupBy(*sketch.keys).agg(F.to_json(F.struct(F.lit(sketch.params["precision"]).alias("precision"), cells.alias("registers"))).alias(name))


def from_json(df: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Registers (keys, precision, idx, rank) of JSON texts; invalid ones give no rows."""
    got = F.from_json(F.col(text), "precision int, registers array<struct<idx:int,rank:int>>")
    return df.select(*keys, got.alias("_s")).where("_s.precision between 4 and 16").select(*keys, F.col("_s.precision").alias("precision"), F.inline("_s.registers"))
