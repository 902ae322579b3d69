"""Exact mergeable aggregates: numbers, sets, lists, maps, strings and optional values.

Column builders for use in agg() and select(). Non-commutative ones (lists, strings,
last-wins, first-wins) always take the column that orders the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# numbers: like the SQL aggregates, but an empty group gives the identity
def total(x) -> Column:
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def product(x) -> Column:
    return F.coalesce(F.product(_c(x)), F.lit(1.0))


def largest(x) -> Column:
    return F.coalesce(F.max(_c(x)).cast("double"), F.lit(float("-inf")))


def smallest(x) -> Column:
    return F.coalesce(F.min(_c(x)).cast("double"), F.lit(float("inf")))


def add(*xs) -> Column:
    """Sum across columns; nulls count as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(x), F.lit(0)) for x in xs], F.lit(0))


def multiply(*xs) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(_c(x), F.lit(1)) for x in xs], F.lit(1))


def max_of(*xs) -> Column:
    return F.greatest(*[F.coalesce(_c(x).cast("double"), F.lit(float("-inf"))) for x in xs], F.lit(float("-inf")))


def min_of(*xs) -> Column:
    return F.least(*[F.coalesce(_c(x).cast("double"), F.lit(float("inf"))) for x in xs], F.lit(float("inf")))


# collections
def set_of(x) -> Column:
    """Distinct values, sorted."""
    return F.sort_array(F.collect_set(_c(x)))


def set_union(*arrays) -> Column:
    """Union of array columns, sorted."""
    return F.sort_array(F.array_distinct(F.concat(*[F.coalesce(_c(a), F.array()) for a in arrays])))


def list_of(x, order_by) -> Column:
    """Values in the order of another column."""
    rows = F.sort_array(F.collect_list(F.struct(_c(order_by).alias("o"), _c(x).alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def concat_lists(*arrays) -> Column:
    return F.concat(*[F.coalesce(_c(a), F.array()) for a in arrays])


def string_of(x, order_by, separator: str = "") -> Column:
    """Concatenation in the order of another column; empty for no rows."""
    return F.array_join(list_of(x, order_by), separator)


def last_wins(x, order_by) -> Column:
    """The value of the latest row, null values included."""
    return F.max_by(_c(x), _c(order_by))


def first_some(x, order_by) -> Column:
    """The first value that is not null."""
    return F.min_by(_c(x), F.when(_c(x).isNotNull(), _c(order_by)))


_merges: dict[str, Callable] = {"sum": F.sum, "max": F.max, "min": F.min}


def merge_map_rows(rows: DataFrame, key: str, value: str, how: str = "sum", by: tuple[str, ...] = (), order_by: str | None = None) -> DataFrame:
    """Merge maps given as rows (by…, key, value): how is sum, max, min or last.

    The combiner belongs to the call, never to the data.
    """
    if how == "last":
        if order_by is None:
            raise ValueError("last-wins needs order_by")
        merged = last_wins(value, order_by)
    elif how in _merges:
        merged = _merges[how](value)
    else:
        raise ValueError(f"unknown merge {how!r}")
    return rows.groupBy(*by, key).agg(merged.alias(value))


def merge_maps(a, b, f: Callable[[Column, Column], Column]) -> Column:
    """Merge two map columns; f combines values of keys that both have."""
    return F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(f(x, y)))


# optional values: null is none
def is_some(x) -> Column:
    return _c(x).isNotNull()


def value(x) -> Column:
    """The value; an error for none."""
    return F.when(_c(x).isNotNull(), _c(x)).otherwise(F.raise_error(F.lit("no value")))


def get_or_else(x, default) -> Column:
    return F.coalesce(_c(x), default if isinstance(default, Column) else F.lit(default))


def map_some(x, f: Callable[[Column], Column]) -> Column:
    """f of the value; none stays none. Serves flat_map as well, since f may give null."""
    return F.when(_c(x).isNotNull(), f(_c(x)))


def filter_some(x, keep: Callable[[Column], Column]) -> Column:
    return F.when(keep(_c(x)), _c(x))


def or_else(*xs) -> Column:
    """The leftmost value."""
    return F.coalesce(*[_c(x) for x in xs])


def combine_some(x, y, f: Callable[[Column, Column], Column]) -> Column:
    """f of both values, the only one, or none."""
    return F.when(_c(x).isNull(), _c(y)).when(_c(y).isNull(), _c(x)).otherwise(f(_c(x), _c(y)))


def flatten_some(array) -> Column:
    return F.array_compact(_c(array))


def sequence_some(x, order_by) -> Column:
    """All values in order, or none if any is missing."""
    return F.when(F.count(F.lit(1)) == F.count(_c(x)), list_of(x, order_by))
