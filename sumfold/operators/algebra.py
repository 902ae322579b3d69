"""Algebraic structures as plain descriptions.

An Algebra names its operations: `plus` alone makes a semigroup, with `zero` a monoid, with
`negate` a group, with `times` and `one` a semiring or (with `negate`) a ring. Operations
are functions of two values; written with operators they serve Python values and Spark
Columns alike, so one description drives local folds, array folds and law checks over a
DataFrame. Operators `+ - *` and sum() come from Element (or, for own classes, from
`with_operators`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSENT = object()
EPS = 1e-10


@runtime_checkable
class Combines(Protocol):
    def combine(self, other): ...


@runtime_checkable
class HasZero(Protocol):
    def zero(self): ...


@runtime_checkable
class Inverts(Protocol):
    def inverse(self): ...


@runtime_checkable
class Adds(Protocol):
    def plus(self, other): ...


@runtime_checkable
class Multiplies(Protocol):
    def times(self, other): ...


@runtime_checkable
class Negates(Protocol):
    def negate(self): ...


def near(x, y, eps: float = EPS) -> bool:
    """Numbers within eps (or equal, which covers infinities); other values equal."""
    if isinstance(x, int | float) and isinstance(y, int | float) and not isinstance(x, bool) and not isinstance(y, bool):
        return x == y or abs(x - y) < eps
    return x == y


@dataclass(frozen=True)
class Algebra:
    name: str
    plus: Callable[[Any, Any], Any]
    zero: Any = ABSENT
    negate: Callable[[Any], Any] | None = None
    times: Callable[[Any, Any], Any] | None = None
    one: Any = ABSENT

    @property
    def kind(self) -> str:
        if self.times is not None:
            return "ring" if self.negate is not None else "semiring"
        if self.negate is not None:
            return "group"
        return "monoid" if self.zero is not ABSENT else "semigroup"

    def combine_all(self, values: Iterable) -> Any:
        """Left fold; of nothing: the zero, or None where there is none."""
        values = list(values)
        if not values:
            return None if self.zero is ABSENT else self.zero
        return reduce(self.plus, values)

    def combine_option(self, a, b):
        """None stands for the zero."""
        if a is None or b is None:
            one = b if a is None else a
            return (None if self.zero is ABSENT else self.zero) if one is None else one
        return self.plus(a, b)

    def minus(self, a, b):
        if self.negate is None:
            raise TypeError(f"{self.name} has no inverse")
        return self.plus(a, self.negate(b))

    def of(self, value) -> Element:
        return Element(self, value)

    def fold(self, array: Column, zero: Any = ABSENT) -> Column:
        """Fold of an array column from the zero."""
        start = self.zero if zero is ABSENT else zero
        if start is ABSENT:
            raise ValueError(f"{self.name} has no zero to fold from")
        return F.aggregate(array, start if isinstance(start, Column) else F.lit(start), self.plus)

    def _laws(self) -> dict[str, Callable]:
        p, t, n = self.plus, self.times, self.negate
        laws: dict[str, Callable] = {"associativity": lambda a, b, c: (p(p(a, b), c), p(a, p(b, c)))}
        if self.zero is not ABSENT:
            laws |= {"left_identity": lambda a, b, c: (p(self.zero, a), a), "right_identity": lambda a, b, c: (p(a, self.zero), a)}
        if n is not None:
            laws |= {"left_inverse": lambda a, b, c: (p(n(a), a), self.zero), "right_inverse": lambda a, b, c: (p(a, n(a)), self.zero)}
        if t is not None:
            laws |= {
                "commutativity": lambda a, b, c: (p(a, b), p(b, a)),
                "times_associativity": lambda a, b, c: (t(t(a, b), c), t(a, t(b, c))),
                "left_distributivity": lambda a, b, c: (t(a, p(b, c)), p(t(a, b), t(a, c))),
                "right_distributivity": lambda a, b, c: (t(p(a, b), c), p(t(a, c), t(b, c))),
            }
            if self.one is not ABSENT:
                laws |= {"left_unit": lambda a, b, c: (t(self.one, a), a), "right_unit": lambda a, b, c: (t(a, self.one), a)}
            if n is None and self.zero is not ABSENT:
                laws |= {"left_annihilator": lambda a, b, c: (t(self.zero, a), self.zero), "right_annihilator": lambda a, b, c: (t(a, self.zero), self.zero)}
        return laws

    def verify(self, a, b, c, eps: float = EPS) -> dict[str, bool]:
        """Which of the structure's laws hold for three values."""
        return {name: near(*law(a, b, c), eps) for name, law in self._laws().items()}

    def lawful(self, a, b, c, eps: float = EPS) -> bool:
        return all(self.verify(a, b, c, eps).values())

    def verify_frame(self, triples: DataFrame, a: str = "a", b: str = "b", c: str = "c", eps: float = EPS, exact: bool = False) -> DataFrame:
        """(algebra, law, holds, checked) over all rows of triples in one aggregate.

        Operations must be written for Columns. exact compares with null-safe equality instead of eps.
        """
        x, y, z = (F.col(n) for n in (a, b, c))
        cols = []
        for name, law in self._laws().items():
            left, right = (v if isinstance(v, Column) else F.lit(v) for v in law(x, y, z))
            same = left.eqNullSafe(right) if exact else (left == right) | (F.abs(left - right) < eps)
            cols.append(F.bool_and(same).alias(name))
        one = triples.agg(F.count("*").alias("checked"), *cols)
        rows = F.array(*[F.struct(F.lit(n).alias("law"), F.coalesce(F.col(n), F.lit(True)).alias("holds")) for n in self._laws()])
        return one.select(F.lit(self.name).alias("algebra"), F.inline(rows), "checked")


@dataclass(frozen=True)
class Element:
    """A value under an algebra, with operators. sum() works, since 0 + x is x."""

    algebra: Algebra
    value: Any

    def _with(self, other, f):
        if not isinstance(other, Element) or other.algebra is not self.algebra:
            raise TypeError(f"cannot combine with {other!r}")
        return Element(self.algebra, f(self.value, other.value))

    def combine(self, other: Element) -> Element:
        return self._with(other, self.algebra.plus)

    def zero(self) -> Element:
        return Element(self.algebra, self.algebra.zero)

    def is_zero(self) -> bool:
        return near(self.value, self.algebra.zero)

    def __add__(self, other):
        return self if isinstance(other, int) and other == 0 else self.combine(other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._with(other, self.algebra.minus)

    def __neg__(self):
        if self.algebra.negate is None:
            raise TypeError(f"{self.algebra.name} has no inverse")
        return Element(self.algebra, self.algebra.negate(self.value))

    def __mul__(self, other):
        if self.algebra.times is None:
            raise TypeError(f"{self.algebra.name} has no product")
        return self._with(other, self.algebra.times)


def with_operators(cls):
    """Class decorator: + and sum() from combine or plus, - and unary - from inverse or negate, * from times."""
    add = getattr(cls, "combine", None) or getattr(cls, "plus", None)
    neg = getattr(cls, "inverse", None) or getattr(cls, "negate", None)
    if add is not None:
        cls.__add__ = lambda self, other: self if isinstance(other, int) and other == 0 else add(self, other)
        cls.__radd__ = cls.__add__
    if neg is not None:
        cls.__neg__ = lambda self: neg(self)
        cls.__sub__ = lambda self, other: add(self, neg(other))
    if (times := getattr(cls, "times", None)) is not None:
        cls.__mul__ = lambda self, other: times(self, other)
    return cls


class Operators:
    """The same by inheritance."""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        with_operators(cls)


ADD = Algebra("add", lambda a, b: a + b, 0, lambda a: -a)
MULTIPLY = Algebra("multiply", lambda a, b: a * b, 1)


def _either(column: Callable, local: Callable) -> Callable:
    """An operation for Columns and for Python values."""
    return lambda a, b: column(*(x if isinstance(x, Column) else F.lit(x) for x in (a, b))) if isinstance(a, Column) or isinstance(b, Column) else local(a, b)


MAX = Algebra("max", _either(F.greatest, max), float("-inf"))
MIN = Algebra("min", _either(F.least, min), float("inf"))
INTEGERS = Algebra("integers", lambda a, b: a + b, 0, lambda a: -a, lambda a, b: a * b, 1)
NATURAL = Algebra("natural", lambda a, b: a + b, 0, None, lambda a, b: a * b, 1)
BOOLEAN = Algebra("boolean", lambda a, b: a | b, False, None, lambda a, b: a & b, True)
TROPICAL = Algebra("tropical", MIN.plus, float("inf"), None, lambda a, b: a + b, 0.0)

_sums = {"natural": F.sum, "integers": F.sum, "boolean": F.bool_or, "tropical": F.min, "add": F.sum, "max": F.max, "min": F.min}


def matrix_product(left: DataFrame, right: DataFrame, semiring: Algebra, i: str = "i", k: str = "k", j: str = "j", value: str = "v") -> DataFrame:
    """(i, j, v): the product of two sparse matrices (i, k, v) and (k, j, v) over a semiring, as a join and an aggregate.

    Cells that are absent are zeros and stay absent.
    """
    a = left.select(F.col(i).alias("i"), F.col(k).alias("k"), F.col(value).alias("x"))
    b = right.select(F.col(k).alias("k"), F.col(j).alias("j"), F.col(value).alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(_sums[semiring.name](semiring.times(F.col("x"), F.col("y"))).alias("v"))


def retract(total: DataFrame, removed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group subtraction of sums: signed deltas in one aggregate, no join."""
    signed = total.select(*keys, F.col(value).alias("d")).unionByName(removed.select(*keys, (-F.col(value)).alias("d")))
    return signed.groupBy(*keys).agg(F.sum("d").alias(value))
