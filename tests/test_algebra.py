import math

import pytest
from pyspark.sql import functions as F

from sumfold.operators import algebra as A

ALL = [A.ADD, A.MULTIPLY, A.MAX, A.MIN, A.INTEGERS, A.NATURAL, A.TROPICAL]


@pytest.mark.parametrize("x", ALL, ids=lambda x: x.name)
@pytest.mark.parametrize("triple", [(1, 2, 3), (-5, 0, 7), (0, 0, 0), (1.5, -2.25, 1e3)])
def test_laws(x, triple):
    assert x.lawful(*triple), x.verify(*triple)


def test_boolean_laws():
    assert all(A.BOOLEAN.lawful(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False))


def test_broken_laws_are_found():
    assert not A.Algebra("minus", lambda a, b: a - b).verify(5, 3, 1)["associativity"]
    assert not A.Algebra("add", lambda a, b: a + b, 1).verify(5, 3, 1)["left_identity"]
    assert not A.Algebra("add", lambda a, b: a + b, 0, lambda a: a).verify(5, 3, 1)["left_inverse"]
    assert not A.Algebra("odd", lambda a, b: a + b, 0, None, lambda a, b: a + b, 0).verify(5, 3, 1)["left_distributivity"]


def test_kinds():
    assert [x.kind for x in (A.Algebra("s", max), A.MAX, A.ADD, A.NATURAL, A.INTEGERS)] == ["semigroup", "monoid", "group", "semiring", "ring"]


def test_folds():
    assert A.ADD.combine_all([1, 2, 3]) == 6 and A.ADD.combine_all([]) == 0 and A.MAX.combine_all([]) == -math.inf
    assert A.Algebra("s", max).combine_all([]) is None
    assert A.ADD.combine_option(None, 5) == 5 and A.ADD.combine_option(5, None) == 5 and A.ADD.combine_option(None, None) == 0 and A.ADD.combine_option(2, 3) == 5
    assert A.ADD.minus(5, 3) == 2
    with pytest.raises(TypeError):
        A.MAX.minus(1, 2)


def test_elements():
    assert sum([A.ADD.of(1), A.ADD.of(2)]).value == 3 and sum([A.MAX.of(1), A.MAX.of(9), A.MAX.of(4)]).value == 9
    assert (A.ADD.of(5) - A.ADD.of(3)).value == 2 and (-A.ADD.of(5)).value == -5 and (A.INTEGERS.of(4) * A.INTEGERS.of(3)).value == 12
    assert A.ADD.of(0).is_zero() and A.ADD.of(7).zero().value == 0 and A.ADD.of(1) == A.ADD.of(1) and hash(A.ADD.of(1)) == hash(A.ADD.of(1))
    with pytest.raises(TypeError):
        A.ADD.of(1) + A.MAX.of(1)
    with pytest.raises(TypeError):
        A.ADD.of(1) * A.ADD.of(2)


def test_operators_for_own_classes():
    @A.with_operators
    class Celsius:
        def __init__(self, t):
            self.t = t

        def combine(self, other):
            return Celsius(self.t + other.t)

        def inverse(self):
            return Celsius(-self.t)

        def times(self, other):
            return Celsius(self.t * other.t)

    class Count(A.Operators):
        def __init__(self, n):
            self.n = n

        def plus(self, other):
            return Count(self.n + other.n)

        def negate(self):
            return Count(-self.n)

    assert sum([Celsius(1), Celsius(2)]).t == 3 and (Celsius(5) - Celsius(2)).t == 3 and (-Celsius(5)).t == -5 and (Celsius(2) * Celsius(3)).t == 6
    assert sum([Count(1), Count(2)]).n == 3 and (Count(5) - Count(2)).n == 3
    assert isinstance(Celsius(1), A.Combines) and isinstance(Celsius(1), A.Inverts) and isinstance(Count(1), A.Adds) and isinstance(Count(1), A.Negates) and not isinstance(Count(1), A.Multiplies)


def test_frame_laws_and_products(spark):
    t = spark.createDataFrame([(1.0, 2.0, 3.0), (-1.0, 0.0, 4.0)], "a double, b double, c double")
    assert all(r.holds for r in A.INTEGERS.verify_frame(t).collect())
    bad = {r.law: r.holds for r in A.Algebra("minus", lambda a, b: a - b).verify_frame(t).collect()}
    assert bad == {"associativity": False}
    assert all(r.holds for r in A.ADD.verify_frame(t.limit(0)).collect())
    b = spark.createDataFrame([(True, False, True), (False, False, True)], "a boolean, b boolean, c boolean")
    assert all(r.holds for r in A.BOOLEAN.verify_frame(b, exact=True).collect())
    m = spark.createDataFrame([(0, 1, 2.0), (0, 2, 5.0), (1, 2, 1.0)], "i int, k int, v double")
    n = m.toDF("k", "j", "v")
    got = {(r.i, r.j): r.v for r in A.matrix_product(m, n, A.TROPICAL).collect()}
    assert got == {(0, 2): 3.0}
    arrays = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>").select(A.ADD.fold(F.col("x")).alias("s"))
    assert [r.s for r in arrays.collect()] == [6, 0]
