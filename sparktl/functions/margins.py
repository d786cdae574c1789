"""Signed margins of comparisons, and scalar functions with plain floating-point results.

A margin is >= 0 where the comparison holds (strict and non-strict comparisons have one margin), and its
size says by how much. Inputs are cast to double. Where Spark's own function differs from IEEE
arithmetic the wrapper says so: logarithms give -Infinity and NaN instead of null, floor and ceil stay
doubles, and minimum and maximum pass over NaN. Division and remainder by zero raise, as ANSI mode does.

A margin of names, numbers and ``signal()`` values is a Term: it knows the signals in it and whether it is linear
in them, which dense time asks for. Plain Columns are taken everywhere too, but say nothing about themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True, eq=False)
class Term:
    """A value, the names of its signals, and its degree in them: 0 (constant), 1 (linear) or None (neither).

    sides: of an equality, "and" or "or" and the linear difference d for which it is that junction of d and -d.
    """

    column: Column
    signals: frozenset[str] = frozenset()
    degree: int | None = 0
    sides: tuple[str, Term] | None = None

    def cast(self, kind: str) -> Column:
        return self.column.cast(kind)

    def __add__(self, other):
        return _joined(lambda x, y: x + y, max, self, other)

    def __radd__(self, other):
        return _joined(lambda x, y: x + y, max, other, self)

    def __sub__(self, other):
        return _joined(lambda x, y: x - y, max, self, other)

    def __rsub__(self, other):
        return _joined(lambda x, y: x - y, max, other, self)

    def __mul__(self, other):
        return _joined(lambda x, y: x * y, lambda a, b: a + b, self, other)

    def __rmul__(self, other):
        return _joined(lambda x, y: x * y, lambda a, b: a + b, other, self)

    def __truediv__(self, other):
        return _joined(lambda x, y: x / y, lambda a, b: a + 2 * b, self, other)

    def __rtruediv__(self, other):
        return _joined(lambda x, y: x / y, lambda a, b: a + 2 * b, other, self)

    def __mod__(self, other):
        return _joined(lambda x, y: x % y, lambda a, b: 2 * (a + b), self, other)

    def __neg__(self):
        return _joined(lambda x: -x, lambda a: a, self)


def _joined(make, degree, *parts) -> Term | Column:
    """make of the parts; a Term where all of them say what they are. degree: of the result; 2 and more is not linear."""
    column = make(*map(real, parts))
    terms = [x if isinstance(x, Term) else None if isinstance(x, Column) else signal(x) if isinstance(x, str) else Term(F.lit(float(x))) for x in parts]
    if None in terms:
        return column
    known = [t.degree for t in terms]
    total = None if None in known else degree(*known)
    return Term(column, frozenset().union(*[t.signals for t in terms]), total if total in (0, 1) else None)


def signal(name: str) -> Term:
    return Term(F.col(f"`{name}`").cast("double"), frozenset([name]), 1)


def real(x: Column | Term | str | float) -> Column:
    x = signal(x) if isinstance(x, str) else x
    return (x.column if isinstance(x, Term) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def gt(x, y) -> Term | Column:
    return _joined(lambda a, b: a - b, max, x, y)


def lt(x, y) -> Term | Column:
    return _joined(lambda a, b: b - a, max, x, y)


ge, le = gt, lt


def _equality(x, y, sign: int, kind: str) -> Term | Column:
    out = _joined(lambda a, b: F.abs(a - b) * sign, lambda a, b: 2 * max(a, b), x, y)
    return Term(out.column, out.signals, out.degree, (kind, gt(x, y))) if isinstance(out, Term) else out


def eq(x, y) -> Term | Column:
    return _equality(x, y, -1, "and")


def ne(x, y) -> Term | Column:
    return _equality(x, y, 1, "or")


def _function(make):
    """make as a function of columns; of Terms it gives a Term, constant where they are."""

    def call(*parts):
        return _joined(make, lambda *known: 2 * max(known), *parts) if any(isinstance(x, Term) for x in parts) else make(*map(real, parts))

    call.__doc__ = make.__doc__
    return call


@_function
def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(float("nan")))


@_function
def log(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(float("nan")))


def _whole(x: Column, f) -> Column:
    # from 2^53 on every double is whole already, and Spark's result type could not hold it
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(f(x).cast("double"))


@_function
def floor(x: Column) -> Column:
    return _whole(x, F.floor)


@_function
def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


@_function
def minimum(x: Column, y: Column) -> Column:
    """The smaller; NaN sorts as the greatest, so least() passes over it already."""
    return F.least(x, y)


@_function
def maximum(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


@_function
def power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


absolute, sqrt, exp, sin, cos, tan = map(_function, (F.abs, F.sqrt, F.exp, F.sin, F.cos, F.tan))
