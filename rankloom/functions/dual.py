"""Derivatives of activations by dual numbers over columns.

An activation is a function of one value, written with the operators ``+ - * / **`` and the
functions of this module. Given a column it makes a column; given a ``Dual`` it makes the value and the
slope together, so a loss can chain the slope into its gradient.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Dual:
    """A column and its derivative."""

    value: Column
    slope: Column

    @staticmethod
    def of(x) -> Dual:
        if isinstance(x, Dual):
            return x
        return Dual(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))

    def __add__(self, other):
        other = Dual.of(other)
        return Dual(self.value + other.value, self.slope + other.slope)

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, other):
        return self + -Dual.of(other)

    def __rsub__(self, other):
        return Dual.of(other) - self

    def __mul__(self, other):
        other = Dual.of(other)
        return Dual(self.value * other.value, self.slope * other.value + self.value * other.slope)

    def __truediv__(self, other):
        other = Dual.of(other)
        quotient = self.value / other.value
        return Dual(quotient, (self.slope - quotient * other.slope) / other.value)

    def __rtruediv__(self, other):
        return Dual.of(other) / self

    def __pow__(self, power: float):
        return Dual(F.pow(self.value, F.lit(float(power))), power * F.pow(self.value, F.lit(power - 1.0)) * self.slope)

    __radd__, __rmul__ = __add__, __mul__


def _lifted(f: Callable[[Column], Column], slope: Callable[[Column, Column], Column]):
    """A function of columns and duals; ``slope`` gets the argument and the result."""
    def run(x):
        if not isinstance(x, Dual):
            return f(x)
        y = f(x.value)
        return Dual(y, slope(x.value, y) * x.slope)

    return run


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


exp = _lifted(F.exp, lambda x, y: y)
log = _lifted(F.log, lambda x, y: F.lit(1.0) / x)
sqrt = _lifted(F.sqrt, lambda x, y: F.lit(0.5) / y)
tanh = _lifted(F.tanh, lambda x, y: F.lit(1.0) - y * y)
sigmoid = _lifted(_logistic, lambda x, y: y * (F.lit(1.0) - y))
softplus = _lifted(lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))), lambda x, y: _logistic(x))
relu = _lifted(lambda x: F.greatest(x, F.lit(0.0)), lambda x, y: F.when(x > 0, 1.0).otherwise(0.0))


def identity(x):
    return x


#: Activations by name.
NAMED = {"identity": identity, "sigmoid": sigmoid, "tanh": tanh, "softplus": softplus, "relu": relu}


def value_and_slope(activation: str | Callable | None, x: Column) -> tuple[Column, Column]:
    """An activation's value and derivative at ``x``."""
    f = identity if activation is None else NAMED[activation] if isinstance(activation, str) else activation
    try:
        found = f(Dual(x, F.lit(1.0)))
    except Exception as error:
        raise TypeError("an activation to be differentiated uses the functions of rankloom.functions.dual") from error
    found = Dual.of(found)
    return found.value, found.slope
