"""IEEE 754 semantics from Spark expressions, right with ANSI mode on and off.

Spark orders NaN above everything and equal to itself, raises or gives NULL for x / 0 and gives
NULL for logarithms outside their domain; these builders give what IEEE arithmetic gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def gt(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a)


def ge(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(b)


def div(a: Column, b: Column) -> Column:
    """a / b; an infinity with the sign of both for b = 0, NaN for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for b = 0."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def signbit(a: Column) -> Column:
    """True for negative numbers and -0.0."""
    return (a < 0) | ((a == 0) & (F.pow(a, F.lit(-1.0)) < 0))


def copysign(a: Column, b: Column) -> Column:
    return F.when(signbit(b), -F.abs(a)).otherwise(F.abs(a))


def sign(a: Column) -> Column:
    """-1, 0 or 1; +0.0 for both zeros, NaN for NaN."""
    return F.when(a == 0, F.lit(0.0)).otherwise(F.signum(a))


#: From here on every double is a whole number.
_WHOLE = float(1 << 52)


def _small(a: Column, f) -> Column:
    """f(a) where a may have a fraction; else a itself, infinities and NaN included."""
    small = F.abs(a) < _WHOLE
    return F.when(small, f(F.when(small, a))).otherwise(a)


def floor(a: Column) -> Column:
    return _small(a, lambda x: F.floor(x).cast("double"))


def ceil(a: Column) -> Column:
    return _small(a, lambda x: F.ceil(x).cast("double"))


def trunc(a: Column) -> Column:
    return _small(a, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def round_away(a: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return _small(a, lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double"))


def log(a: Column) -> Column:
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.ln(F.when(a > 0, a)))


def log2(a: Column) -> Column:
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.log2(F.when(a > 0, a)))


def log10(a: Column) -> Column:
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).otherwise(F.log10(F.when(a > 0, a)))


def log1p(a: Column) -> Column:
    return F.when(a == -1, F.lit(-INF)).when(a < -1, F.lit(NAN)).otherwise(F.log1p(F.when(a > -1, a)))


def without_nan(a: Column) -> Column:
    """NULL for NaN, which aggregates skip."""
    return F.when(~F.isnan(a), a)


def maximum(a: Column, b: Column, nan: bool = False) -> Column:
    """The larger; a NaN is skipped, or with ``nan`` passed on."""
    if nan:
        return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def minimum(a: Column, b: Column, nan: bool = False) -> Column:
    """The smaller; a NaN is skipped, or with ``nan`` passed on."""
    if nan:
        return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))
