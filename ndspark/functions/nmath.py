"""Mathematical functions. Integers compute as DFloat, SFloat stays SFloat, bits have none."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.errors import OperationError
from ndspark.functions import complexes as cx
from ndspark.functions import ieee


# The published coefficients of Cody's rational approximations of the error function, highest power first,
# for |x| < 0.46875 (erf), up to 4 and beyond (erfc, the last in 1 / x**2).
_NEAR = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_NEAR_BELOW = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MIDDLE = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_MIDDLE_BELOW = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_FAR = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_FAR_BELOW = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _tail(x: Column) -> Column:
    """erfc of x >= 0.46875. exp(-x * x) in two factors: the square of a short part of x is exact."""
    short = F.floor(F.least(x, F.lit(30.0)) * 16) / 16
    fall = F.exp(-short * short) * F.exp(-(x - short) * (x + short))
    middle = _horner(_MIDDLE, x) / _horner(_MIDDLE_BELOW, x)
    z = 1 / (x * x)
    far = (1 / math.sqrt(math.pi) - z * _horner(_FAR, z) / _horner(_FAR_BELOW, z)) / x
    return F.when(x > 27, F.lit(0.0)).otherwise(fall * F.when(x <= 4, middle).otherwise(far))


def _near(x: Column) -> Column:
    """erf of |x| < 0.46875."""
    return x * _horner(_NEAR, x * x) / _horner(_NEAR_BELOW, x * x)


def erf(x: Column) -> Column:
    """By piecewise rational approximation, relative error below 1e-15; NaN stays."""
    a = F.abs(x)
    tail = F.when(a >= 6, F.lit(1.0)).otherwise(1 - _tail(F.when((a >= 0.46875) & (a < 6), a)))
    return F.when(F.isnan(x), x).when(a < 0.46875, _near(F.when(a < 0.46875, x))).when(x > 0, tail).otherwise(-tail)


def erfc(x: Column) -> Column:
    """1 - erf(x) without loss of digits for large x."""
    a = F.abs(x)
    tail = _tail(F.when(a >= 0.46875, F.least(a, F.lit(1e9))))
    return F.when(F.isnan(x), x).when(a < 0.46875, 1 - _near(F.when(a < 0.46875, x))).when(x > 0, tail).otherwise(2 - tail)


UNARY = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "log": ieee.log, "log2": ieee.log2, "log10": ieee.log10, "log1p": ieee.log1p,
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x), "expm1": F.expm1,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "sinc": lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / F.when(x != 0, x)),
    "erf": erf, "erfc": erfc,
}


def result_type(t: DType) -> DType:
    if t.kind == "b":
        raise OperationError("bits have no mathematical functions")
    return dt.DFloat if t.is_int else t


def unary(name: str, a: Column, t: DType) -> tuple[Column, DType]:
    out = result_type(t)
    if t.is_complex:
        if name not in cx.FUNCTIONS:
            raise OperationError(f"{name} isn't defined for complex numbers")
        return dt.cast(cx.FUNCTIONS[name](dt.cast(a, t, dt.DComplex)), dt.DComplex, out), out
    return UNARY[name](a.cast("double")).cast(out.spark), out


def binary(name: str, a: Column, b: Column, t: DType) -> tuple[Column, DType]:
    """atan2, hypot, ldexp (x * 2**n, in two steps so that the factor can't overflow)."""
    out = result_type(t)
    if t.is_complex:
        raise OperationError(f"{name} isn't defined for complex numbers")
    x, y = a.cast("double"), b.cast("double")
    if name == "ldexp":
        half = ieee.trunc(y / 2)
        return (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), y - half)).cast(out.spark), out
    return {"atan2": F.atan2, "hypot": F.hypot}[name](x, y).cast(out.spark), out


def frexp(a: Column, t: DType) -> tuple[tuple[Column, Column], DType]:
    """Mantissa in [0.5, 1) and exponent (Int32); zero, NaN and infinities are their own mantissa, with exponent 0.

    The logarithm may miss the exponent by one next to a power of two; the mantissa tells, and scaling by powers of two is exact.
    """
    out = result_type(t)
    x = a.cast("double")
    real = ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)
    guess = F.floor(F.log2(F.when(real, F.abs(x)))).cast("double") + 1
    half = ieee.trunc(guess / 2)
    scaled = x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - guess)
    over, under = F.abs(scaled) >= 1, F.abs(scaled) < 0.5
    mantissa = F.when(real, F.when(over, scaled / 2).when(under, scaled * 2).otherwise(scaled)).otherwise(x)
    exponent = F.when(real, guess + F.when(over, 1.0).when(under, -1.0).otherwise(0.0)).otherwise(F.lit(0.0))
    return (mantissa.cast(out.spark), exponent.cast("int")), out
