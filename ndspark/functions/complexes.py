"""Complex numbers as struct<re, im>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark.dtypes import DComplex, DType, literal
from ndspark.functions import ieee


def make(re: Column, im: Column, t: DType | None = None) -> Column:
    return F.struct((re.cast(t.real.spark) if t else re).alias("re"), (im.cast(t.real.spark) if t else im).alias("im"))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    top = mul(a, conj(b))
    return make(ieee.div(top["re"], size), ieee.div(top["im"], size))


def negate(a: Column) -> Column:
    return make(-a["re"], -a["im"])


def conj(a: Column) -> Column:
    return make(a["re"], -a["im"])


def times_i(a: Column) -> Column:
    return make(-a["im"], a["re"])


def absolute(a: Column) -> Column:
    return F.hypot(a["re"].cast("double"), a["im"].cast("double"))


def arg(a: Column) -> Column:
    return F.atan2(a["im"].cast("double"), a["re"].cast("double"))


def int_power(a: Column, p: int, t: DType) -> Column:
    out, base, n = literal(1, t), a, abs(p)
    while n:
        if n & 1:
            out = mul(out, base)
        base, n = mul(base, base), n >> 1
    return div(literal(1, t), out) if p < 0 else out


def exp(a: Column) -> Column:
    e = F.exp(a["re"])
    return make(e * F.cos(a["im"]), e * F.sin(a["im"]))


def log(a: Column) -> Column:
    return make(ieee.log(absolute(a)), arg(a))


def sqrt(a: Column) -> Column:
    """Principal value."""
    size = absolute(a)
    re = F.sqrt((size + a["re"]) / 2)
    im = F.sqrt((size - a["re"]) / 2)
    return make(re, F.when(a["im"] < 0, -im).otherwise(im))


def sin(a: Column) -> Column:
    return make(F.sin(a["re"]) * F.cosh(a["im"]), F.cos(a["re"]) * F.sinh(a["im"]))


def cos(a: Column) -> Column:
    return make(F.cos(a["re"]) * F.cosh(a["im"]), -F.sin(a["re"]) * F.sinh(a["im"]))


def sinh(a: Column) -> Column:
    return make(F.sinh(a["re"]) * F.cos(a["im"]), F.cosh(a["re"]) * F.sin(a["im"]))


def cosh(a: Column) -> Column:
    return make(F.cosh(a["re"]) * F.cos(a["im"]), F.sinh(a["re"]) * F.sin(a["im"]))


def _one() -> Column:
    return literal(1, DComplex)


def _minus_i(a: Column) -> Column:
    return make(a["im"], -a["re"])


def asin(a: Column) -> Column:
    return _minus_i(log(add(times_i(a), sqrt(sub(_one(), mul(a, a))))))


def acos(a: Column) -> Column:
    half_pi = literal(1.5707963267948966, DComplex)
    return sub(half_pi, asin(a))


def atan(a: Column) -> Column:
    two_i = literal(2j, DComplex)
    return div(log(div(add(_one(), times_i(a)), sub(_one(), times_i(a)))), two_i)


def asinh(a: Column) -> Column:
    return log(add(a, sqrt(add(mul(a, a), _one()))))


def acosh(a: Column) -> Column:
    return log(add(a, mul(sqrt(add(a, _one())), sqrt(sub(a, _one())))))


def atanh(a: Column) -> Column:
    return div(log(div(add(_one(), a), sub(_one(), a))), literal(2, DComplex))


def tan(a: Column) -> Column:
    return div(sin(a), cos(a))


def tanh(a: Column) -> Column:
    return div(sinh(a), cosh(a))


def cbrt(a: Column) -> Column:
    size, angle = F.cbrt(absolute(a)), arg(a) / 3
    return make(size * F.cos(angle), size * F.sin(angle))


def _scaled(f, k: float):
    return lambda a: mul(f(a), literal(k, DComplex))


FUNCTIONS = {
    "sqrt": sqrt, "cbrt": cbrt, "exp": exp, "log": log, "sin": sin, "cos": cos, "tan": tan, "asin": asin, "acos": acos, "atan": atan,
    "sinh": sinh, "cosh": cosh, "tanh": tanh, "asinh": asinh, "acosh": acosh, "atanh": atanh,
    "log2": _scaled(log, 1.4426950408889634), "log10": _scaled(log, 0.4342944819032518),
    "exp2": lambda a: exp(mul(a, literal(0.6931471805599453, DComplex))), "exp10": lambda a: exp(mul(a, literal(2.302585092994046, DComplex))),
    "sinc": lambda a: F.when((a["re"] == 0) & (a["im"] == 0), literal(1, DComplex)).otherwise(div(sin(a), a)),
}
