"""Elementwise operations by element type: (operands as columns of type ``t``) -> (column, result type).

Integer results are checked (they raise on overflow); ``wrap=True`` gives two's complement. A zero
divisor of integers raises, of floats gives what IEEE gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.errors import OperationError, ValueRangeError
from ndspark.functions import complexes as cx
from ndspark.functions import ieee


def _wide(a: Column, t: DType) -> Column:
    return a.cast("bigint") if t.bits < 64 else a.cast("decimal(38,0)")


def _int(r: Column, t: DType, wrap: bool) -> Column:
    if wrap:
        return dt.wrap(r, t)
    if t.kind == "u":
        fits = (r >= 0) & (r <= dt.literal(t.maximum, dt.UInt64))
        return F.when(fits, r).otherwise(F.raise_error(F.lit(f"{t} overflow"))).cast(t.spark)
    return r.cast(t.spark)


def add(a: Column, b: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    if t.is_complex:
        return cx.add(a, b), t
    return (_int(_wide(a, t) + _wide(b, t), t, wrap) if t.is_int else (a + b).cast(t.spark)), t


def sub(a: Column, b: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    if t.is_complex:
        return cx.sub(a, b), t
    return (_int(_wide(a, t) - _wide(b, t), t, wrap) if t.is_int else (a - b).cast(t.spark)), t


def mul(a: Column, b: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    if t.is_complex:
        return cx.mul(a, b), t
    if t.is_int and t.bits == 64 and wrap:
        # two halves of the right operand keep the product within 38 digits
        low = F.pmod(b.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)"))
        high = ((b.cast("decimal(38,0)") - low) / F.lit(1 << 32)).cast("decimal(38,0)")
        part = dt.wrap((a.cast("decimal(20,0)") * high.cast("decimal(12,0)")).cast("decimal(38,0)"), dt.UInt64)
        part = F.pmod(part.cast("decimal(38,0)"), F.lit(1 << 32).cast("decimal(38,0)")) * F.lit(1 << 32)
        return dt.wrap(part.cast("decimal(38,0)") + (a.cast("decimal(20,0)") * low.cast("decimal(12,0)")).cast("decimal(38,0)"), t), t
    return (_int(_wide(a, t) * _wide(b, t), t, wrap) if t.is_int else (a * b).cast(t.spark)), t


def _nonzero(b: Column) -> Column:
    return F.when(b != 0, b).otherwise(F.raise_error(F.lit("divided by 0")))


def div(a: Column, b: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    """Integers are cut toward zero."""
    if t.is_complex:
        return cx.div(a, b), t
    if t.is_float:
        return ieee.div(a, b).cast(t.spark), t
    if t == dt.UInt64:
        x, y = a.cast("decimal(38,0)"), _nonzero(b).cast("decimal(38,0)")
        return ((x - x % y) / y).cast(t.spark), t
    return _int(F.call_function("div", a.cast("bigint"), _nonzero(b).cast("bigint")), t, wrap), t


def mod(a: Column, b: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    """The sign of the dividend."""
    if t.is_float:
        return ieee.mod(a, b).cast(t.spark), t
    return (a % _nonzero(b)).cast(t.spark), t


def divmod_(a: Column, b: Column, t: DType) -> tuple[tuple[Column, Column], DType]:
    """Quotient (not floored for floats) and remainder."""
    return (div(a, b, t)[0], mod(a, b, t)[0]), t


def _int_power(a: Column, p: int, t: DType, wrap: bool) -> Column:
    out, base = None, a
    while p:
        if p & 1:
            out = base if out is None else mul(out, base, t, wrap)[0]
        p >>= 1
        if p:
            base = mul(base, base, t, wrap)[0]
    return F.lit(1).cast(t.spark) if out is None else out


def power(a: Column, p: Column | int | float, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    """a ** p. Small whole exponents are multiplied out; integers to a negative power are 0."""
    if isinstance(p, int) and not isinstance(p, bool):
        if t.is_int:
            return (F.lit(0).cast(t.spark) if p < 0 else _int_power(a, p, t, wrap)), t
        if t.is_complex:
            return cx.int_power(a, p, t), t
        if 0 <= p <= 3:
            return (_int_power(a, p, t, False) if p else F.lit(1.0).cast(t.spark)), t
    exponent = p if isinstance(p, Column) else F.lit(p)
    if t.is_int:
        exact = F.aggregate(F.array_repeat(_wide(a, t), F.greatest(exponent, F.lit(0)).cast("int")), _wide(F.lit(1), t), lambda x, y: (x * y).cast("bigint" if t.bits < 64 else "decimal(38,0)"))
        return F.when(exponent < 0, F.lit(0).cast(t.spark)).otherwise(_int(exact, t, wrap)), t
    if t.is_complex:
        raise OperationError("a complex base needs a whole exponent")
    return F.pow(a.cast("double"), exponent.cast("double")).cast(t.spark), t


def negate(a: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    if t.is_complex:
        return cx.negate(a), t
    return (_int(-_wide(a, t), t, wrap) if t.is_int else -a), t


def absolute(a: Column, t: DType) -> tuple[Column, DType]:
    """The smallest signed integer raises; of complex numbers a real."""
    if t.is_complex:
        return cx.absolute(a).cast(t.real.spark), t.real
    return (_int(F.abs(_wide(a, t)), t, False) if t.is_int else F.abs(a)), t


def square(a: Column, t: DType, wrap: bool = False) -> tuple[Column, DType]:
    return mul(a, a, t, wrap)


def reciprocal(a: Column, t: DType) -> tuple[Column, DType]:
    """Integers: 1 and -1 are their own, 0 raises, else 0."""
    if t.is_int:
        return F.when(a == 1, 1).when(a == -1, -1).when(a == 0, F.raise_error(F.lit("divided by 0")).cast("int")).otherwise(0).cast(t.spark), t
    return (cx.div(dt.literal(1, t), a) if t.is_complex else ieee.div(F.lit(1.0), a).cast(t.spark)), t


def sign(a: Column, t: DType) -> tuple[Column, DType]:
    if t.is_complex:
        size = cx.absolute(a)
        return cx.make(ieee.div(a["re"].cast("double"), size), ieee.div(a["im"].cast("double"), size), t), t
    return (F.when(a > 0, 1).when(a < 0, -1).otherwise(0) if t.is_int else ieee.sign(a)).cast(t.spark), t


def rounding(name: str, a: Column, t: DType) -> tuple[Column, DType]:
    """floor, ceil, round (halves away from zero), rint (halves to even), trunc; integers are left as they are."""
    f = {"floor": ieee.floor, "ceil": ieee.ceil, "round": ieee.round_away, "rint": F.rint, "trunc": ieee.trunc}[name]
    if t.is_complex:
        return cx.make(f(a["re"].cast("double")), f(a["im"].cast("double")), t), t
    return (a if t.is_int else f(a.cast("double")).cast(t.spark)), t


def modf(a: Column, t: DType) -> tuple[tuple[Column, Column], DType]:
    """Fraction and whole part, both with the sign of a."""
    whole = ieee.trunc(a.cast("double"))
    return (F.when(F.abs(a) == ieee.INF, ieee.copysign(F.lit(0.0), a)).otherwise(a - whole).cast(t.spark), whole.cast(t.spark)), t


def clip(a: Column, low: Column | None, high: Column | None, t: DType) -> tuple[Column, DType]:
    """NaN passes through."""
    if low is None and high is None:
        raise ValueRangeError("clip needs a minimum or a maximum")
    out = F.when(F.isnan(a), a) if t.is_float else F
    if low is not None:
        out = out.when(a < low, low)
    if high is not None:
        out = out.when(a > high, high)
    out = out.otherwise(a)
    if low is not None and high is not None:
        out = F.when(low > high, F.raise_error(F.lit("min > max")).cast(t.spark)).otherwise(out)
    return out.cast(t.spark), t


def poly(a: Column, coefficients: list[Column], t: DType) -> tuple[Column, DType]:
    """Sum of c[k] * a**k by Horner's rule; without coefficients a itself."""
    if not coefficients:
        return a, t
    return reduce(lambda acc, c: add(mul(acc, a, t)[0], c, t)[0], reversed(coefficients[:-1]), coefficients[-1]), t


# ---- bits ---------------------------------------------------------------------------------


def bitwise(name: str, a: Column, b: Column, t: DType) -> tuple[Column, DType]:
    if t.kind == "b":
        return {"and": a & b, "or": a | b, "xor": a != b}[name], t
    if not t.is_int or t == dt.UInt64:
        raise OperationError(f"no bit operations for {t}")
    return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[name](b).cast(t.spark), t


def bit_not(a: Column, t: DType) -> tuple[Column, DType]:
    if t.kind == "b":
        return ~a, t
    return dt.wrap(F.bitwise_not(a.cast("bigint")), t) if t.kind == "u" else F.bitwise_not(a), t


def shift(name: str, a: Column, n: Column, t: DType) -> tuple[Column, DType]:
    """Arithmetic for signed types; bits shifted out are lost."""
    f = F.call_function("shiftleft" if name == "left" else "shiftright", a.cast("bigint"), n.cast("int"))
    return (f.cast(t.spark) if t.bits == 64 else dt.wrap(f, t)), t


# ---- comparison ---------------------------------------------------------------------------


def compare(name: str, a: Column, b: Column, t: DType) -> tuple[Column, DType]:
    if t.is_complex:
        if name not in ("eq", "ne", "nearly_eq"):
            raise OperationError("complex numbers have no order")
        if name == "nearly_eq":
            gap, size = cx.absolute(cx.sub(a, b)), cx.absolute(a) + cx.absolute(b)
            return gap <= size * (2 * t.epsilon), dt.Bit
        same = ieee.eq(a["re"], b["re"]) & ieee.eq(a["im"], b["im"])
        return (same if name == "eq" else ~same), dt.Bit
    if name == "nearly_eq":
        if not t.is_float:
            return a == b, dt.Bit
        x, y = a.cast("double"), b.cast("double")
        return ieee.le(F.abs(x - y), (F.abs(x) + F.abs(y)) * (2 * t.epsilon)), dt.Bit
    if t.is_float:
        return getattr(ieee, name)(a, b), dt.Bit
    return {"eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[name], dt.Bit


def predicate(name: str, a: Column, t: DType) -> tuple[Column, DType]:
    """isnan, isinf, isposinf, isneginf, isfinite, signbit."""
    if t.is_complex:
        parts = [predicate(name, a[p], t.real)[0] for p in ("re", "im")]
        return (parts[0] & parts[1] if name == "isfinite" else parts[0] | parts[1]), dt.Bit
    if name == "signbit":
        return ieee.signbit(a.cast("double")) if t.is_float else a < 0, dt.Bit
    if not t.is_float:
        return F.lit(name == "isfinite"), dt.Bit
    inf = F.abs(a) == ieee.INF
    return {"isnan": F.isnan(a), "isinf": inf, "isposinf": a == ieee.INF, "isneginf": a == -ieee.INF, "isfinite": ~F.isnan(a) & ~inf}[name], dt.Bit


def extremum(name: str, a: Column, b: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    """maximum or minimum of two arrays."""
    if t.is_float:
        return getattr(ieee, name)(a, b, nan), t
    return (F.greatest(a, b) if name == "maximum" else F.least(a, b)), t
