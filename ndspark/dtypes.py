"""Element types: Spark storage, limits, promotion and casts.

Promotion is asymmetric for the narrowest signed type on the left: it widens to hold an unsigned
right operand, every other mixed pair takes the signed type of the larger width. Catalyst's own
coercion differs, so every operation casts explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark.errors import CastError

MAX_DIMENSIONS = 12


@dataclass(frozen=True)
class DType:
    """One element type. ``kind``: b (bit), i, u, f, c (complex)."""

    name: str
    kind: str
    bits: int
    spark: str

    @cached_property
    def is_int(self) -> bool:
        return self.kind in "iu"

    @cached_property
    def is_float(self) -> bool:
        return self.kind == "f"

    @cached_property
    def is_complex(self) -> bool:
        return self.kind == "c"

    @cached_property
    def is_comparable(self) -> bool:
        return self.kind in "iuf"

    @property
    def byte_size(self) -> float:
        return self.bits / 8

    @property
    def minimum(self) -> int | float:
        return {"u": 0, "i": -(1 << (self.bits - 1))}.get(self.kind, -float.fromhex("0x1.fffffep127") if self.bits == 32 else -float.fromhex("0x1.fffffffffffffp1023"))

    @property
    def maximum(self) -> int | float:
        return -self.minimum if self.kind == "f" else (1 << (self.bits - (self.kind == "i"))) - 1

    @property
    def epsilon(self) -> float:
        """Distance from 1 to the next value."""
        return {32: 2.0**-23, 64: 2.0**-52}[self.bits // (2 if self.is_complex else 1)]

    @property
    def real(self) -> DType:
        """The type of a complex type's parts; a real type itself."""
        return {"SComplex": SFloat, "DComplex": DFloat}.get(self.name, self)

    @property
    def sum_type(self) -> DType:
        """The type that sums and products of this type have."""
        return Int64 if self.kind == "i" or self.kind == "b" else UInt64 if self.kind == "u" else self

    def __repr__(self) -> str:
        return self.name


Bit = DType("Bit", "b", 1, "boolean")
Int8, Int16, Int32, Int64 = (DType(f"Int{n}", "i", n, t) for n, t in ((8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint")))
UInt8, UInt16, UInt32, UInt64 = (DType(f"UInt{n}", "u", n, t) for n, t in ((8, "smallint"), (16, "int"), (32, "bigint"), (64, "decimal(20,0)")))
SFloat, DFloat = DType("SFloat", "f", 32, "float"), DType("DFloat", "f", 64, "double")
SComplex, DComplex = DType("SComplex", "c", 64, "struct<re: float, im: float>"), DType("DComplex", "c", 128, "struct<re: double, im: double>")

ALL = {t.name: t for t in (Bit, Int8, Int16, Int32, Int64, UInt8, UInt16, UInt32, UInt64, SFloat, DFloat, SComplex, DComplex)}
ALIASES = {"Float32": SFloat, "Float64": DFloat, "Complex32": SComplex, "Complex64": DComplex}
_SIGNED = {8: Int8, 16: Int16, 32: Int32, 64: Int64}


def of(name: str | DType) -> DType:
    """An element type by name or alias."""
    found = name if isinstance(name, DType) else ALL.get(name) or ALIASES.get(name)
    if found is None:
        raise CastError(f"unknown element type {name!r}")
    return found


def of_spark(kind: str) -> DType:
    """The element type that a Spark column of this type holds."""
    found = {"boolean": Bit, "tinyint": Int8, "smallint": Int16, "int": Int32, "bigint": Int64, "float": SFloat, "double": DFloat}.get(kind)
    if found is None and kind.replace(" ", "").startswith("struct<re:"):
        found = SComplex if "float" in kind else DComplex
    if found is None:
        raise CastError(f"no element type for a column of type {kind}")
    return found


def upcast(a: DType, b: DType) -> DType:
    """Type of an operation of ``a`` on the left and ``b`` on the right."""
    if a == b or b.kind == "b":
        return a
    if a.kind == "b":
        return b
    if a.is_complex or b.is_complex:
        return DComplex if any(t in (DComplex, DFloat) for t in (a, b)) else SComplex
    if a.is_float or b.is_float:
        return DFloat if DFloat in (a, b) else SFloat
    if a.kind == b.kind:
        return a if a.bits >= b.bits else b
    if a == Int8:
        return _SIGNED[min(64, 2 * b.bits)]
    return _SIGNED[max(a.bits, b.bits)]


def of_scalar(value: object) -> DType:
    if isinstance(value, bool) or value is None:
        return Bit
    if isinstance(value, int):
        return Int32 if -(1 << 31) <= value < 1 << 31 else Int64
    if isinstance(value, float):
        return DFloat
    if isinstance(value, complex):
        return DComplex
    raise CastError(f"no element type for {value!r}")


def upcast_scalar(a: DType, value: object) -> DType:
    """Type of an operation of an array of ``a`` with a literal: integers keep it, a float makes integers DFloat."""
    if isinstance(value, bool):
        return a
    if isinstance(value, int):
        return Int32 if a.kind == "b" else a
    if isinstance(value, float):
        return a if a.is_float or a.is_complex else DFloat
    if isinstance(value, complex):
        return SComplex if a in (SFloat, SComplex) else DComplex
    raise CastError(f"no element type for {value!r}")


def literal(value: object, t: DType) -> Column:
    """A literal of type ``t``."""
    if t.is_complex:
        z = complex(value)
        return F.struct(F.lit(z.real).cast(t.real.spark).alias("re"), F.lit(z.imag).cast(t.real.spark).alias("im"))
    if value is None:
        return F.lit(float("nan")).cast(t.spark) if t.is_float else F.lit(None).cast(t.spark)
    if t.kind == "b":
        return F.lit(bool(value))
    if t.is_int and isinstance(value, float):
        value = int(value)
    if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        value = Decimal(value)
    return F.lit(value).cast(t.spark)


def wrap(c: Column, t: DType) -> Column:
    """An integer expression of a wider type, reduced modulo 2**bits into ``t`` (two's complement)."""
    if not t.is_int:
        return c.cast(t.spark)
    span = 1 << t.bits
    if t.bits == 64:
        wide = c.cast("decimal(38,0)")
        whole, half = (F.lit(Decimal(x)).cast("decimal(38,0)") for x in (span, span // 2))
        low = F.pmod(wide, whole)
        return (F.when(low >= half, low - whole).otherwise(low) if t.kind == "i" else low).cast(t.spark)
    low = F.pmod(c, F.lit(span).cast("bigint"))
    return (F.when(low >= span // 2, low - span).otherwise(low) if t.kind == "i" else low).cast(t.spark)


def cast(c: Column, a: DType, b: DType) -> Column:
    """Converts an expression of type ``a`` to ``b``; integers wrap, floats truncate, numbers to bits are x != 0."""
    if a == b:
        return c
    if b.is_complex:
        part = b.real.spark
        re, im = (c["re"], c["im"]) if a.is_complex else (c.cast("int") if a.kind == "b" else c, F.lit(0))
        return F.struct(re.cast(part).alias("re"), im.cast(part).alias("im"))
    if a.is_complex:
        raise CastError(f"can't convert {a} to {b}")
    if b.kind == "b":
        return c != 0
    if a.kind == "b":
        return c.cast("int").cast(b.spark)
    if a.is_float and b.is_int:
        fits = F.abs(c) < float(1 << 63)
        whole = F.when(fits, F.when(c < 0, F.ceil(F.when(fits, c))).otherwise(F.floor(F.when(fits, c)))).otherwise(F.lit(-(1 << 63)))
        return whole if b == Int64 else wrap(whole, b)
    if a.is_int and b.is_int:
        fits = (b.minimum <= a.minimum) and (a.maximum <= b.maximum)
        return c.cast(b.spark) if fits else wrap(c, b)
    return c.cast(b.spark)
