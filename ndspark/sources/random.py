"""Random arrays: a function of (seed, position), so results don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray
from ndspark.errors import ValueRangeError
from ndspark.functions.complexes import make
from ndspark.sources.create import new


class Generator:
    """A seed and how many numbers were drawn; ``srand`` begins anew."""

    def __init__(self, seed: int = 0):
        self.srand(seed)

    def srand(self, seed: int) -> None:
        self.seed, self.offset = seed, 0

    def _uniform(self, i: Column, stream: int) -> Column:
        h = F.xxhash64(F.lit(self.seed).cast("bigint"), F.lit(stream), i + F.lit(self.offset))
        return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)

    def rand(self, spark: SparkSession, shape, low: object = None, high: object = None, dtype="DFloat") -> NDArray:
        """Uniform in [low, high); integers need a limit."""
        t = dt.of(dtype)
        if low is not None and high is None:
            low, high = None, low
        if t.is_int and high is None:
            raise ValueRangeError("integers need an upper limit")
        if t.is_complex:
            low, high = complex(low or 0), complex(1 + 1j if high is None else high)

            def value(i: Column) -> Column:
                return make(self._uniform(i, 0) * (high.real - low.real) + low.real, self._uniform(i, 1) * (high.imag - low.imag) + low.imag, t)
        else:
            low, high = low or 0, 1 if high is None else high
            if t.kind != "b" and not high > low:
                raise ValueRangeError("high must be above low")
            u = self._uniform

            def value(i: Column) -> Column:
                if t.kind == "b":
                    return u(i, 0) < 0.5
                if t.is_int:
                    return (F.floor(u(i, 0) * F.lit(float(high - low))) + F.lit(low)).cast(t.spark)
                return (u(i, 0) * F.lit(float(high - low)) + F.lit(float(low))).cast(t.spark)

        out = new(spark, shape, t, value)
        self.offset += out.size
        return out

    def rand_norm(self, spark: SparkSession, shape, mu: object = 0.0, sigma: float = 1.0, dtype="DFloat") -> NDArray:
        """Normal, by the polar form of two uniforms."""
        t = dt.of(dtype)
        if not (t.is_float or t.is_complex):
            raise ValueRangeError("normal numbers are floats")

        def pair(i: Column) -> tuple[Column, Column]:
            r = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - self._uniform(i, 2)))
            angle = F.lit(2 * math.pi) * self._uniform(i, 3)
            return r * F.cos(angle), r * F.sin(angle)

        def value(i: Column) -> Column:
            a, b = pair(i)
            m = complex(mu)
            if t.is_complex:
                return make(a * sigma + m.real, b * sigma + m.imag, t)
            return (a * F.lit(float(sigma)) + F.lit(m.real)).cast(t.spark)

        out = new(spark, shape, t, value)
        self.offset += out.size
        return out
