"""Scans, sorts and differences, along an axis or over the whole array: in chunks of dense positions, or by rank."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ndspark import dtypes as dt
from ndspark.errors import OperationError, ShapeError
from ndspark.functions import complexes as cx
from ndspark.functions import elementwise as ew
from ndspark.plans.chunks import CHUNK, Products, neighbours, product_scan, scan
from ndspark.plans.order import dense_index

if TYPE_CHECKING:
    from ndspark.array import NDArray


class Scanning:
    """Mixin: operations along an order."""

    def _line(self: NDArray, axis: int | None) -> tuple[DataFrame, list[str], str, int]:
        """(rows, segment, position, length): i0 …, f and x; positions run along the axis of each segment, or over all elements."""
        names = [f"i{k}" for k in range(self.ndim)]
        rows = self.base.select(*[c.alias(n) for c, n in zip(self.indices, names)], self.flat().alias("f"), self.value.alias("x"))
        if axis is None or self.ndim == 1:
            return rows, [], "f", self.size
        axis = self._axis(axis)
        return rows, [n for k, n in enumerate(names) if k != axis], f"i{axis}", self.shape[axis]

    def _scan(self: NDArray, axis: int | None, nan: bool, aggregate, start: Column, join, chunk: int) -> NDArray:
        """Inclusive scan. With ``nan``, NaN counts as nothing, but the result is NaN up to the first number."""
        t = self.dtype
        skip = nan and t.is_float
        rows, segment, at, length = self._line(axis)
        x = F.when(~F.isnan("x"), F.col("x")) if skip else F.col("x")

        def value(total: Column, count: Column) -> Column:
            return (F.when(count > 0, total).otherwise(F.lit(float("nan"))) if skip else total).cast(t.spark)

        def before(earlier) -> Column:
            n = F.coalesce(F.sum("_total.n").over(earlier), F.lit(0))
            return F.struct(F.coalesce(aggregate(F.col("_total.s")).over(earlier), start).alias("s"), n.alias("n"))

        def carry(offset: Column, own: Column) -> Column:
            return value(join(F.coalesce(offset["s"], start), own["s"]), F.coalesce(offset["n"], F.lit(0)) + own["n"])

        total = F.struct(F.coalesce(aggregate(x), start).alias("s"), F.count(x).alias("n"))
        out = scan(rows, segment, at, length, _Pair(aggregate(x), F.count(x), start), total, before, carry, "v", chunk)
        return self._frame(out.select(*[f"i{k}" for k in range(self.ndim)], "v"), self.shape)

    def cumsum(self: NDArray, axis: int | None = None, nan: bool = False, chunk: int = CHUNK) -> NDArray:
        """Running sum along an axis, or over all elements in row-major order; the type is kept and checked."""
        t = self.dtype
        if t.is_complex:
            re, im = (x.cumsum(axis, nan, chunk) for x in (self.real(), self.imag()))
            return re._paired(im, lambda a, b, _: (cx.make(a, b), t), upcast=False)
        kind = "bigint" if t.is_int else "double"
        start = F.lit(0).cast(kind)
        return self._scan(axis, nan, lambda x: F.sum(x.cast(kind)), start, lambda a, b: a + b, chunk)

    def cumprod(self: NDArray, axis: int | None = None, nan: bool = False, wrap: bool = False, chunk: int = CHUNK) -> NDArray:
        """Running product; integers are exact, and raise beyond their type unless they may wrap."""
        t = self.dtype
        if t.is_float:
            return self._scan(axis, nan, lambda x: F.product(x.cast("double")), F.lit(1.0), lambda a, b: a * b, chunk)
        if t.kind == "b":
            raise OperationError("cumprod isn't defined for bits")
        rows, segment, at, length = self._line(axis)
        if t.is_complex:
            rows = rows.select(*segment, at, F.col("x.re").cast("double").alias("x"), F.col("x.im").cast("double").alias("y"))
        else:
            rows = rows.select(*segment, at, F.col("x").cast("bigint" if t != dt.UInt64 else t.spark).alias("x"))
        wide = "u" if t.kind == "u" else t.kind
        out = product_scan(rows, segment, at, length, Products(wide, 0 if t.is_complex else t.minimum, 0 if t.is_complex else t.maximum, wrap, nan and t.is_complex), chunk)
        if t.is_complex:
            value = cx.make(F.col("p"), F.col("q"), t)
        else:
            value = dt.wrap(F.col("p").cast("decimal(38,0)") if t.kind == "u" else F.col("p"), t) if t.kind == "u" or t.bits < 64 else F.col("p")
        if at != "f":
            return self._frame(out.select(*[f"i{k}" for k in range(self.ndim)], value.alias("v")), self.shape)
        return self._frame(out.select(*self._places(F.col("f")), value.alias("v")), self.shape)

    def _places(self: NDArray, flat: Column) -> list[Column]:
        """Indices i0 … of row-major positions."""
        places = []
        for k, stride in enumerate(self.strides):
            c = F.call_function("div", flat, F.lit(stride).cast("bigint")) if stride > 1 else flat
            places.append((c % F.lit(self.shape[k]) if k else c).cast("bigint").alias(f"i{k}"))
        return places

    def _ranked(self: NDArray, axis: int | None, by_value_only: bool, chunk: int) -> DataFrame:
        """Rows in sorted order: (i0 …, v, f) where the indices are the new places."""
        if not self.dtype.is_comparable:
            raise OperationError(f"{self.dtype} has no order")
        rows = self.base.select(*[c.alias(f"i{k}") for k, c in enumerate(self.indices)], self.value.alias("v"), self.flat().alias("f"))
        key = F.col("v")
        order = [key]
        if self.dtype.is_float:  # NaN last; -0.0 and 0.0 are equal to Spark
            order = [key, F.when((key == 0) & (F.pow(key.cast("double"), F.lit(-1.0)) < 0), 0).otherwise(1)] if by_value_only else [key]
        if axis is None or self.ndim == 1:
            ranked = dense_index(rows.select("v", "f"), [*order, F.col("f")], "r")
            return ranked.select(*self._places(F.col("r")), "v", "f")
        axis = self._axis(axis)
        rest = [f"i{k}" for k in range(self.ndim) if k != axis]
        if self.shape[axis] > chunk:
            # every segment has as many elements, so ranks within one are ranks in the whole modulo its size
            ranked = dense_index(rows, [*[F.col(c) for c in rest], *order, F.col("f")], "r")
            return ranked.withColumn(f"i{axis}", F.col("r") % F.lit(self.shape[axis])).drop("r")
        place = F.row_number().over(Window.partitionBy(*rest).orderBy(*order, "f")) - 1
        return rows.withColumn(f"i{axis}", place.cast("bigint"))

    def sort(self: NDArray, axis: int | None = None, chunk: int = CHUNK) -> NDArray:
        """Ascending, NaN last, -0.0 before 0.0; without an axis over all elements, shape kept. Axes longer than a chunk are sorted by range."""
        return self._frame(self._ranked(axis, True, chunk).drop("f"), self.shape)

    def sort_index(self: NDArray, axis: int | None = None, chunk: int = CHUNK) -> NDArray:
        """Row-major positions that sort the array; ties by position."""
        ranked = self._ranked(axis, False, chunk)
        return self._frame(ranked.drop("v").withColumnRenamed("f", "v"), self.shape, dt.Int64)

    def diff(self: NDArray, n: int = 1, axis: int = -1, chunk: int = CHUNK) -> NDArray:
        """n-th forward difference along an axis: binomial weights over a window of n + 1 rows, in chunks that overlap by n."""
        axis = self._axis(axis)
        length = self.shape[axis]
        if n < 0 or n >= length:
            raise ShapeError(f"difference {n} of an axis of size {length}")
        rest = [f"i{k}" for k in range(self.ndim) if k != axis]
        rows, w = neighbours(self.df, rest, f"i{axis}", length, n, chunk)
        value = self._weighted([F.lead("v", k).over(w) if k else F.col("v") for k in range(n + 1)], n)
        out = rows.select(*[f"i{k}" for k in range(self.ndim)], "_halo", value.alias("v")).where(~F.col("_halo") & (F.col(f"i{axis}") < length - n)).drop("_halo")
        return self._frame(out, [m - n if k == axis else m for k, m in enumerate(self.shape)])

    def _weighted(self: NDArray, parts: list[Column], n: int) -> Column:
        t, total = self.dtype, None
        for k, part in enumerate(parts):
            weight = (-1) ** (n - k) * math.comb(n, k)
            term = ew.mul(part, dt.literal(weight, t), t)[0] if t.kind != "u" else part.cast("decimal(38,0)") * F.lit(weight)
            total = term if total is None else (ew.add(total, term, t)[0] if t.kind != "u" else total + term)
        return dt.wrap(total, t) if t.kind == "u" else total

    def top(self: NDArray, k: int, largest: bool = True) -> NDArray:
        """The first k of the sorted elements, by a heap of k a partition."""
        order = F.col("v").desc() if largest else F.col("v").asc()
        rows = self.df.select("v").orderBy(order).limit(k)
        rows = rows.select(F.row_number().over(Window.orderBy(order)).cast("bigint").alias("n"), "v")
        return self._frame(rows.select((F.col("n") - 1).alias("i0"), "v"), [min(k, self.size)])


class _Pair:
    """Two aggregates over one window, as a struct (s, n)."""

    def __init__(self, total: Column, count: Column, start: Column):
        self.total, self.count, self.start = total, count, start

    def over(self, window) -> Column:
        return F.struct(F.coalesce(self.total.over(window), self.start).alias("s"), self.count.over(window).alias("n"))
