"""Reductions over axes: a grouping by the axes that are kept, with partial aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.errors import OperationError, ShapeError, ValueRangeError
from ndspark.functions import aggregates as ag
from ndspark.functions.exact import exact_sum
from ndspark.operators.tiles import product_extremes
from ndspark.plans.ranks import DIRECT, at_ranks

if TYPE_CHECKING:
    from ndspark.array import NDArray

#: Factors of a product that are gathered and multiplied at a time.
PART = 4096


class Reducing:
    """Mixin: axis reductions; ``axis`` is an int, a list, a range or None for all."""

    def _axes(self: NDArray, axis: int | Sequence[int] | None) -> list[int]:
        if axis is None:
            return list(range(self.ndim))
        return sorted({self._axis(a) for a in ([axis] if isinstance(axis, int) else axis)})

    def _outcome(self: NDArray, axes: list[int], keepdims: bool) -> tuple[list[int], list[int]]:
        kept = [k for k in range(self.ndim) if k not in axes]
        return kept, [n if k in kept else 1 for k, n in enumerate(self.shape)] if keepdims else [self.shape[k] for k in kept]

    def _grouped(self: NDArray, axes: list[int], kept: list[int], aggregate: list[Column]) -> DataFrame:
        if not self.size:
            raise ShapeError("an empty array can't be reduced")
        keys = [self.indices[k].alias(f"k{k}") for k in kept]
        return self.base.groupBy(*keys).agg(*aggregate) if keys else self.base.agg(*aggregate)

    def _placed(self: NDArray, df: DataFrame, kept: list[int], keepdims: bool, shape: list[int], dtype: DType, value: str = "v") -> NDArray:
        names = [F.col(f"k{k}") if k in kept else F.lit(0).cast("bigint") for k in range(self.ndim)] if keepdims else [F.col(f"k{k}") for k in kept]
        return self._frame(df.select(*[c.alias(f"i{j}") for j, c in enumerate(names)], F.col(value).alias("v")), shape, dtype)

    def _reduce(self: NDArray, f, axis, keepdims: bool) -> NDArray:
        axes = self._axes(axis)
        kept, shape = self._outcome(axes, keepdims)
        value, out = f(self.value, self.dtype)
        return self._placed(self._grouped(axes, kept, [value.alias("v")]), kept, keepdims, shape, out)

    def sum(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.sum_(v, t, nan), axis, keepdims)

    def mean(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.mean(v, t, nan), axis, keepdims)

    def var(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.var(v, t, nan), axis, keepdims)

    def stddev(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.stddev(v, t, nan), axis, keepdims)

    def rms(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.rms(v, t, nan), axis, keepdims)

    def min(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._product_extreme("min", axis, keepdims, nan) or self._reduce(lambda v, t: ag.min_(v, t, nan), axis, keepdims)

    def max(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._product_extreme("max", axis, keepdims, nan) or self._reduce(lambda v, t: ag.max_(v, t, nan), axis, keepdims)

    def _product_extreme(self: NDArray, which: str, axis, keepdims: bool, nan: bool) -> NDArray | None:
        """Extremes along one axis of a matrix product that isn't made for it; None for other arrays and axes."""
        axes = self._axes(axis)
        if self.factors is None or len(axes) != 1:
            return None
        a, b, alpha = self.factors
        left, right = (a, b.transpose()) if axes == [1] else (b.transpose(), a)
        kept, shape = self._outcome(axes, keepdims)
        return self._placed(product_extremes(left, right, which, nan, alpha).withColumnRenamed("i0", f"k{kept[0]}"), kept, keepdims, shape, self.dtype)

    def ptp(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._reduce(lambda v, t: ag.ptp(v, t, nan), axis, keepdims)

    def minmax(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> tuple[NDArray, NDArray]:
        """Both extremes in one pass."""
        axes = self._axes(axis)
        kept, shape = self._outcome(axes, keepdims)
        df = self._grouped(axes, kept, [ag.min_(self.value, self.dtype, nan)[0].alias("lo"), ag.max_(self.value, self.dtype, nan)[0].alias("hi")])
        return self._placed(df, kept, keepdims, shape, self.dtype, "lo"), self._placed(df, kept, keepdims, shape, self.dtype, "hi")

    def _index_of(self: NDArray, which: str, axis, keepdims: bool, nan: bool, along: bool) -> NDArray:
        axes = self._axes(axis)
        index = self.indices[axes[0]] if along and axis is not None and len(axes) == 1 else self.flat()
        return self._reduce(lambda v, t: ag.index_of(which, v, index, t, nan), axis, keepdims)

    def max_index(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        """Row-major position in the whole array of the largest element."""
        return self._index_of("max", axis, keepdims, nan, False)

    def min_index(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._index_of("min", axis, keepdims, nan, False)

    def argmax(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        """Position along the axis of the largest element."""
        return self._index_of("max", axis, keepdims, nan, True)

    def argmin(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        return self._index_of("min", axis, keepdims, nan, True)

    def _ranked_rows(self: NDArray, axis, drop_nan: bool) -> tuple[DataFrame, list[int], int, int]:
        """(rows with kept axes k… and v, kept axes, elements of a group, groups)."""
        if not self.size:
            raise ShapeError("an empty array can't be reduced")
        kept = [k for k in range(self.ndim) if k not in self._axes(axis)]
        rows = self.base.select(*[self.indices[k].alias(f"k{k}") for k in kept], self.value.alias("v"))
        groups = math.prod(self.shape[k] for k in kept)
        return rows.where(~F.isnan("v")) if drop_nan else rows, kept, self.size // groups, groups

    def median(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False, direct: int = DIRECT) -> NDArray:
        """NaN is dropped; the middle two of an even number are averaged, in integer division for integers.

        Groups of more than ``direct`` elements, and all integers, go by rank; smaller groups of floats by a percentile in one task.
        """
        t = self.dtype
        rows, kept, most, groups = self._ranked_rows(axis, t.is_float)
        if not t.is_comparable or t.is_float and most <= direct:
            return self._reduce(ag.median, axis, keepdims)
        n = F.col("n")
        middle = {"a": F.call_function("div", n - 1, F.lit(2).cast("bigint")), "b": F.call_function("div", n, F.lit(2).cast("bigint"))}
        found = at_ranks(rows, [f"k{k}" for k in kept], middle, most, groups, direct)
        if t.is_float:
            value = F.coalesce((F.col("a").cast("double") + F.col("b").cast("double")) / 2, F.lit(float("nan")))
            if kept:  # groups of NaN only
                every = self.base.groupBy(*[self.indices[k].alias(f"k{k}") for k in kept]).agg(F.first(F.lit(1)).alias("one"))
                found = every.join(found, [f"k{k}" for k in kept], "left")
        else:
            value = F.call_function("div", F.col("a").cast("decimal(21,0)") + F.col("b").cast("decimal(21,0)"), F.lit(2).cast("decimal(1,0)"))
            if t == dt.UInt64:  # the quotient of decimals is a bigint
                value = F.floor((F.col("a").cast("decimal(21,0)") + F.col("b").cast("decimal(21,0)")) / 2)
        _, shape = self._outcome(self._axes(axis), keepdims)
        return self._placed(found.withColumn("v", value.cast(t.spark)), kept, keepdims, shape, t)

    def percentile(self: NDArray, q: float, axis=None, keepdims: bool = False, direct: int = DIRECT) -> NDArray:
        """Linear interpolation at rank q / 100 * (n - 1), NaN counts as the largest; groups of more than ``direct`` elements by rank."""
        if not 0 <= q <= 100:
            raise ValueRangeError("q must be between 0 and 100")
        t = self.dtype
        rows, kept, most, groups = self._ranked_rows(axis, False)
        if not (t.is_int or t.is_float) or most <= direct:
            return self._reduce(lambda v, t: ag.percentile(v, q, t), axis, keepdims)
        out = dt.DFloat if t.is_int else t
        rank = q / 100 * (most - 1)
        ends = {"a": F.lit(math.floor(rank)).cast("bigint"), "b": F.lit(math.ceil(rank)).cast("bigint")}
        found = at_ranks(rows, [f"k{k}" for k in kept], ends, most, groups, direct)
        part = rank - math.floor(rank)
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        value = a * (1 - part) + b * part if part else a
        _, shape = self._outcome(self._axes(axis), keepdims)
        return self._placed(found.withColumn("v", value.cast(out.spark)), kept, keepdims, shape, out)

    def prod(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        """Integers widen and are checked exactly: products of parts, then the product of those."""
        axes = self._axes(axis)
        kept, shape = self._outcome(axes, keepdims)
        t = self.dtype
        if t.is_complex or t.is_int or t.kind == "b":
            out = t.sum_type
            one = dt.literal(1, out)

            def product(values: Column) -> Column:
                from ndspark.functions.elementwise import mul

                return F.aggregate(values, one, lambda x, y: mul(x, y, out)[0].cast(out.spark))

            if not self.size:
                raise ShapeError("an empty array can't be reduced")
            # neighbours are multiplied, then neighbours of those, so that no task gathers more than PART factors
            place, size = F.lit(0).cast("bigint"), 1
            for k in reversed(axes):
                place, size = place + self.indices[k] * F.lit(size), size * self.shape[k]
            names = [f"k{k}" for k in kept]
            rows = self.base.select(*[self.indices[k].alias(f"k{k}") for k in kept], place.cast("bigint").alias("place"), dt.cast(self.value, t, out).alias("v"))
            while True:
                rows = rows.groupBy(*names, F.call_function("div", F.col("place"), F.lit(PART).cast("bigint")).alias("place")).agg(product(F.collect_list("v")).alias("v"))
                size = -(-size // PART)
                if size == 1:
                    return self._placed(rows, kept, keepdims, shape, out)
        value = F.when(~F.isnan(self.value), self.value) if nan else self.value
        df = self._grouped(axes, kept, [F.coalesce(F.product(value), F.lit(1.0)).cast(t.spark).alias("v")])
        return self._placed(df, kept, keepdims, shape, t)

    def kahan_sum(self: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        """The exact sum, rounded once: whole-number limbs are summed, in any order."""
        if self.dtype not in (dt.DFloat, dt.DComplex):
            raise OperationError("kahan_sum is defined for double precision")
        if self.dtype.is_complex:
            re, im = (x.kahan_sum(axis, keepdims, nan) for x in (self.real(), self.imag()))
            return re._paired(im, lambda a, b, t: (F.struct(a.alias("re"), b.alias("im")), dt.DComplex), upcast=False)
        axes = self._axes(axis)
        kept, shape = self._outcome(axes, keepdims)
        names = [f"k{k}" for k in kept]
        if not self.size:
            raise ShapeError("an empty array can't be reduced")
        rows = self.base.select(*[self.indices[k].alias(f"k{k}") for k in kept], self.value.alias("v"))
        if nan:
            rows = rows.withColumn("v", F.when(F.isnan("v"), F.lit(0.0)).otherwise(F.col("v")))
        return self._placed(exact_sum(rows, names, "v", "v", self.size), kept, keepdims, shape, self.dtype)

    def mulsum(self: NDArray, other: NDArray, axis=None, keepdims: bool = False, nan: bool = False) -> NDArray:
        """Sum of products; with ``nan`` a pair with a NaN is dropped."""
        product = self.mul(other)
        if product.dtype.is_int:
            out = product.dtype
            total = product._reduce(lambda v, t: (F.sum(v).cast(out.spark), out), axis, keepdims)
            return total
        return product.sum(axis, keepdims, nan)

    def count_true(self: NDArray, axis=None, keepdims: bool = False) -> NDArray:
        """0 for an empty array."""
        return self._bits(lambda v, t: ag.count_true(v), axis, keepdims)

    def count_false(self: NDArray, axis=None, keepdims: bool = False) -> NDArray:
        return self._bits(lambda v, t: ag.count_false(v), axis, keepdims)

    count = count_1 = count_true
    count_0 = count_false

    def all(self: NDArray, axis=None, keepdims: bool = False) -> NDArray:
        """False for an empty array."""
        return self._bits(lambda v, t: ag.all_(v), axis, keepdims)

    def any(self: NDArray, axis=None, keepdims: bool = False) -> NDArray:
        return self._bits(lambda v, t: ag.any_(v), axis, keepdims)

    def none(self: NDArray, axis=None, keepdims: bool = False) -> NDArray:
        return self._bits(lambda v, t: ag.none_(v), axis, keepdims)

    def _bits(self: NDArray, f, axis, keepdims: bool) -> NDArray:
        if self.dtype != dt.Bit:
            raise OperationError(f"only bits are counted, not {self.dtype}")
        if not self.size and axis is None:
            value, out = f(self.value, self.dtype)
            return self._frame(self.base.agg(value.alias("v")), [], out)
        return self._reduce(f, axis, keepdims)

    def bincount(self: NDArray, weights: NDArray | None = None, minlength: int = 0) -> NDArray:
        """Counts (or sums of weights) of each value along the last axis; as long as the largest value + 1."""
        if not self.dtype.is_int:
            raise OperationError("bincount counts integers")
        if weights is not None and weights.shape != self.shape:
            raise ShapeError(f"weights of shape {list(weights.shape)} for {list(self.shape)}")
        least, most = self.base.agg(F.min(self.value), F.max(self.value)).first()
        if least is not None and least < 0:
            raise ValueRangeError("negative value")
        n = max(minlength, 0 if most is None else int(most) + 1)
        rest = self.ndim - 1
        pair = self if weights is None else self._paired(weights, lambda a, b, t: (F.struct(a.alias("x"), b.alias("w")), t), upcast=False)
        value = pair.value if weights is None else pair.value["x"]
        keys = [pair.indices[k].alias(f"i{k}") for k in range(rest)]
        weigh = F.count(F.lit(1)) if weights is None else F.sum(pair.value["w"].cast("double"))
        counts = pair.base.groupBy(*keys, value.cast("bigint").alias(f"i{rest}")).agg(weigh.alias("v"))
        grid = self.spark.range(n).select(F.col("id").alias(f"i{rest}"))
        for k in reversed(range(rest)):
            grid = self.spark.range(self.shape[k]).select(F.col("id").alias(f"i{k}")).crossJoin(grid)
        names = [f"i{k}" for k in range(rest + 1)]
        out = dt.Int64 if weights is None else weights.dtype if weights.dtype.is_float else dt.DFloat
        return self._frame(grid.join(counts, names, "left").select(*names, F.coalesce("v", F.lit(0)).cast(out.spark).alias("v")), [*self.shape[:-1], n], out)
