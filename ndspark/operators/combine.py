"""Combination of arrays: unions with shifted indices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.errors import ShapeError, ValueRangeError
from ndspark.operators.indexing import FEW, normal_index
from ndspark.plans.order import dense_index

if TYPE_CHECKING:
    from ndspark.array import NDArray


class Combining:
    """Mixin: concatenation, insertion and repetition."""

    @staticmethod
    def concatenate(arrays: Sequence[NDArray], axis: int = 0, dtype=None) -> NDArray:
        """Along an axis; other sizes must agree. The type is the common one unless given."""
        if not arrays:
            raise ValueRangeError("nothing to concatenate")
        first = arrays[0]
        axis = first._axis(axis)
        t = dt.of(dtype) if dtype else reduce(dt.upcast, [a.dtype for a in arrays])
        out, at = None, 0
        for a in arrays:
            if a.ndim != first.ndim or any(x != y for k, (x, y) in enumerate(zip(a.shape, first.shape)) if k != axis):
                raise ShapeError(f"can't concatenate {list(a.shape)} to {list(first.shape)} along axis {axis}")
            part = a.cast_to(t).df.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(at).cast("bigint"))
            out = part if out is None else out.unionByName(part)
            at += a.shape[axis]
        return first._frame(out, [at if k == axis else n for k, n in enumerate(first.shape)], t)

    @staticmethod
    def vstack(arrays: Sequence[NDArray]) -> NDArray:
        return Combining.concatenate([a.expand_dims(0) if a.ndim == 1 else a for a in arrays], 0)

    @staticmethod
    def hstack(arrays: Sequence[NDArray]) -> NDArray:
        return Combining.concatenate(arrays, 0 if all(a.ndim == 1 for a in arrays) else 1)

    @staticmethod
    def dstack(arrays: Sequence[NDArray]) -> NDArray:
        raised = [a.expand_dims(0).expand_dims(2) if a.ndim == 1 else a.expand_dims(2) if a.ndim == 2 else a for a in arrays]
        return Combining.concatenate(raised, 2)

    @staticmethod
    def column_stack(arrays: Sequence[NDArray]) -> NDArray:
        return Combining.concatenate([a.expand_dims(1) if a.ndim == 1 else a for a in arrays], 1)

    def append(self: NDArray, other: NDArray, axis: int | None = None) -> NDArray:
        """Flattened without an axis."""
        return self.concatenate([self.flatten(), other.flatten()]) if axis is None else self.concatenate([self, other], axis)

    def insert(self: NDArray, index: int | Sequence[int] | NDArray, values: NDArray | object, axis: int | None = None) -> NDArray:
        """Values before the given positions of the original array, in the order given at equal ones.

        Positions may be an array of integers, of any length: they stay distributed, and so do more than FEW of a list.
        """
        if axis is None and self.ndim != 1:
            return self.flatten().insert(index, values, 0)
        from ndspark.array import NDArray
        from ndspark.sources.create import array

        axis = self._axis(0 if axis is None else axis)
        n, single = self.shape[axis], isinstance(index, int)
        if isinstance(index, NDArray):
            if index.ndim != 1:
                raise ShapeError("positions are one-dimensional")
            count = index.shape[0]
        else:
            places = [normal_index(i, n + 1) for i in ([index] if single else index)]
            count = len(places)
        if not isinstance(values, NDArray):
            values = array(self.spark, values if isinstance(values, (list, tuple)) else [values])
            values = values if values.size > 1 else values.reshape(*[1] * self.ndim)
        if values.ndim < self.ndim:
            # a single place takes values that lack its axis; several take them along it
            kept = [k >= self.ndim - values.ndim for k in range(self.ndim)]
            if single:
                kept[self.ndim - values.ndim - 1], kept[axis] = True, False
            sizes = iter(values.shape)
            values = values.reshape(*[next(sizes) if k else 1 for k in kept])
        if count == 1 and not isinstance(index, NDArray):
            places = places * values.shape[axis]
            count = len(places)
        target = [count if k == axis else m for k, m in enumerate(self.shape)]
        full = self._grid(target)._paired(values.cast_to(self.dtype), lambda a, b, t: (b, self.dtype), upcast=False)
        name, shape = f"i{axis}", [m + count if k == axis else m for k, m in enumerate(self.shape)]
        if isinstance(index, NDArray) or count > FEW:
            index = index if isinstance(index, NDArray) else array(self.spark, places, "Int64")
            index = index.cast_to("Int64")._in_range(n + 1)
            # the j-th value goes to its place, behind those of smaller places and those given before it
            moved = dense_index(index.df.select(F.col("i0").alias("j"), F.col("v").alias("p")), [F.col("p"), F.col("j")], "r").select("j", (F.col("p") + F.col("r")).alias("p"))
            shift = index.bincount(minlength=n + 1).cumsum()[0:n]
            old = self.df.join(shift.df.select(F.col("i0").alias("j"), F.col("v").alias("s")), F.col(name) == F.col("j")).withColumn(name, F.col(name) + F.col("s")).drop("j", "s")
        else:
            order = sorted(range(count), key=lambda j: (places[j], j))
            moved = F.broadcast(self.spark.createDataFrame([(j, places[j] + r) for r, j in enumerate(order)], "j bigint, p bigint"))
            sorted_places = F.array(*[F.lit(p).cast("bigint") for p in sorted(places)])
            old = self.df.withColumn(name, F.col(name) + F.size(F.filter(sorted_places, lambda p: p <= F.col(name))))
        new = full.df.join(moved, F.col(name) == F.col("j")).withColumn(name, F.col("p")).drop("j", "p")
        return self._frame(old.unionByName(new), shape)

    def _in_range(self: NDArray, n: int) -> NDArray:
        """Positions from 0 to n - 1; negative ones count from the end, others raise."""
        at = F.when(self.value < 0, self.value + n).otherwise(self.value)
        return self._like(F.when(at.between(0, n - 1), at).otherwise(F.raise_error(F.lit(f"a position is out of range for an axis of size {n}")).cast("bigint")), self.dtype)

    def _grid(self: NDArray, shape: Sequence[int]) -> NDArray:
        from ndspark.sources.create import zeros

        return zeros(self.spark, shape, self.dtype)

    def tile(self: NDArray, *reps: int) -> NDArray:
        """Whole copies along each axis, new axes in front."""
        if any(r < 1 for r in reps):
            raise ValueRangeError("repetitions must be positive")
        n = max(self.ndim, len(reps))
        reps = (1,) * (n - len(reps)) + tuple(reps)
        shape = (1,) * (n - self.ndim) + self.shape
        rows = self.df.select(*[(F.col(f"i{k - n + self.ndim}") if k >= n - self.ndim else F.lit(0).cast("bigint")).alias(f"a{k}") for k in range(n)], "v")
        for k, r in enumerate(reps):
            copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r - 1).cast("bigint"))) if r > 1 else F.lit(0).cast("bigint")
            rows = rows.withColumn(f"c{k}", copies)
        out = rows.select(*[(F.col(f"a{k}") + F.col(f"c{k}") * F.lit(shape[k])).alias(f"i{k}") for k in range(n)], "v")
        return self._frame(out, [m * r for m, r in zip(shape, reps)])

    def repeat(self: NDArray, times: int | Sequence[int] | NDArray, axis: int | None = None) -> NDArray:
        """Each element ``times`` times in a row, or as often as the list or the array of integers says."""
        from ndspark.array import NDArray
        from ndspark.sources.create import array

        if axis is None and self.ndim != 1:
            return self.flatten().repeat(times, 0)
        axis = self._axis(0 if axis is None else axis)
        n, name = self.shape[axis], f"i{axis}"
        if isinstance(times, int):
            if times < 0:
                raise ValueRangeError("repetitions must not be negative")
            rows = self.df.where(F.lit(times > 0)).withColumn("c", _copies(F.lit(max(times, 1)).cast("bigint")))
            rows = rows.select(*[c for c in rows.columns if c != "c"], _each("c", F.lit(times).cast("bigint")).alias("c"))
            return self._frame(rows.withColumn(name, F.col(name) * F.lit(times) + F.col("c")).drop("c"), [m * times if k == axis else m for k, m in enumerate(self.shape)])
        if not isinstance(times, NDArray):
            if len(times) != n or any(t < 0 for t in times):
                raise ValueRangeError(f"{n} repetitions, not negative, are needed")
            times = array(self.spark, list(times), "Int64")
        times = times.cast_to("Int64")
        if times.shape != (n,):
            raise ValueRangeError(f"{n} repetitions, not negative, are needed")
        least, total = times.base.agg(F.min(times.value), F.sum(times.value)).first()
        if least is not None and least < 0:
            raise ValueRangeError(f"{n} repetitions, not negative, are needed")
        ends = times.cumsum().df.select(F.col("i0").alias("j"), F.col("v").alias("end"))
        plan = times.df.select(F.col("i0").alias("j"), F.col("v").alias("t")).where("t > 0").join(ends, "j")
        rows = self.df.join(plan, F.col(name) == F.col("j")).withColumn("c", _copies(F.col("t")))
        rows = rows.select(*self.df.columns, "t", "end", _each("c", F.col("t")).alias("c"))
        return self._frame(rows.withColumn(name, F.col("end") - F.col("t") + F.col("c")).select(*self.df.columns), [total if k == axis else m for k, m in enumerate(self.shape)])


#: Copies that are made of an element at a time.
SPAN = 1 << 16


def _copies(times: Column) -> Column:
    """Numbers of the spans that ``times`` copies take, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", times - 1, F.lit(SPAN).cast("bigint"))))


def _each(span: str, times: Column) -> Column:
    """Numbers of the copies in a span, a row each."""
    first = F.col(span) * SPAN
    return F.explode(F.sequence(first, F.least(first + SPAN, times) - 1))
