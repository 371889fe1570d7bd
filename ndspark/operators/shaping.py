"""Shape manipulation: rewrites of the index expressions, no data moves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.errors import DimensionError, ShapeError

if TYPE_CHECKING:
    from ndspark.array import NDArray


class Shaping:
    """Mixin: views of the same rows."""

    def _axis(self: NDArray, axis: int) -> int:
        k = axis + self.ndim if axis < 0 else axis
        if not 0 <= k < self.ndim:
            raise DimensionError(f"axis {axis} of {self.ndim} dimensions")
        return k

    def _view(self: NDArray, indices, shape, why: object) -> NDArray:
        from ndspark.array import NDArray

        return NDArray(self.base, indices, self.value, shape, self.dtype, (self.tag, why))

    def view(self: NDArray) -> NDArray:
        return self

    def expand_dims(self: NDArray, axis: int) -> NDArray:
        axis = axis + self.ndim + 1 if axis < 0 else axis
        if not 0 <= axis <= self.ndim:
            raise DimensionError(f"axis {axis} of {self.ndim} dimensions")
        indices, shape = list(self.indices), list(self.shape)
        indices.insert(axis, F.lit(0).cast("bigint"))
        shape.insert(axis, 1)
        return self._view(indices, shape, ("expand", axis))

    def reverse(self: NDArray, *axes: int) -> NDArray:
        """Of all axes if none is given."""
        flipped = {self._axis(a) for a in axes} if axes else set(range(self.ndim))
        return self._view([F.lit(n - 1) - c if k in flipped else c for k, (c, n) in enumerate(zip(self.indices, self.shape))], self.shape, ("reverse", *sorted(flipped)))

    def fliplr(self: NDArray) -> NDArray:
        return self.reverse(1)

    def flipud(self: NDArray) -> NDArray:
        return self.reverse(0)

    def transpose(self: NDArray, *order: int) -> NDArray:
        """Axes reversed, or in the given order."""
        order = [self._axis(a) for a in order] if order else list(reversed(range(self.ndim)))
        if sorted(order) != list(range(self.ndim)):
            raise DimensionError(f"{order} is no order of {self.ndim} axes")
        out = self._view([self.indices[k] for k in order], [self.shape[k] for k in order], ("transpose", *order))
        if order == [1, 0]:  # rows of the source are columns now, and the other way round
            out.row_form, out.column_form = self.column_form, self.row_form
        return out

    def swapaxes(self: NDArray, a: int, b: int) -> NDArray:
        order = list(range(self.ndim))
        a, b = self._axis(a), self._axis(b)
        order[a], order[b] = order[b], order[a]
        return self.transpose(*order)

    def rot90(self: NDArray, k: int = 1, axes: tuple[int, int] = (0, 1)) -> NDArray:
        """Quarter turns from the first axis toward the second."""
        a, b = axes
        return [lambda: self, lambda: self.swapaxes(a, b).reverse(a), lambda: self.reverse(a, b), lambda: self.swapaxes(a, b).reverse(b)][k % 4]()

    def reshape(self: NDArray, *shape: int | None) -> NDArray:
        """Row-major; one size may be None."""
        shape = list(shape[0]) if len(shape) == 1 and isinstance(shape[0], (list, tuple)) else list(shape)
        if self.size == 0:
            raise ShapeError("an empty array can't be reshaped")
        if sum(n is None or n is True for n in shape) > 1:
            raise ShapeError("only one size may be left open")
        known = math.prod(n for n in shape if n is not None and n is not True)
        if known == 0 or self.size % known:
            raise ShapeError(f"{self.size} elements don't fit {shape}")
        shape = [self.size // known if n is None or n is True else n for n in shape]
        if math.prod(shape) != self.size:
            raise ShapeError(f"{self.size} elements don't fit {shape}")
        flat, indices = self.flat(), []
        for k, n in enumerate(shape):
            stride = math.prod(shape[k + 1 :])
            c = F.call_function("div", flat, F.lit(stride).cast("bigint")) if stride > 1 else flat
            indices.append(c % F.lit(n) if k else c)
        out = self._view(indices, shape, ("reshape", *shape))
        if self.ndim > 1 and shape[0] == self.shape[0] and len(shape) > 1:
            out.image_form = self.image_form or self.row_form
        return out

    def flatten(self: NDArray) -> NDArray:
        return self if self.ndim == 1 else self._view([self.flat()], [self.size], "flat")

    def diagonal(self: NDArray, offset: int = 0, axes: tuple[int, int] = (-2, -1)) -> NDArray:
        """The diagonal of two axes, as the last axis."""
        if self.ndim < 2:
            raise DimensionError("a diagonal needs two dimensions")
        a, b = (self._axis(x) for x in axes)
        from ndspark.array import NDArray

        start = max(0, -offset)
        n = max(0, min(self.shape[a] - start, self.shape[b] - max(0, offset)))
        if n == 0:
            raise ShapeError(f"offset {offset} is outside {list(self.shape)}")
        rest = [k for k in range(self.ndim) if k not in (a, b)]
        base = self.base.where(self.indices[b] == self.indices[a] + F.lit(offset))
        return NDArray(base, [*(self.indices[k] for k in rest), self.indices[a] - F.lit(start)], self.value, [*(self.shape[k] for k in rest), n], self.dtype)

    def trace(self: NDArray, offset: int = 0, axes: tuple[int, int] = (-2, -1), nan: bool = False) -> NDArray:
        return self.diagonal(offset, axes).sum(axis=-1, nan=nan)

    def _triangle(self: NDArray, keep) -> NDArray:
        if self.ndim < 2:
            raise DimensionError("a triangle needs two dimensions")
        return self._like(F.when(keep(self.indices[-2], self.indices[-1]), self.value).otherwise(dt.literal(0, self.dtype)), self.dtype)

    def triu(self: NDArray, k: int = 0) -> NDArray:
        """Elements on and above the k-th diagonal, else 0."""
        return self._triangle(lambda i, j: i + F.lit(k) <= j)

    def tril(self: NDArray, k: int = 0) -> NDArray:
        return self._triangle(lambda i, j: i + F.lit(k) >= j)

    def _positions(self: NDArray, keep) -> NDArray:
        i, j = self.indices[-2], self.indices[-1]
        rows, columns = self.shape[-2:]
        from ndspark.plans.order import dense_index

        found = dense_index(self.base.where(keep(i, j)).select((i * F.lit(columns) + j).alias("v")).distinct(), [F.col("v")]).select("i0", "v")
        return self._frame(found, [found.count()], dt.Int64)

    def triu_indices(self: NDArray, k: int = 0) -> NDArray:
        return self._positions(lambda i, j: i + F.lit(k) <= j)

    def tril_indices(self: NDArray, k: int = 0) -> NDArray:
        return self._positions(lambda i, j: i + F.lit(k) >= j)

    def diag_indices(self: NDArray, k: int = 0) -> NDArray:
        return self._positions(lambda i, j: i + F.lit(k) == j)

    def diag(self: NDArray, k: int = 0) -> NDArray:
        """A matrix with this vector on its k-th diagonal."""
        if self.ndim != 1:
            raise DimensionError("diag takes a vector")
        n = self.shape[0] + abs(k)
        grid = self.spark.range(n * n).select(F.expr(f"id div {n}").alias("i0"), F.expr(f"id % {n}").alias("i1"))
        mine = self.base.select((self.indices[0] + F.lit(max(0, -k))).alias("i0"), (self.indices[0] + F.lit(max(0, k))).alias("i1"), self.value.alias("v"))
        filled = grid.join(mine, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("v", dt.literal(0, self.dtype)).alias("v"))
        return self._frame(filled, [n, n])

    def split(self: NDArray, where: int | Sequence[int], axis: int = 0) -> list[NDArray]:
        """Sections: a number of them (the first ones are larger by one), or positions to cut at."""
        axis = self._axis(axis)
        n = self.shape[axis]
        if isinstance(where, int):
            each, more = divmod(n, where)
            cuts = [0]
            for i in range(where):
                cuts.append(cuts[-1] + each + (i < more))
        else:
            cuts = [0, *(min(x, n) for x in where), n]
        keys = [True] * self.ndim
        out = []
        for a, b in zip(cuts, cuts[1:]):
            keys[axis] = slice(a, b) if b > a else slice(0, 0)
            out.append(self._select(list(keys)))
        return out

    def vsplit(self: NDArray, where) -> list[NDArray]:
        return self.split(where, 0)

    def hsplit(self: NDArray, where) -> list[NDArray]:
        return self.split(where, 1)

    def dsplit(self: NDArray, where) -> list[NDArray]:
        return self.split(where, 2)
