"""Linear algebra: packed tiles joined on the common axis, or blocks of rows against a small broadcast matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.errors import OperationError, ShapeError, ValueRangeError
from ndspark.functions import elementwise as ew
from ndspark.operators.tiles import BAND_WIDTH, SIDE, Tiles
from ndspark.plans.order import durable

if TYPE_CHECKING:
    from ndspark.array import NDArray

#: A right matrix of at most this many elements is sent to the executors and multiplied there in blocks.
BROADCAST_ELEMENTS = 1_000_000
#: Variables whose covariances are gathered in one pass; a task holds a square of them.
WIDE = 1024


class Linear:
    """Mixin: products."""

    def dot(self: NDArray, other: NDArray) -> NDArray:
        """Scalars multiply, vectors give a sum of products, matrices the matrix product."""
        if not self.ndim or not other.ndim:
            return self.mul(other)
        if self.ndim == 1 and other.ndim == 1:
            if self.shape != other.shape:
                raise ShapeError(f"{list(self.shape)} and {list(other.shape)} have no product")
            return self.mulsum(other)
        if self.ndim == 1:
            return self.expand_dims(0).gemm(other)._squeeze(-2)
        if other.ndim == 1:
            return self.gemm(other.expand_dims(1))._squeeze(-1)
        return self.gemm(other)

    def _squeeze(self: NDArray, axis: int) -> NDArray:
        axis = self._axis(axis)
        return self._view([c for k, c in enumerate(self.indices) if k != axis], [n for k, n in enumerate(self.shape) if k != axis], ("squeeze", axis))

    def gemm(self: NDArray, other: NDArray, c: NDArray | None = None, alpha: object = 1, beta: object = 0, side: int = SIDE) -> NDArray:
        """alpha * self · other + beta * c; leading axes are batches, equal or 1.

        A small right matrix of floats is broadcast; everything else is multiplied as tiles of ``side`` rows and columns.
        """
        if self.ndim < 2 or other.ndim < 2 or not self.size or not other.size:
            raise ShapeError("gemm needs matrices that aren't empty")
        if self.shape[-1] != other.shape[-2]:
            raise ShapeError(f"{list(self.shape)} and {list(other.shape)} have no product")
        n = max(self.ndim, other.ndim) - 2
        a_batch, b_batch = (1,) * (n - self.ndim + 2) + self.shape[:-2], (1,) * (n - other.ndim + 2) + other.shape[:-2]
        if any(x != y and 1 not in (x, y) for x, y in zip(a_batch, b_batch)):
            raise ShapeError(f"batches {list(a_batch)} and {list(b_batch)} don't fit")
        t = dt.upcast(self.dtype, other.dtype)
        shape = (*(max(x, y) for x, y in zip(a_batch, b_batch)), self.shape[-2], other.shape[-1])
        if n == 0 and t.is_float and math.prod(other.shape) <= BROADCAST_ELEMENTS and not hasattr(other, "tiled"):
            out = self._gemm_blocks(other, t)
        else:
            left, right = (Tiles.of(x.cast_to(t)._with_axes(n + 2), side) for x in (self, other))
            # factors and an addend of the result's type go with the tiles
            fused = all(dt.upcast_scalar(t, x) == t for x in (alpha, beta)) and (c is None or not beta or c.shape == shape and dt.upcast(t, c.dtype) == t)
            if fused:
                added = Tiles.of(c.cast_to(t), side) if c is not None and beta else None
                out = left.multiply(right, alpha, added, beta).array()
                if n == 0 and t.is_float and added is None and self.shape[-1] <= BAND_WIDTH:
                    out.factors = self.cast_to(t), other.cast_to(t), alpha
                return out
            out = left.multiply(right).array()
        if alpha != 1:
            out = out.mul(alpha)
        return out if c is None or beta == 0 else out.add(c.mul(beta))

    def _with_axes(self: NDArray, n: int) -> NDArray:
        """With axes of size 1 in front, to n axes."""
        out = self
        while out.ndim < n:
            out = out.expand_dims(0)
        return out

    def _row_arrays(self: NDArray) -> DataFrame:
        """(i0, r): rows as arrays; as they lie in the source where that holds rows, else gathered by row."""
        if self.row_form:
            source, index, values = self.row_form
            return source.select(index.alias("i0"), F.transform(values, lambda x: x.cast("double")).alias("r"))
        pairs = F.array_sort(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v"))))
        return self.df.groupBy("i0").agg(pairs.alias("r")).select("i0", F.col("r.v").alias("r"))

    def _gemm_blocks(self: NDArray, other: NDArray, t) -> NDArray:
        """Rows of self, gathered by row (their length is the common axis), times the whole of a small right matrix."""
        k, m = other.shape
        matrix = np.zeros((k, m))
        cells = other.cast_to(t).df.select("i0", "i1", F.col("v").cast("double").alias("v")).toArrow()
        matrix[cells["i0"].to_numpy(), cells["i1"].to_numpy()] = cells["v"].to_numpy()
        shared = self.spark.sparkContext.broadcast(matrix)
        rows = self.cast_to(t)._row_arrays()

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"i0": batch["i0"], "r": list(np.stack(batch["r"].to_numpy()) @ shared.value)})

        out = rows.mapInPandas(multiply, "i0 bigint, r array<double>").select("i0", F.posexplode("r").alias("i1", "v"))
        return self._frame(out.select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("v").cast(t.spark).alias("v")), [self.shape[0], m], t)

    def gram(self: NDArray) -> NDArray:
        """transpose(self) · self of a tall real matrix: each batch of rows adds a small square, which are summed.

        The shuffle holds one square a batch whatever the number of rows; the number of columns squared
        must fit a task.
        """
        if self.ndim != 2 or not self.dtype.is_float:
            raise OperationError("gram is defined for real matrices")
        m = self.shape[1]
        rows = self._row_arrays().select("r")

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((m, m))
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["r"].to_numpy())
                    total += x.T @ x
            yield pd.DataFrame({"i0": np.repeat(np.arange(m), m), "i1": np.tile(np.arange(m), m), "v": total.ravel()})

        out = rows.mapInPandas(partial, "i0 bigint, i1 bigint, v double").groupBy("i0", "i1").agg(F.sum("v").cast(self.dtype.spark).alias("v"))
        return self._frame(out, [m, m])

    def inner(self: NDArray, other: NDArray, axis: int = -1) -> NDArray:
        return self.mulsum(other, axis=axis)

    def outer(self: NDArray, other: NDArray, axis: int | None = None) -> NDArray:
        """Of the last axes, or of the given one; other axes are kept."""
        if axis is not None:
            low, high = sorted((self.ndim, other.ndim))
            k = axis - high if axis >= 0 else axis
            if not -low <= k < 0:
                raise ValueRangeError(f"axis {axis} is out of range")
            return self.expand_dims(k + self.ndim + 1).mul(other.expand_dims(k + other.ndim))
        return self.expand_dims(-1).mul(other.expand_dims(-2 if other.ndim > 1 else 0))

    def kron(self: NDArray, other: NDArray) -> NDArray:
        """Kronecker product; missing axes are put in front."""
        n = max(self.ndim, other.ndim)
        a, b = self.reshape(*((1,) * (n - self.ndim) + self.shape)), other.reshape(*((1,) * (n - other.ndim) + other.shape))
        t = dt.upcast(a.dtype, b.dtype)
        left = a.cast_to(t).df.withColumnsRenamed({f"i{k}": f"a{k}" for k in range(n)} | {"v": "x"})
        right = b.cast_to(t).df.withColumnsRenamed({f"i{k}": f"b{k}" for k in range(n)} | {"v": "y"})
        out = left.crossJoin(right).select(*[(F.col(f"a{k}") * F.lit(b.shape[k]) + F.col(f"b{k}")).alias(f"i{k}") for k in range(n)], ew.mul(F.col("x"), F.col("y"), t)[0].alias("v"))
        return self._frame(out, [x * y for x, y in zip(a.shape, b.shape)], t)

    def cov(self: NDArray, other: NDArray | None = None, ddof: int = 1, fweights: NDArray | Sequence[int] | None = None, aweights: NDArray | Sequence[float] | None = None) -> NDArray:
        """Covariance of the rows (variables) over the columns (observations); of one vector a scalar.

        Weights are arrays [observations] (or lists). Real matrices of at most ``WIDE`` variables take one pass: each task
        gathers weight, means and scatter of its observations, which merge pairwise by group. Others are centred and multiplied as tiles.
        """
        from ndspark.array import NDArray
        from ndspark.operators.combine import Combining
        from ndspark.sources.create import array

        m = self if self.ndim == 2 else self.expand_dims(0)
        if other is not None:
            m = Combining.concatenate([m, other if other.ndim == 2 else other.expand_dims(0)], 0)
        m = m.cast_to(dt.DFloat) if m.dtype.is_int else m
        p, n = m.shape
        weights = []
        for w in (fweights, aweights):
            if w is not None and not isinstance(w, NDArray):
                w = array(self.spark, list(w))
            if w is not None and w.shape != (n,):
                raise ShapeError(f"{list(w.shape)} weights for {n} observations")
            weights.append(None if w is None else w.cast_to(dt.DFloat))
        out = m._cov_merged(ddof, *weights) if m.dtype.is_float and p <= WIDE else m._cov_tiles(ddof, *weights)
        return out._squeeze(0)._squeeze(0) if self.ndim == 1 and other is None else out

    def _cov_merged(self: NDArray, ddof: int, fweights: NDArray | None, aweights: NDArray | None) -> NDArray:
        p, t = self.shape[0], self.dtype
        rows = self.transpose()._row_arrays() if p > 1 else self.base.select(self.indices[1].alias("i0"), F.array(self.value.cast("double")).alias("r"))
        for name, w in (("f", fweights), ("a", aweights)):
            rows = rows.withColumn(name, F.lit(1.0)) if w is None else rows.join(w.df.select("i0", F.col("v").alias(name)), "i0")
        state = "w double, wa double, mean binary, scatter binary"

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _Moments(p)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("r").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                    total.take(x, *(batch.column(c).to_numpy() for c in ("f", "a")))
            yield total.row()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _Moments(p)
            for batch in batches:
                for r in batch.to_pylist():
                    total.merge(_Moments(p, r))
            yield total.row()

        # one row a task; these meet in a square root of their number of tasks first, then in one
        parts = rows.select("r", "f", "a").mapInArrow(gather, state)
        few = max(1, math.isqrt(int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        whole = parts.repartition(few).mapInArrow(merge, state).coalesce(1).mapInArrow(merge, state)

        reliability = aweights is not None

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    factor = r["w"] - ddof * (r["wa"] / r["w"] if reliability and r["w"] else 1)
                    if factor <= 0:
                        raise ArithmeticError("no degrees of freedom left")
                    v = np.frombuffer(r["scatter"]) / factor
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(p), p)), pa.array(np.tile(np.arange(p), p)), pa.array(v)], ["i0", "i1", "v"])

        if fweights is None and aweights is None and self.shape[1] - ddof <= 0:
            raise OperationError("no degrees of freedom left")
        out = whole.mapInArrow(finish, "i0 bigint, i1 bigint, v double")
        return self._frame(out.select("i0", "i1", F.col("v").cast(t.spark).alias("v")), [p, p])

    def _cov_tiles(self: NDArray, ddof: int, fweights: NDArray | None, aweights: NDArray | None) -> NDArray:
        n = self.shape[1]
        weights = fweights if aweights is None else aweights if fweights is None else fweights.mul(aweights)
        total = float(n) if weights is None else float(weights.sum().item())
        squares = 1.0 if aweights is None else float(weights.mul(aweights).sum().item()) / total
        factor = total - ddof * squares
        if factor <= 0:
            raise OperationError("no degrees of freedom left")
        if weights is None:
            centred = self.sub(self.mean(axis=1, keepdims=True))
            return centred.gemm(centred.transpose().conj()).div(factor)
        row = weights.expand_dims(0)
        mean = self.mul(row).sum(axis=1, keepdims=True).div(total)
        centred = self.sub(mean)
        centred = centred._frame(durable(centred.df), centred.shape)
        return centred.mul(row).gemm(centred.transpose().conj()).div(factor)


class _Moments:
    """Weight, means and scatter matrix of observations; two of them merge by the sums of the parts and the distance of their means."""

    def __init__(self, p: int, row: dict | None = None):
        self.p, self.w, self.wa = p, 0.0, 0.0
        self.mean, self.scatter = np.zeros(p), np.zeros((p, p))
        if row:
            self.w, self.wa, self.mean, self.scatter = row["w"], row["wa"], np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(p, p)

    def take(self, x: np.ndarray, f: np.ndarray, a: np.ndarray) -> None:
        other, w = _Moments(self.p), f * a
        other.w, other.wa = w.sum(), (w * a).sum()
        if other.w:
            other.mean = w @ x / other.w
            d = x - other.mean
            other.scatter = (d * w[:, None]).T @ d
        self.merge(other)

    def merge(self, other: _Moments) -> None:
        total = self.w + other.w
        if total:
            d = other.mean - self.mean
            self.scatter = self.scatter + other.scatter + np.outer(d, d) * (self.w * other.w / total)
            self.mean = self.mean + d * (other.w / total)
        self.w, self.wa = total, self.wa + other.wa

    def row(self) -> pa.RecordBatch:
        values = [pa.array([self.w]), pa.array([self.wa]), pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.scatter.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, ["w", "wa", "mean", "scatter"])
