"""Neural-network primitives over arrays of (batch, channel, spatial …), on overlapping tiles of the grid (see ``halo``).

Kernels are broadcast in blocks of at most KERNEL elements; strides and paddings are driver-side lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.array import NDArray
from ndspark.errors import DimensionError, OperationError, ShapeError, ValueRangeError
from ndspark.operators.combine import Combining
from ndspark.operators.halo import Axis, axes, emitted, offsets, over_windows, tiled

#: Elements of a kernel that are broadcast at a time.
KERNEL = 4_000_000


def _per_axis(x: int | Sequence[int] | None, n: int, default: int) -> list[int]:
    x = default if x is None else x
    out = [x] * n if isinstance(x, int) else list(x)
    if len(out) != n:
        raise DimensionError(f"{len(out)} values for {n} spatial axes")
    return out


def _check(*arrays: NDArray) -> None:
    for a in arrays:
        if not a.dtype.is_float:
            raise OperationError("only floats have neural-network primitives")


def output_size(n: int, k: int, stride: int, pad: int) -> int:
    return (n + 2 * pad - k) // stride + 1


def _names(n: int) -> list[str]:
    return [*[f"i{k}" for k in range(n + 2)], "v"]


def _schema(n: int) -> str:
    return ", ".join([*[f"i{k} bigint" for k in range(n + 2)], "v double"])


def _result(x: NDArray, df: DataFrame, shape: Sequence[int]) -> NDArray:
    return x._frame(df.withColumn("v", F.col("v").cast(x.dtype.spark)), shape)


def _kernel(w: NDArray):
    """The kernel as a broadcast NumPy array."""
    cells = w.df.select(*[f"i{k}" for k in range(w.ndim)], F.col("v").cast("double").alias("v")).toArrow()
    out = np.zeros(w.shape)
    out[tuple(cells[f"i{k}"].to_numpy() for k in range(w.ndim))] = cells["v"].to_numpy()
    return w.spark.sparkContext.broadcast(out)


def _in_blocks(w: NDArray, axis: int, make) -> NDArray:
    """make(block of the kernel) for blocks of output channels (along ``axis``) of at most KERNEL elements, joined again."""
    n = w.shape[axis]
    size = max(1, KERNEL * n // max(1, w.size))
    keys = lambda lo: tuple(slice(lo, min(n, lo + size)) if k == axis else True for k in range(w.ndim))
    parts = [make(w if size >= n else w[keys(lo)]) for lo in range(0, n, size)]
    return parts[0] if len(parts) == 1 else Combining.concatenate(parts, 1)


def _add_bias(out: NDArray, b: NDArray | None) -> NDArray:
    return out if b is None else out.add(b.reshape(1, b.size, *[1] * (out.ndim - 2)))


def conv(x: NDArray, w: NDArray, b: NDArray | None = None, stride=1, pad=0) -> NDArray:
    """Cross-correlation; x (n, c, …), w (out, c, …), b (out)."""
    _check(x, w)
    n = x.ndim - 2
    if n < 2 or w.ndim != x.ndim:
        raise DimensionError("conv needs at least two spatial axes and kernels of the same number")
    if x.shape[1] != w.shape[1]:
        raise ShapeError(f"{x.shape[1]} channels of the input, {w.shape[1]} of the kernel")
    stride, pad = _per_axis(stride, n, 1), _per_axis(pad, n, 0)
    size = [output_size(m, k, s, p) for m, k, s, p in zip(x.shape[2:], w.shape[2:], stride, pad)]
    if min(size) < 1:
        raise ShapeError("the kernel is larger than the input")
    grid = axes(x.shape[2:], size, w.shape[2:], stride, pad, x.shape[1])

    def make(part: NDArray) -> NDArray:
        kernel = _kernel(part)

        def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
            weights = kernel.value
            for key, (local,) in tiles:
                out = np.zeros((weights.shape[0], *(a.edge for a in grid)))
                for at in offsets(weights.shape[2:]):
                    met = local[(slice(None), *(slice(k, k + (a.edge - 1) * a.stride + 1, a.stride) for k, a in zip(at, grid)))]
                    out += np.tensordot(weights[(slice(None), slice(None), *at)], met, 1)
                yield emitted(key, grid, out, _names(n))

        return _result(x, tiled([(x, grid, 0.0)], work, _schema(n)), [x.shape[0], part.shape[0], *size])

    return _add_bias(_in_blocks(w, 0, make), b)


def conv_transpose(x: NDArray, w: NDArray, b: NDArray | None = None, stride=1, pad=0, out_size: Sequence[int] | None = None) -> NDArray:
    """The gradient of conv by its input: x (n, in, …), w (in, out, …)."""
    _check(x, w)
    n = x.ndim - 2
    if n < 2 or x.shape[1] != w.shape[0]:
        raise ShapeError("channels of input and kernel differ")
    stride, pad = _per_axis(stride, n, 1), _per_axis(pad, n, 0)
    size = [s * (m - 1) + k - 2 * p for m, k, s, p in zip(x.shape[2:], w.shape[2:], stride, pad)]
    if out_size is not None:
        if [output_size(o, k, s, p) for o, k, s, p in zip(out_size, w.shape[2:], stride, pad)] != list(x.shape[2:]):
            raise ShapeError(f"an output of {list(out_size)} doesn't give this input")
        size = list(out_size)
    if min(size) < 1:
        raise ShapeError("the padding leaves nothing")
    grid = axes(x.shape[2:], size, w.shape[2:], stride, pad, max(x.shape[1], w.shape[1]), True)

    def make(part: NDArray) -> NDArray:
        kernel = _kernel(part)

        def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
            weights = kernel.value
            for key, (local,) in tiles:
                # results from kernel - 1 places before the tile on
                out = np.zeros((weights.shape[1], *(a.edge + 2 * a.kernel + a.stride for a in grid)))
                first = [a.start(t) * a.stride - a.pad - t * a.edge + a.kernel for a, t in zip(grid, key[1:])]
                fits = [min(a.local, (size - k - f) // a.stride + 1) for a, size, f, k in zip(grid, out.shape[1:], first, weights.shape[2:])]
                local = local[(slice(None), *(slice(0, m) for m in fits))]
                for at in offsets(weights.shape[2:]):
                    place = tuple(slice(f + k, f + k + (m - 1) * a.stride + 1, a.stride) for f, k, m, a in zip(first, at, fits, grid))
                    out[(slice(None), *place)] += np.tensordot(weights[(slice(None), slice(None), *at)].T, local, 1)
                yield emitted(key, grid, out[(slice(None), *(slice(a.kernel, a.kernel + a.edge) for a in grid))], _names(n))

        return _result(x, tiled([(x, grid, 0.0)], work, _schema(n)), [x.shape[0], part.shape[1], *size])

    return _add_bias(_in_blocks(w, 1, make), b)


conv_backward_data = conv_transpose


def conv_grad_w(x: NDArray, gy: NDArray, w_shape: Sequence[int], stride=1, pad=0) -> NDArray:
    """The gradient of conv by its kernel: every task adds up its tiles, then the tasks' kernels are added."""
    _check(x, gy)
    n = x.ndim - 2
    stride, pad = _per_axis(stride, n, 1), _per_axis(pad, n, 0)
    size = [output_size(m, k, s, p) for m, k, s, p in zip(x.shape[2:], w_shape[2:], stride, pad)]
    if list(gy.shape) != [x.shape[0], w_shape[0], *size]:
        raise ShapeError(f"a gradient of {list(gy.shape)} doesn't fit {[x.shape[0], w_shape[0], *size]}")
    grid = axes(x.shape[2:], size, w_shape[2:], stride, pad, max(x.shape[1], gy.shape[1]))
    own = [Axis(a.out, a.out, 1, 1, 0, a.edge) for a in grid]

    def make(g: NDArray) -> NDArray:
        shape = (g.shape[1], *w_shape[1:])

        def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            spatial = list(range(1, n + 1))
            for _, (local, grad) in tiles:
                for at in offsets(shape[2:]):
                    met = local[(slice(None), *(slice(k, k + (a.edge - 1) * a.stride + 1, a.stride) for k, a in zip(at, grid)))]
                    total[(slice(None), slice(None), *at)] += np.tensordot(grad, met, (spatial, spatial))
            places = np.indices(shape).reshape(len(shape), -1)
            yield pa.RecordBatch.from_arrays([*map(pa.array, places), pa.array(total.ravel())], _names(n))

        parts = tiled([(x, grid, 0.0), (g, own, 0.0)], work, _schema(n))
        return _result(x, parts.groupBy(*_names(n)[:-1]).agg(F.sum("v").alias("v")), shape)

    blocks = max(1, KERNEL // max(1, math.prod(w_shape[1:])))
    parts = [make(gy if blocks >= w_shape[0] else gy[(True, slice(lo, min(w_shape[0], lo + blocks)), *[True] * n)]) for lo in range(0, w_shape[0], blocks)]
    return parts[0] if len(parts) == 1 else Combining.concatenate(parts, 0)


conv_backward_filter = conv_grad_w


# ---- normalisation ------------------------------------------------------------------------


#: Positions whose statistics are sent to all tasks.
STATISTICS = 1_000_000


def _kept(x: NDArray, axis: Sequence[int]) -> tuple[list[str], list[int]]:
    """Names of the axes that are kept, and the shape with the others as 1."""
    gone = {x._axis(k) for k in axis}
    return [f"i{k}" for k in range(x.ndim) if k not in gone], [1 if k in gone else n for k, n in enumerate(x.shape)]


def _beside(rows: DataFrame, small: DataFrame, names: list[str], shape: Sequence[int]) -> DataFrame:
    """Rows with the columns of ``small`` (names …), which has a row for each position of ``shape``."""
    small = F.broadcast(small) if math.prod(shape) <= STATISTICS else small
    return rows.join(small, names) if names else rows.crossJoin(small)


def _of(x: NDArray, df: DataFrame, column: str, shape: Sequence[int], tag: str, indices: Sequence[str]) -> NDArray:
    """A column of a frame as an array over it; arrays of one tag are projections of one another."""
    return NDArray(df, [F.col(f"i{k}") if f"i{k}" in indices else F.lit(0).cast("bigint") for k in range(len(shape))], F.col(column).cast(x.dtype.spark), shape, x.dtype, tag)


def _columns(arrays: dict[str, NDArray], names: list[str], shape: Sequence[int]) -> DataFrame | None:
    """Arrays of the statistics' shape as columns of one frame."""
    out = None
    for name, a in arrays.items():
        df = a.reshape(*shape).df.select(*names, F.col("v").cast("double").alias(name))
        out = df if out is None else (out.join(df, names) if names else out.crossJoin(df))
    return out


def _moments(x: NDArray, names: list[str], eps: float) -> DataFrame:
    """(names, mean, var, inv) in one pass; the variance is that of all elements."""
    v = F.col("v").cast("double")
    nan = F.when(F.bool_or(F.isnan("v")), F.lit(float("nan")))
    stats = x.df.groupBy(*names).agg(F.avg(v).alias("mean"), F.coalesce(nan, F.var_pop(v)).alias("var"))
    return stats.withColumn("inv", 1 / F.sqrt(F.col("var") + F.lit(eps)))


def batch_norm(x: NDArray, gamma: NDArray, beta: NDArray, running_mean: NDArray | None = None, running_var: NDArray | None = None, eps: float = 2e-5, decay: float = 0.9, axis: Sequence[int] = (0,)) -> tuple[NDArray, NDArray, NDArray, NDArray | None, NDArray | None]:
    """(y, mean, inv_std, running mean, running variance); statistics over ``axis``, per element of the other axes.

    One pass for the statistics; these, gamma and beta are then joined to the elements at once.
    """
    _check(x, gamma, beta)
    names, shape = _kept(x, axis)
    stats = _moments(x, names, eps)
    given = _columns({"g": gamma, "b": beta}, names, shape)
    both = stats.join(given, names) if names else stats.crossJoin(given)
    rows = _beside(x.df, both.select(*names, "mean", (F.col("inv") * F.col("g")).alias("scale"), "b"), names, shape)
    y = _result(x, rows.select(*[f"i{k}" for k in range(x.ndim)], ((F.col("v").cast("double") - F.col("mean")) * F.col("scale") + F.col("b")).alias("v")), x.shape)
    mean, variance, inv_std = (_of(x, stats, c, shape, "statistics", names) for c in ("mean", "var", "inv"))
    n = x.size // math.prod(shape)
    if running_mean is not None:
        running_mean = running_mean.reshape(*shape).mul(decay).add(mean.mul(1 - decay))
    if running_var is not None:
        running_var = running_var.reshape(*shape).mul(decay).add(variance.mul((1 - decay) * (n / (n - 1) if n > 1 else 1.0)))
    return y, mean, inv_std, running_mean, running_var


def fixed_batch_norm(x: NDArray, gamma: NDArray, beta: NDArray, mean: NDArray, var: NDArray, eps: float = 2e-5, axis: Sequence[int] = (0,)) -> NDArray:
    """With given statistics."""
    _check(x, gamma, beta, mean, var)
    shape = [1 if k in axis else m for k, m in enumerate(x.shape)]
    gamma, beta, mean, var = (a.reshape(*shape) for a in (gamma, beta, mean, var))
    return x.sub(mean).mul(var.add(eps).math("sqrt").reciprocal()).mul(gamma).add(beta)


def batch_norm_backward(x: NDArray, gamma: NDArray, gy: NDArray, mean: NDArray | None = None, inv_std: NDArray | None = None, eps: float = 2e-5, axis: Sequence[int] = (0,)) -> tuple[NDArray, NDArray, NDArray]:
    """(gx, ggamma, gbeta): a pass for the statistics unless they are given, one for both sums, one for the elements."""
    _check(x, gamma, gy)
    names, shape = _kept(x, axis)
    if mean is None or inv_std is None:
        stats = _moments(x, names, eps).select(*names, "mean", "inv")
    else:
        stats = _columns({"mean": mean, "inv": inv_std}, names, shape)
    n = float(x.size // math.prod(shape))
    both = x._paired(gy, lambda a, b, t: (F.struct(a.cast("double").alias("x"), b.cast("double").alias("g")), x.dtype), upcast=False)
    every = [f"i{k}" for k in range(x.ndim)]
    rows = both.base.select(*[c.alias(i) for c, i in zip(both.indices, every)], both.value.alias("p")).select(*every, "p.x", "p.g")
    hat = (F.col("x") - F.col("mean")) * F.col("inv")
    sums = _beside(rows, stats, names, shape).groupBy(*names).agg(F.sum(F.col("g") * hat).alias("ggamma"), F.sum("g").alias("gbeta"))
    given = _columns({"gamma": gamma}, names, shape)
    small = stats.join(sums, names).join(given, names) if names else stats.crossJoin(sums).crossJoin(given)
    inner = F.col("g") - F.col("gbeta") / n - hat * F.col("ggamma") / n
    gx = _beside(rows, small, names, shape).select(*every, (inner * F.col("inv") * F.col("gamma")).alias("v"))
    return _result(x, gx, x.shape), *(_of(x, sums, c, shape, "sums", names) for c in ("ggamma", "gbeta"))


# ---- pooling ------------------------------------------------------------------------------


def _pool_plan(x: NDArray, ksize, stride, pad) -> tuple[list[int], list[int], list[int], list[int]]:
    n = x.ndim - 2
    ksize = _per_axis(ksize, n, 1)
    stride = list(ksize) if stride is None else _per_axis(stride, n, 1)
    pad = _per_axis(pad, n, 0)
    size = [output_size(m, k, s, p) for m, k, s, p in zip(x.shape[2:], ksize, stride, pad)]
    if min(size) < 1:
        raise ShapeError("the kernel is larger than the input")
    return ksize, stride, pad, size


def _met(a: Axis, first: int, count: int) -> np.ndarray:
    """How many real inputs the windows of results first, first + 1, … hold."""
    start = (first + np.arange(count)) * a.stride - a.pad
    return np.maximum(np.minimum(start + a.kernel, a.n) - np.maximum(start, 0), 0)


def _share(grid: list[Axis], firsts: Sequence[int], counts: Sequence[int], pad_value: int | None) -> np.ndarray:
    """What an average divides by, for each result of a tile."""
    if pad_value is not None:
        return np.full(counts, float(math.prod(a.kernel for a in grid)))
    out = np.ones(counts)
    for k, (a, first, count) in enumerate(zip(grid, firsts, counts)):
        out = out * _met(a, first, count).reshape([-1 if j == k else 1 for j in range(len(grid))])
    return np.maximum(out, 1)


def pooling_forward(mode: str, x: NDArray, ksize, stride=None, pad=0, pad_value: int | None = None) -> NDArray:
    """mode max or avg. ``stride`` is the kernel's size by default; pad_value None leaves padding out of averages, 0 counts it.

    Extremes and sums run along one axis after the other, with work for an element that doesn't depend on the kernel's size.
    """
    _check(x)
    if mode not in ("max", "avg"):
        raise ValueRangeError(f"no pooling {mode}")
    if pad_value not in (None, 0):
        raise ValueRangeError("pad_value is None or 0")
    ksize, stride, pad, size = _pool_plan(x, ksize, stride, pad)
    n = len(ksize)
    grid = axes(x.shape[2:], size, ksize, stride, pad, x.shape[1])
    fill = float("-inf") if mode == "max" else 0.0

    def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
        for key, (local,) in tiles:
            out = over_windows(local, ksize, stride, np.maximum if mode == "max" else np.add, fill)
            if mode == "avg":
                out = out / _share(grid, [t * a.edge for a, t in zip(grid, key[1:])], out.shape[1:], pad_value)
            elif min(m - p for m, p in zip(ksize, pad)) <= 0:
                out = np.where(np.isneginf(out), 0.0, out)  # windows of padding only
            yield emitted(key, grid, out, _names(n))

    return _result(x, tiled([(x, grid, fill)], work, _schema(n)), [*x.shape[:2], *size])


def max_pool(x: NDArray, ksize, stride=None, pad=0) -> NDArray:
    return pooling_forward("max", x, ksize, stride, pad)


def avg_pool(x: NDArray, ksize, stride=None, pad=0, pad_value: int | None = None) -> NDArray:
    return pooling_forward("avg", x, ksize, stride, pad, pad_value)


def pooling_backward(mode: str, x: NDArray, gy: NDArray, ksize, stride=None, pad=0, pad_value: int | None = None) -> NDArray:
    """The gradient by the input: of a maximum to its first element, of an average evenly."""
    _check(x, gy)
    ksize, stride, pad, size = _pool_plan(x, ksize, stride, pad)
    if list(gy.shape) != [*x.shape[:2], *size]:
        raise ShapeError(f"a gradient of {list(gy.shape)} doesn't fit {[*x.shape[:2], *size]}")
    return _max_backward(x, gy, ksize, stride, pad, size) if mode == "max" else _avg_backward(x, gy, ksize, stride, pad, size, pad_value)


def _max_backward(x: NDArray, gy: NDArray, ksize, stride, pad, size) -> NDArray:
    """Every element's rank (larger first, then earlier, NaN before all) takes part in a running minimum; its winner gets the gradient."""
    n = len(ksize)
    grid = axes(x.shape[2:], size, ksize, stride, pad, x.shape[1])
    own = [Axis(a.out, a.out, 1, 1, 0, a.edge) for a in grid]

    def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
        for key, (local, grad) in tiles:
            inside = np.ones(local.shape[1:], bool)
            for k, (a, t) in enumerate(zip(grid, key[1:])):
                real = a.start(t) + np.arange(a.local)
                inside &= ((real >= 0) & (real < a.n)).reshape([-1 if j == k else 1 for j in range(n)])
            flat, inside = local.ravel(), np.broadcast_to(inside, local.shape).ravel()
            order = np.lexsort((np.arange(flat.size), -flat, ~np.isnan(flat), ~inside))
            rank = np.empty(flat.size, np.int64)
            rank[order] = np.arange(flat.size)
            best = over_windows(rank.reshape(local.shape), ksize, stride, np.minimum, flat.size)
            best = best[(slice(None), *(slice(0, a.results(t)) for a, t in zip(grid, key[1:])))]
            grad = grad[tuple(slice(0, m) for m in best.shape)]
            winner = order[best.ravel()]
            keep = inside[winner]
            places = list(np.unravel_index(winner[keep], local.shape))
            for k, (a, t) in enumerate(zip(grid, key[1:]), 1):
                places[k] = places[k] + a.start(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), key[0])), *map(pa.array, places), pa.array(grad.ravel()[keep])], _names(n))

    won = tiled([(x, grid, 0.0), (gy, own, 0.0)], work, _schema(n))
    every = x.df.select(*_names(n)[:-1], F.lit(0.0).alias("v"))  # elements that win nothing
    out = won.unionByName(every).groupBy(*_names(n)[:-1]).agg(F.sum("v").alias("v"))
    return _result(x, out, x.shape)


def _avg_backward(x: NDArray, gy: NDArray, ksize, stride, pad, size, pad_value: int | None) -> NDArray:
    """Gradients, divided by what their window holds, are spread out by stride and summed over running windows."""
    n = len(ksize)
    grid = axes(size, x.shape[2:], ksize, stride, pad, x.shape[1], True)
    forward = [Axis(m, o, k, s, p, o) for m, o, k, s, p in zip(x.shape[2:], size, ksize, stride, pad)]

    def work(tiles: Iterator) -> Iterator[pa.RecordBatch]:
        for key, (local,) in tiles:
            starts = [a.start(t) for a, t in zip(grid, key[1:])]
            local = local / _share(forward, starts, local.shape[1:], pad_value)
            spread = np.zeros((local.shape[0], *(a.edge + a.kernel - 1 for a in grid)))
            places, picks = [], []
            for a, t, s in zip(grid, key[1:], starts):
                at = (s + np.arange(a.local)) * a.stride - a.pad - t * a.edge + a.kernel - 1
                pick = np.flatnonzero((at >= 0) & (at < a.edge + a.kernel - 1))
                places.append(at[pick])
                picks.append(pick)
            channels = np.arange(local.shape[0])
            spread[np.ix_(channels, *places)] = local[np.ix_(channels, *picks)]
            yield emitted(key, grid, over_windows(spread, ksize, [1] * n, np.add, 0.0), _names(n))

    return _result(x, tiled([(gy, grid, 0.0)], work, _schema(n)), x.shape)


def max_pool_backward(x: NDArray, gy: NDArray, ksize, stride=None, pad=0) -> NDArray:
    return pooling_backward("max", x, gy, ksize, stride, pad)


def avg_pool_backward(x: NDArray, gy: NDArray, ksize, stride=None, pad=0, pad_value: int | None = None) -> NDArray:
    return pooling_backward("avg", x, gy, ksize, stride, pad, pad_value)
