"""Neighbourhoods on grids: overlapping tiles as local arrays, each worked on in NumPy.

The positions of a result (batch, channel, spatial …) are cut into tiles. An element of the input goes to
every tile whose results it takes part in: one, or a few at the borders (the halo), so that the shuffle holds the input and its
halos, whatever the size of the kernel. A small image whose source row holds all of it isn't shuffled at all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ndspark.array import NDArray
from ndspark.operators.tiles import runs

#: Elements of a local array, about.
LOCAL = 1 << 20


class Axis:
    """One spatial axis: ``n`` inputs, ``out`` results, and which of them meet.

    Forward: result o meets inputs o * stride - pad + k, 0 <= k < kernel. Backward (``back``): input i meets results
    i * stride - pad + k. A tile has ``edge`` results; its local inputs begin at ``start(tile)`` and are ``local`` many.
    """

    def __init__(self, n: int, out: int, kernel: int, stride: int, pad: int, edge: int, back: bool = False):
        self.n, self.out, self.kernel, self.stride, self.pad, self.back = n, out, kernel, stride, pad, back
        self.edge = max(1, min(edge, out))
        self.tiles = -(-out // self.edge)
        self.local = (self.edge + kernel - 2) // stride + 2 if back else (self.edge - 1) * stride + kernel

    def start(self, tile: int) -> int:
        if self.back:
            return -((self.kernel - 1 - self.pad - tile * self.edge) // self.stride)
        return tile * self.edge * self.stride - self.pad

    def start_column(self, tile: Column) -> Column:
        if self.back:
            return -F.floor((F.lit(self.kernel - 1 - self.pad) - tile * self.edge) / F.lit(float(self.stride)))
        return tile * (self.edge * self.stride) - self.pad

    def tiles_of(self, i: Column) -> tuple[Column, Column]:
        """First and last tile that an input is sent to."""
        if self.back:
            low, high = i * self.stride - self.pad, i * self.stride - self.pad + (self.kernel - 1)
            first, last = F.floor(low / F.lit(float(self.edge))), F.floor(high / F.lit(float(self.edge)))
        else:
            step = float(self.edge * self.stride)
            first, last = F.ceil((i + self.pad - self.local + 1) / F.lit(step)), F.floor((i + self.pad) / F.lit(step))
        return F.greatest(first, F.lit(0)).cast("bigint"), F.least(last, F.lit(self.tiles - 1)).cast("bigint")

    def results(self, tile: int) -> int:
        return min(self.edge, self.out - tile * self.edge)


def axes(x: Sequence[int], out: Sequence[int], kernel: Sequence[int], stride: Sequence[int], pad: Sequence[int], channels: int, back: bool = False) -> list[Axis]:
    """Tiles whose local arrays have about LOCAL elements with all channels."""
    edge = max(8, math.floor((LOCAL / max(1, channels)) ** (1 / len(x)) / (1 if back else max(stride))))
    return [Axis(*values, edge, back) for values in zip(x, out, kernel, stride, pad)]


def _whole(x: NDArray, grid: list[Axis]) -> bool:
    return x.image_form is not None and all(a.tiles == 1 for a in grid)


def located(x: NDArray, grid: list[Axis], tag: int = 0) -> DataFrame:
    """(i0, t0 …, place, v): elements at their places in the local arrays of their tiles; a row with place -1 for every tile."""
    n = len(grid)
    names = [f"t{k}" for k in range(n)]
    rows = x.df.select("i0", "i1", *[F.col(f"i{k + 2}").alias(f"p{k}") for k in range(n)], F.col("v").cast("double").alias("v"))
    for k, a in enumerate(grid):
        first, last = a.tiles_of(F.col(f"p{k}"))
        rows = rows.withColumn(names[k], F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    place = F.col("i1")
    for k, a in enumerate(grid):
        place = place * a.local + F.col(f"p{k}") - a.start_column(F.col(names[k]))
    rows = rows.select("i0", *names, place.cast("bigint").alias("place"), "v")
    total = math.prod(a.tiles for a in grid)
    marks = x.spark.range(x.shape[0] * total)
    at, picks = F.col("id") % total, []
    for k, a in enumerate(grid):
        rest = math.prod(b.tiles for b in grid[k + 1 :])
        picks.append((F.call_function("div", at, F.lit(rest).cast("bigint")) % a.tiles).alias(names[k]))
    marks = marks.select(F.call_function("div", F.col("id"), F.lit(total).cast("bigint")).alias("i0"), *picks, F.lit(-1).cast("bigint").alias("place"), F.lit(0.0).alias("v"))
    return rows.unionByName(marks).withColumn("tag", F.lit(tag))


def tiled(inputs: list[tuple[NDArray, list[Axis], float]], work: Callable[[Iterator[tuple[tuple, list[np.ndarray]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over (key, local arrays): key = (i0, tiles …), one array [channels, local …] for each input, filled up with its third entry.

    All inputs have the same tiles.
    """
    shapes = [(x.shape[1], *(a.local for a in grid)) for x, grid, _ in inputs]
    fills = [fill for *_, fill in inputs]
    grid = inputs[0][1]
    keys = ["i0", *[f"t{k}" for k in range(len(grid))]]
    if len(inputs) == 1 and _whole(inputs[0][0], grid):
        x = inputs[0][0]
        source, index, values = x.image_form
        image, inner = x.shape[1:], tuple(slice(-a.start(0), -a.start(0) + a.n) for a in grid)
        outer = [slice(None)] * 1
        # results may need fewer inputs than there are
        cut = (slice(None), *(slice(0, max(0, min(a.n, a.local + a.start(0)))) for a in grid))

        def images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, *image)
                for i, one in zip(batch.column(0).to_pylist(), m):
                    local = np.full(shapes[0], fills[0])
                    local[(*outer, *inner)] = one[cut]
                    yield (i, *[0] * len(grid)), [local]

        rows = source.select(index.alias("i0"), F.transform(values, lambda v: v.cast("double")).alias("r"))
        if all(a.start(0) <= 0 for a in grid):
            return rows.mapInArrow(lambda batches: work(images(batches)), schema)
    rows = located(inputs[0][0], grid, 0)
    for tag, (x, own, _) in enumerate(inputs[1:], 1):
        rows = rows.unionByName(located(x, own, tag))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        for key, parts in runs(batches, keys):
            local = [np.full(math.prod(s), fill) for s, fill in zip(shapes, fills)]
            for part in parts:
                place, v, tag = (part.column(c).to_numpy(zero_copy_only=False) for c in ("place", "v", "tag"))
                for k, a in enumerate(local):
                    mine = (tag == k) & (place >= 0)
                    a[place[mine]] = v[mine]
            yield key, [a.reshape(s) for a, s in zip(local, shapes)]

    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(lambda batches: work(arrays(batches)), schema)


def emitted(key: tuple, grid: list[Axis], out: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    """Rows (i0, i1, positions …, v) of a tile's results [channels, edge …]."""
    out = out[(slice(None), *(slice(0, a.results(t)) for a, t in zip(grid, key[1:])))]
    places = np.indices(out.shape).reshape(out.ndim, -1)
    for k, (a, t) in enumerate(zip(grid, key[1:]), 1):
        places[k] += t * a.edge
    return pa.RecordBatch.from_arrays([pa.array(np.full(out.size, key[0])), *map(pa.array, places), pa.array(out.ravel())], list(names))


def offsets(kernel: Sequence[int]) -> Iterator[tuple[int, ...]]:
    """All kernel positions in row-major order."""
    return itertools.product(*map(range, kernel))


# ---- running extremes and sums ------------------------------------------------------------


def _blocks(a: np.ndarray, axis: int, k: int, fill: float) -> np.ndarray:
    """The axis last, filled up to whole blocks of k: [..., blocks, k]."""
    a = np.moveaxis(a, axis, -1)
    n = -(-a.shape[-1] // k) * k
    full = np.full((*a.shape[:-1], n), fill, a.dtype)
    full[..., : a.shape[-1]] = a
    return full.reshape(*a.shape[:-1], -1, k)


def running(a: np.ndarray, axis: int, k: int, step: int, of: np.ufunc, fill: float) -> np.ndarray:
    """``of`` (maximum, minimum or add) over every window of k along an axis, windows ``step`` apart.

    A window is the end of one block of k and the beginning of the next: one prefix and one suffix
    value, so the work for an element doesn't depend on k.
    """
    n = a.shape[axis]
    b = _blocks(a, axis, k, fill)
    prefix = of.accumulate(b, axis=-1).reshape(*b.shape[:-2], -1)
    suffix = of.accumulate(b[..., ::-1], axis=-1)[..., ::-1].reshape(*b.shape[:-2], -1)
    first = np.arange(0, n - k + 1, step)
    out = prefix[..., first + k - 1]
    crossing = first % k != 0
    out[..., crossing] = of(suffix[..., first[crossing]], out[..., crossing])
    return np.moveaxis(out, -1, axis)


def over_windows(a: np.ndarray, kernel: Sequence[int], stride: Sequence[int], of: np.ufunc, fill: float) -> np.ndarray:
    """Separably over all spatial axes (those after the first)."""
    for k, (size, step) in enumerate(zip(kernel, stride), 1):
        a = running(a, k, size, step, of, fill)
    return a
