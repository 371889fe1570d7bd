"""Matrices of packed tiles: a product shuffles tiles, multiplies them in NumPy and sums them by tile.

A tile is a row (batch indices, block row, block column, packed elements). For a product every tile of
the left matrix goes to the output tiles of its block row, every tile of the right one to those of its
block column: (m k (n / side) + k n (m / side)) elements are shuffled, not m k n products. The rows of
an output tile arrive in order of the common axis, so that a task holds three tiles at a time. Where there are fewer
output tiles than tasks, the common axis is split as well, and the parts are summed by tile.

Of a product that only the extremes along an axis are wanted of, no element leaves its task (``product_extremes``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.plans.order import durable

if TYPE_CHECKING:
    from ndspark.array import NDArray

#: Rows and columns of a tile.
SIDE = 256
#: Longest rows that bands are made of, elements of a band, and of a block of a product that only its extremes are wanted of.
BAND_WIDTH, BAND, BLOCK = 2048, 1 << 20, 1 << 21
#: Partitions of the bands that every other band meets.
GATHERED = 8


def _kind(t: DType) -> np.dtype:
    """Of packed elements: integers of any width as 64 bits."""
    return np.dtype({"f": f"<f{t.bits // 8}", "c": f"<c{t.bits // 8}", "u": "<u8" if t.bits == 64 else "<i8"}.get(t.kind, "<i8"))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with equal keys (integers), as slices of their batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        for low, high in pairwise([0, *np.flatnonzero(changes), batch.num_rows]):
            key = tuple(int(c[low]) for c in columns)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(low, high - low))
    if held:
        yield now, held


class Tiles:
    """(b0 …, ti, tj, data) of a matrix, or of a batch of them."""

    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: DType, side: int = SIDE):
        self.df, self.shape, self.dtype, self.side = df, tuple(shape), dtype, side

    @property
    def batches(self) -> list[str]:
        return [f"b{k}" for k in range(len(self.shape) - 2)]

    @property
    def grid(self) -> tuple[int, int]:
        return math.ceil(self.shape[-2] / self.side), math.ceil(self.shape[-1] / self.side)

    # ---- from and to elements ---------------------------------------------------------

    @classmethod
    def of(cls, a: NDArray, side: int = SIDE) -> Tiles:
        """The tiles of an array with at least two axes; arrays whose source holds rows send pieces of rows, others elements."""
        if (made := getattr(a, "tiled", None)) is not None and made.side == side and made.dtype == a.dtype:
            return made
        t, kind, (rows, cols) = a.dtype, _kind(a.dtype), a.shape[-2:]
        names = [f"b{k}" for k in range(a.ndim - 2)]
        keys = [*names, "ti", "tj"]
        schema = ", ".join(f"{k} bigint" for k in keys)

        def size(key: tuple) -> tuple[int, int]:
            return min(side, rows - key[-2] * side), min(side, cols - key[-1] * side)

        if a.ndim == 2 and a.row_form and t.is_float:
            source, index, values = a.row_form

            def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        at = batch.column(0).to_numpy()
                        m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), cols)
                        for tj in range(math.ceil(cols / side)):
                            data = [x.tobytes() for x in m[:, tj * side : (tj + 1) * side]]
                            yield pa.RecordBatch.from_arrays([pa.array(at // side), pa.array(np.full(len(at), tj)), pa.array(at % side), pa.array(data, pa.binary())], ["ti", "tj", "r", "data"])

            elements = source.select(index.alias("i"), F.transform(values, lambda x: x.cast(t.spark)).alias("r")).mapInArrow(pieces, f"{schema}, r bigint, data binary")

            def fill(out: np.ndarray, part: pa.RecordBatch) -> None:
                out[part.column("r").to_numpy()] = np.frombuffer(b"".join(part.column("data").to_pylist()), kind).reshape(part.num_rows, -1)

        else:
            i, j = a.indices[-2:]
            values = [a.value["re"].alias("v"), a.value["im"].alias("w")] if t.is_complex else [a.value.cast("bigint" if kind == np.dtype("<i8") else t.spark).alias("v")]
            place = (i % side) * side + j % side
            cell = [F.call_function("div", c, F.lit(side).cast("bigint")).alias(n) for c, n in ((i, "ti"), (j, "tj"))]
            elements = a.base.select(*[c.alias(n) for c, n in zip(a.indices, names)], *cell, place.cast("int").alias("place"), *values)

            def fill(out: np.ndarray, part: pa.RecordBatch) -> None:
                where = part.column("place").to_numpy()
                v = part.column("v").to_numpy(zero_copy_only=False)
                if v.dtype == object:
                    v = np.array([int(x) for x in v], np.uint64)
                if t.is_complex:
                    v = v + 1j * part.column("w").to_numpy(zero_copy_only=False)
                out[where // side, where % side] = v

        def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, parts in runs(batches, keys):
                out = np.zeros(size(key), kind)
                for part in parts:
                    fill(out, part)
                yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([out.tobytes()], pa.binary())], [*keys, "data"])

        placed = elements.repartition(*keys).sortWithinPartitions(*keys)
        return cls(placed.mapInArrow(assemble, f"{schema}, data binary"), a.shape, t, side)

    def array(self) -> NDArray:
        """The elements; the tiles stay attached, for further products."""
        from ndspark.array import NDArray

        t, kind, side, names, (rows, cols) = self.dtype, _kind(self.dtype), self.side, self.batches, self.shape[-2:]
        indices = [f"i{k}" for k in range(len(self.shape))]
        wide = t == dt.UInt64

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    *key, data = (c[n] for c in batch.columns)
                    key = [k.as_py() for k in key]
                    width = min(side, cols - key[-1] * side)
                    x = np.frombuffer(data.as_buffer(), kind)
                    at = np.arange(len(x))
                    columns = [np.full(len(x), k) for k in key[:-2]] + [key[-2] * side + at // width, key[-1] * side + at % width]
                    parts = [x.real, x.imag] if t.is_complex else [x]
                    values = [pa.array([str(v) for v in p]) if wide else pa.array(p) for p in parts]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *values], [*indices, *["v", "w"][: len(values)]])

        part = "string" if wide else t.real.spark if not t.is_int else "bigint"
        schema = ", ".join([f"{i} bigint" for i in indices] + [f"{c} {part}" for c in ("v", "w")[: 1 + t.is_complex]])
        out = self.df.select(*names, "ti", "tj", "data").mapInArrow(spread, schema)
        value = F.struct(F.col("v").alias("re"), F.col("w").alias("im")) if t.is_complex else F.col("v").cast(t.spark)
        made = NDArray(out.select(*indices, value.alias("v")), [F.col(i) for i in indices], F.col("v"), self.shape, t)
        made.tiled = self
        return made

    # ---- product ----------------------------------------------------------------------

    def multiply(self, other: Tiles, alpha: object = 1, add: Tiles | None = None, beta: object = 1) -> Tiles:
        """alpha * self · other + beta * add; types, sides and batches (equal or 1) must agree."""
        t, side = self.dtype, self.side
        shape = [*(max(x, y) for x, y in zip(self.shape[:-2], other.shape[:-2])), self.shape[-2], other.shape[-1]]
        (mt, kt), nt = self.grid, other.grid[1]
        names = self.batches
        session = self.df.sparkSession
        units = math.prod(shape[:-2]) * mt * nt
        parts = min(kt, max(1, math.ceil(2 * int(session.conf.get("spark.sql.shuffle.partitions")) / units)))

        def sent(tiles: Tiles, way: int, **places) -> DataFrame:
            """Tiles with the output tiles that they go to; a batch of one goes to all."""
            df = tiles.df.select(*names, "ti", "tj", "data")
            rows = df.select(*names, *[c.alias(n) for n, c in places.items()], F.lit(way).alias("way"), "data")
            for k, n in enumerate(shape[:-2]):
                if tiles.shape[k] == 1 and n > 1:
                    rows = rows.withColumn(f"b{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
            return rows.select(*names, "ti", "tj", "tk", (F.pmod("tk", F.lit(parts)) if way else F.lit(0)).cast("bigint").alias("part"), "way", "data")

        def all_of(n: int):
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

        rows = sent(self, 1, ti=F.col("ti"), tj=all_of(nt), tk=F.col("tj")).unionByName(sent(other, 2, ti=all_of(mt), tj=F.col("tj"), tk=F.col("ti")))
        if add is not None:
            rows = rows.unionByName(sent(add, 0, ti=F.col("ti"), tj=F.col("tj"), tk=F.lit(-1).cast("bigint")))
        keys = [*names, "ti", "tj"]
        sizes = self.shape[-2], self.shape[-1], other.shape[-1]
        work = _Product(t, side, sizes, alpha, beta)
        schema = ", ".join(f"{k} bigint" for k in keys) + ", data binary"
        placed = rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "tk", "way")
        out = placed.mapInArrow(lambda batches: work.run(batches, [*keys, "part"]), schema)
        if parts > 1:
            out = out.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: work.total(batches, keys), schema)
        return Tiles(out, shape, t, side)


class _Product:
    """Sums of products of tiles; integers are exact and raise where the type doesn't hold the result."""

    def __init__(self, t: DType, side: int, sizes: tuple[int, int, int], alpha: object, beta: object):
        self.t, self.kind, self.side, self.sizes, self.alpha, self.beta = t, _kind(t), side, sizes, alpha, beta

    def _extent(self, axis: int, block: int) -> int:
        return min(self.side, self.sizes[axis] - block * self.side)

    def _read(self, data: pa.Scalar, rows: int) -> np.ndarray:
        x = np.frombuffer(data.as_buffer(), self.kind).reshape(rows, -1)
        return x.astype(np.float64 if self.t.is_float else np.complex128) if not self.t.is_int else x

    def _times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.t.is_int:
            return a @ b
        reach = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).astype(object) if reach < 2.0**53 else a.astype(object) @ b.astype(object)

    def _scaled(self, factor: object, x: np.ndarray) -> np.ndarray:
        return x if factor == 1 else x * factor

    def _packed(self, x: np.ndarray) -> bytes:
        if self.t.is_int and x.size and not self.t.minimum <= x.min() <= x.max() <= self.t.maximum:
            raise OverflowError(f"a sum of products is beyond {self.t}")
        return x.astype(self.kind).tobytes()

    def run(self, batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows by (…, ti, tj, part) in the order of tk: addend, left tile, right tile."""
        unit, total, left = None, None, (None, None)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in unit[:-1]], pa.array([self._packed(total)], pa.binary())], [*keys[:-1], "data"])

        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for key, tk, way, data in zip(places, batch.column("tk").to_pylist(), batch.column("way").to_pylist(), batch.column("data")):
                if key != unit:
                    if total is not None:
                        yield out()
                    unit, total, left = key, None, (None, None)
                height, width = self._extent(0, key[-3]), self._extent(2, key[-2])
                if way == 1:
                    left = tk, self._read(data, height)
                    continue
                if way == 0:
                    more = self._read(data, height)
                    more = self._scaled(self.beta, more.astype(object) if self.t.is_int else more)
                elif left[0] == tk:
                    more = self._scaled(self.alpha, self._times(left[1], self._read(data, self._extent(1, tk))))
                else:
                    continue
                total = more if total is None else total + more
                assert total.shape == (height, width)
        if total is not None:
            yield out()

    def total(self, batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
        """The sum of the parts of each tile; one part is held at a time."""
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in now], pa.array([self._packed(total)], pa.binary())], [*keys, "data"])

        for batch in batches:
            for *key, data in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("data")):
                x = self._read(data, self._extent(0, key[-2]))
                x = x.astype(object) if self.t.is_int else x
                if key != now:
                    if total is not None:
                        yield out()
                    now, total = key, x
                else:
                    total = total + x
        if total is not None:
            yield out()


def product_extremes(left: NDArray, right: NDArray, which: str, nan: bool = False, alpha: object = 1) -> DataFrame:
    """(i0, v): the extreme of each row of alpha * left · transpose(right), whose elements are neither stored nor shuffled.

    Both matrices (of floats of one type, with rows of at most BAND_WIDTH) are cut into bands of whole rows, written once. Every
    pair of bands is multiplied where it meets, in blocks, of which the extremes by row are kept; each partition of the left bands then sends one row of
    extremes for each of the few partitions of the right ones, so that disk and shuffle grow with the input and not with the product.
    """
    t, kind, width, rows = left.dtype, _kind(left.dtype), left.shape[1], left.shape[0]
    better = {("max", False): np.fmax, ("min", False): np.fmin, ("max", True): np.maximum, ("min", True): np.minimum}[which, nan]

    def bands(a: NDArray, most: int, name: str) -> tuple[DataFrame, int]:
        side = max(width, SIDE, min(BAND // width, -(-a.shape[0] // 16)))
        cut, n = Tiles.of(a, side), -(-a.shape[0] // side)
        return durable(cut.df.select(F.col("ti").alias(name), F.col("data").alias(f"{name}_data")).repartitionByRange(min(n, most), name)), side

    (a, height), (b, _) = bands(left, rows, "a"), bands(right, GATHERED, "b")

    def read(data: pa.Scalar) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), kind).reshape(-1, width).astype(np.float64)

    def packed(band: int, best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([band], pa.int64()), pa.array([best.tobytes()], pa.binary())], ["a", "best"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, best = None, None, None
        for batch in batches:
            for band, p, q in zip(batch.column("a").to_pylist(), batch.column("a_data"), batch.column("b_data")):
                if band != now:
                    if now is not None:
                        yield packed(now, best)
                    now, x = band, read(p)
                    best = np.full(len(x), np.nan if not nan else -np.inf if which == "max" else np.inf)
                y = read(q).T
                step = max(1, BLOCK // y.shape[1])
                for k in range(0, len(x), step):
                    block = x[k : k + step] @ y
                    if alpha != 1:
                        block *= alpha
                    best[k : k + step] = better(best[k : k + step], better.reduce(block, axis=1))
        if now is not None:
            yield packed(now, best)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band,), parts in runs(batches, ["a"]):
            best = None
            for part in parts:
                for data in part.column("best"):
                    x = np.frombuffer(data.as_buffer())
                    best = x if best is None else better(best, x)
            yield pa.RecordBatch.from_arrays([pa.array(band * height + np.arange(len(best))), pa.array(best)], ["i0", "v"])

    met = a.crossJoin(b.hint("shuffle_replicate_nl")).select("a", "a_data", "b_data").mapInArrow(multiply, "a bigint, best binary")
    out = met.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "i0 bigint, v double")
    return out.select("i0", F.col("v").cast(t.spark).alias("v"))
