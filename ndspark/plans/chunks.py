"""Scans along an axis in chunks of it: positions are dense, so chunks need no sampling and no sorted copy.

A chunk is ``size`` neighbouring positions of one segment (the other axes). Rows are dealt by segment and
chunk once; within a chunk a window scans them. What earlier chunks of the segment come to is one row a
chunk, aggregated before it is shuffled, and is joined to the chunk's rows. No task holds a segment, and all of it is a function of the
indices, so a lost task is done again with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Positions of a chunk.
CHUNK = 1 << 16


def chunk_of(at: str | Column, size: int) -> Column:
    return F.call_function("div", F.col(at) if isinstance(at, str) else at, F.lit(size).cast("bigint"))


def scan(df: DataFrame, segment: list[str], at: str, length: int, inside, total: Column, before: Callable, carry: Callable, name: str, size: int = CHUNK) -> DataFrame:
    """Adds an inclusive scan in the order of ``at`` (0 to length - 1) within each segment.

    inside: the aggregate over a window in a chunk; total: the same over a chunk, named _total;
    before(window): what the totals of a window of chunks make together; carry(offset, own): combines
    that with the scan within the chunk.
    """
    rows = df.withColumn("_chunk", chunk_of(at, size))
    local = Window.partitionBy(*segment, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*segment, "_chunk"]
    totals = rows.groupBy(*keys).agg(total.alias("_total"))
    earlier = Window.partitionBy(*segment).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, before(earlier).alias("_before"))
    if length <= size:  # a segment is one chunk
        return rows.withColumn("_own", inside.over(local)).withColumn(name, carry(_nothing(offsets), F.col("_own"))).drop("_chunk", "_own")
    own = rows.repartition(*keys).withColumn("_own", inside.over(local))
    return own.join(offsets, keys).withColumn(name, carry(F.col("_before"), F.col("_own"))).drop("_chunk", "_before", "_own")


def _nothing(offsets: DataFrame) -> Column:
    """What a chunk without earlier ones carries: the value of ``before`` over no rows."""
    return F.lit(None).cast(offsets.schema["_before"].dataType)


def neighbours(df: DataFrame, segment: list[str], at: str, length: int, reach: int, size: int = CHUNK) -> tuple[DataFrame, object]:
    """Rows with _chunk, and a window in which each row of a chunk has the ``reach`` rows that follow it.

    The first rows of a chunk go to the chunk before as well; they are marked _halo there and are to be dropped.
    """
    size = max(size, reach)
    if length <= size:
        return df.withColumn("_halo", F.lit(False)), Window.partitionBy(*segment).orderBy(at)
    chunk = chunk_of(at, size)
    both = F.when((F.col(at) % size < reach) & (F.col(at) >= size), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    rows = df.withColumn("_chunk", F.explode(both)).withColumn("_halo", F.col("_chunk") != chunk)
    return rows, Window.partitionBy(*segment, "_chunk").orderBy(at)


class Products:
    """Running products that a window can't give: whole numbers modulo 2**64 with a check, and complex numbers.

    A state is (product, about, count): the product modulo 2**64 as bytes of a 64-bit integer or of a
    complex number, the same as a double where it is whole, and the number of factors so far.
    """

    def __init__(self, kind: str, least: int = 0, most: int = 0, wrap: bool = False, skip: bool = False):
        self.complex, self.kind, self.least, self.most, self.wrap, self.skip = kind == "c", np.dtype({"c": "<c16", "u": "<u8", "i": "<i8"}[kind]), least, most, wrap, skip

    @property
    def one(self) -> tuple[bytes, float, int]:
        return np.ones(1, self.kind).tobytes(), 1.0, 0

    def read(self, part: pa.RecordBatch) -> np.ndarray:
        if self.complex:
            return part.column("x").to_numpy(zero_copy_only=False) + 1j * part.column("y").to_numpy(zero_copy_only=False)
        x = part.column("x").to_numpy(zero_copy_only=False)
        return np.array([int(v) for v in x], self.kind) if x.dtype == object else x.astype(self.kind)

    def along(self, x: np.ndarray, state: tuple[bytes, float, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(products, products as doubles, counts) after each element."""
        start = np.frombuffer(state[0], self.kind)
        use = ~np.isnan(x) if self.skip else np.ones(len(x), bool)
        factors = np.concatenate([start, np.where(use, x, x.dtype.type(1))])
        with np.errstate(all="ignore"):
            products = np.multiply.accumulate(factors)[1:]
            about = np.zeros(0) if self.complex else np.multiply.accumulate(np.concatenate([[state[1]], x.astype(np.float64)]))[1:]
        if not self.complex:
            gone = np.logical_or.accumulate(x == 0) | (state[1] == 0)
            about = np.where(gone, 0.0, about)
        return products, about, state[2] + np.cumsum(use)

    def along_runs(self, x: np.ndarray, starts: np.ndarray, states: list[tuple[bytes, float, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``along`` for runs that begin at ``starts``, each from its state. Many short runs go by position, all of them at once."""
        sizes = np.diff(np.append(starts, len(x)))
        longest = int(sizes.max(initial=0))
        if len(starts) <= longest or self.skip:
            parts = [self.along(x[k : k + n], state) for k, n, state in zip(starts.tolist(), sizes.tolist(), states)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        products, about = x.astype(self.kind), np.zeros(0) if self.complex else x.astype(np.float64)
        by_size = np.argsort(-sizes, kind="stable")
        first, left = starts[by_size], np.searchsorted(-sizes[by_size], -np.arange(longest))  # runs with an element at each position
        with np.errstate(all="ignore"):
            products[starts] *= np.frombuffer(b"".join(state[0] for state in states), self.kind)
            if not self.complex:
                about[starts] *= np.array([state[1] for state in states])
            for k in range(1, longest):
                here = first[: left[k]] + k
                products[here] *= products[here - 1]
                if not self.complex:
                    about[here] = np.where(about[here - 1] == 0, 0.0, about[here - 1] * about[here])
                    about[here[x[here] == 0]] = 0.0
        counts = np.arange(1, len(x) + 1) - np.repeat(starts, sizes) + np.repeat(np.array([state[2] for state in states], np.int64), sizes)
        return products, about, counts

    def joined(self, a: tuple[bytes, float, int], b: tuple[bytes, float, int]) -> tuple[bytes, float, int]:
        with np.errstate(all="ignore"):
            product = np.frombuffer(a[0], self.kind) * np.frombuffer(b[0], self.kind)
            return product.tobytes(), 0.0 if 0.0 in (a[1], b[1]) else float(np.float64(a[1]) * b[1]), a[2] + b[2]

    def checked(self, products: np.ndarray, about: np.ndarray) -> np.ndarray:
        """Whole products as they are, if the type holds them: a double next to 2**63 tells on which side the product modulo 2**64 is."""
        if self.complex or self.wrap:
            return products
        near = np.abs(about) < max(-float(self.least), float(self.most)) * (1 + 1e-9)
        near &= np.abs(products.astype(np.float64) - np.where(near, about, 0)) < 2.0**62
        if not (near & (products >= self.least) & (products <= self.most)).all():
            raise OverflowError("a product is too large for its type")
        return products


def product_scan(df: DataFrame, segment: list[str], at: str, length: int, products: Products, size: int = CHUNK) -> DataFrame:
    """(segment, at, p, q) with the running product of x (and y, the imaginary part) as p (and q); whole numbers are text if unsigned.

    Segments of no more than ``size`` elements are one chunk each: they are dealt once, and nothing lies before them.
    """
    single = length <= size
    keys = segment if single and segment else [*segment, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(at, size))
    names = [f"{k} bigint" for k in keys]
    state = "product binary, about double, count bigint"
    wide = products.kind == np.dtype("<u8")

    def placed(x: DataFrame) -> DataFrame:
        return x.repartition(*keys).sortWithinPartitions(*keys, at)

    def scanned(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator[tuple]:
        """(batch, starts of its runs, whether the first goes on from the batch before, products, about, counts)."""
        now, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in keys]
            changes = np.zeros(batch.num_rows, bool)
            changes[0] = True
            for c in ids:
                changes[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changes)
            states = begin(batch, starts)
            goes_on = now is not None and now == tuple(int(c[0]) for c in ids)
            if goes_on:
                states[0] = last
            p, about, count = products.along_runs(products.read(batch), starts, states)
            now, last = tuple(int(c[-1]) for c in ids), (p[-1:].tobytes(), float(about[-1]) if len(about) else 1.0, int(count[-1]))
            yield batch, starts, goes_on, p, about, count

    def nothing(batch: pa.RecordBatch, starts: np.ndarray) -> list:
        return [products.one] * len(starts)

    def before(batch: pa.RecordBatch, starts: np.ndarray) -> list:
        at_starts = batch.select(["product", "about", "count"]).take(pa.array(starts))
        return list(zip(*(c.to_pylist() for c in at_starts.columns)))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run of a batch may go on in the next
        for batch, starts, goes_on, p, about, count in scanned(batches, nothing):
            ends = np.append(starts[1:], batch.num_rows) - 1
            columns = [*[batch.column(k).take(pa.array(ends)) for k in keys], pa.array([p[e : e + 1].tobytes() for e in ends], pa.binary()), pa.array(about[ends] if len(about) else np.ones(len(ends))), pa.array(count[ends].astype(np.int64))]
            out = pa.RecordBatch.from_arrays(columns, [*keys, "product", "about", "count"])
            if held is not None and not goes_on:
                yield held
            yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals of a segment's chunks, in order, become what lies before each chunk."""
        now, state_ = None, products.one
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = [r[k] for k in segment]
                if own != now:
                    now, state_ = own, products.one
                out.append({**{k: r[k] for k in keys}, **dict(zip(("product", "about", "count"), state_))})
                state_ = products.joined(state_, (r["product"], r["about"], r["count"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([*[(k, pa.int64()) for k in keys], ("product", pa.binary()), ("about", pa.float64()), ("count", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, p, about, count in scanned(batches, nothing if single else before):
            out = products.checked(p, about)
            if products.skip:
                out = np.where(count > 0, out, complex("nan") if products.complex else np.nan)
            values = [pa.array(out.real), pa.array(out.imag)] if products.complex else [pa.array([str(v) for v in out]) if wide else pa.array(out)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in segment], batch.column(at), *values], [*segment, at, "p", "q"][: len(segment) + 1 + len(values)])

    kind = "double" if products.complex else "string" if wide else "bigint"
    schema = ", ".join([*[f"{k} bigint" for k in segment], f"{at} bigint", f"p {kind}", *(["q double"] if products.complex else [])])
    if single:
        return placed(rows).mapInArrow(finish, schema)
    sums = placed(rows).mapInArrow(totals, ", ".join([*names, state]))
    by = sums.repartition(*segment) if segment else sums.coalesce(1)
    offsets = by.sortWithinPartitions(*keys).mapInArrow(earlier, ", ".join([*names, state]))
    return placed(rows.join(offsets, keys)).mapInArrow(finish, schema)
