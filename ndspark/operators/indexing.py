"""Views, indexing, selection and assignment.

Slices, reversal and new axes only rewrite index expressions and filter; index lists join with a
small selector frame; masks filter and renumber in row-major order.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.errors import DimensionError, ShapeError
from ndspark.plans.chunks import scan

if TYPE_CHECKING:
    from ndspark.array import NDArray

#: Selector frames of at most this many positions are broadcast.
SMALL_SELECTOR = 1_000_000


#: Positions that go into an expression as literals; more of them are joined.
FEW = 256

#: Words that stand for a key of an axis: the whole of it, a new one, the rest of them, or its sum.
WORDS = {"all": True, "*": True, "new": None, "-": None, "rest": ..., "~": ..., "+": "sum", "reduce": "sum"}


def normal_index(i: int | float, n: int) -> int:
    """A non-negative position; floats truncate, negatives count from the end."""
    i = int(i)
    k = i + n if i < 0 else i
    if not 0 <= k < n:
        raise IndexError(f"index {i} out of range for axis of size {n}")
    return k


def _range(s: slice, n: int) -> range:
    """Positions of start:stop:step with a positive or negative step; endpoints must lie in range."""
    step = 1 if s.step is None else s.step
    if not isinstance(step, int) or step == 0:
        raise IndexError("step must be a nonzero integer")
    for x in (s.start, s.stop):
        if x is not None and not -n <= x <= n:
            raise IndexError(f"{x} out of range for axis of size {n}")
    return range(*slice(s.start, s.stop, step).indices(n))


class Indexing:
    """Mixin: selection."""

    def __getitem__(self: NDArray, key) -> NDArray:
        from ndspark.array import NDArray

        if isinstance(key, NDArray):
            if key.dtype == dt.Bit:
                return self.mask(key)
            return self.take_flat(key)
        keys = [WORDS.get(k, k) if isinstance(k, str) else k for k in (key if isinstance(key, tuple) else (key,))]
        if len(keys) == 1 and isinstance(keys[0], (int, float)) and not isinstance(keys[0], bool) and self.ndim != 1:
            k = normal_index(keys[0], self.size)
            return self._frame(self.base.where(self.flat() == k).select(self.value.alias("v")), [])
        if Ellipsis in [k for k in keys if k is Ellipsis]:
            if sum(k is Ellipsis for k in keys) > 1:
                raise IndexError("at most one ellipsis")
            at = next(i for i, k in enumerate(keys) if k is Ellipsis)
            fill = self.ndim - sum(k is not None and k is not Ellipsis for k in keys)
            keys[at : at + 1] = [slice(None)] * fill
        if sum(k is not None for k in keys) != self.ndim:
            raise IndexError(f"{len(keys)} indices for {self.ndim} dimensions")
        if "sum" in [k for k in keys if isinstance(k, str)]:
            out = self._select([True if isinstance(k, str) and k == "sum" else k for k in keys])
            kept = [k for k in keys if isinstance(k, str) or not isinstance(k, (int, float)) or k is True]
            return out.sum(axis=[i for i, k in enumerate(kept) if isinstance(k, str) and k == "sum"])
        return self._select(keys)

    def slice(self: NDArray, *keys) -> NDArray:
        """Like indexing, but single positions keep their axis."""
        if len(keys) != self.ndim:
            raise IndexError(f"{len(keys)} indices for {self.ndim} dimensions")
        return self._select([slice(k, None if k == -1 else k + 1) if isinstance(k, int) else k for k in keys])

    def _select(self: NDArray, keys: list) -> NDArray:
        """One key an axis: int, slice, True (whole), 'reverse', a list, a one-dimensional array; None is a new axis.

        Words are replaced before (see WORDS); 'sum' is left to indexing.
        """
        from ndspark.array import NDArray

        base, indices, shape, conditions, joins, axis = self.base, [], [], [], [], 0
        for key in keys:
            if key is None:
                indices.append(F.lit(0).cast("bigint"))
                shape.append(1)
                continue
            n, at = self.shape[axis], self.indices[axis]
            axis += 1
            if key is True or isinstance(key, slice) and key == slice(None):
                indices.append(at)
                shape.append(n)
            elif isinstance(key, str) and key == "reverse":
                indices.append(F.lit(n - 1) - at)
                shape.append(n)
            elif isinstance(key, (int, float)):
                position = normal_index(key, n)
                conditions += [at == position, *self._in_chunks(axis - 1, position, position)]
            elif isinstance(key, slice):
                r = _range(key, n)
                shape.append(len(r))
                if not len(r):
                    conditions.append(F.lit(False))
                    indices.append(at)
                    continue
                low, high = min(r[0], r[-1]), max(r[0], r[-1])
                conditions += [at.between(low, high), *self._in_chunks(axis - 1, low, high)]
                if abs(r.step) > 1:
                    conditions.append((at - r[0]) % F.lit(abs(r.step)) == 0)
                indices.append(((at - r[0]) / F.lit(r.step)).cast("bigint") if r.step != 1 else at - F.lit(r[0]))
            else:
                frame, size = self._selector(key, n)
                if self.chunks and isinstance(key, (list, range)) and 0 < len(key) <= SMALL_SELECTOR and not isinstance(key[0], bool):
                    conditions.append(F.col(self.chunks[axis - 1][0]).isin(sorted({normal_index(x, n) // self.chunks[axis - 1][1] for x in key})))
                joins.append((len(indices), at, frame, size))
                indices.append(None)
                shape.append(size)
        if not joins:
            for c in conditions:
                base = base.where(c)
            tag = (self.tag, repr(keys)) if not conditions else None
            return NDArray(base, indices, self.value, shape, self.dtype, tag)
        names = [f"p{k}" for k in range(len(indices))]
        for c in conditions:
            base = base.where(c)
        plain = base.select(*[c.alias(names[k]) for k, c in enumerate(indices) if c is not None], *[at.alias(f"s{k}") for k, at, *_ in joins], self.value.alias("v"))
        for k, _, frame, size in joins:
            small = frame.select(F.col("position").alias(names[k]), F.col("source").alias(f"s{k}"))
            plain = plain.join(F.broadcast(small) if size <= SMALL_SELECTOR else small, f"s{k}").drop(f"s{k}")
        return self._frame(plain.withColumnsRenamed({names[k]: f"i{k}" for k in range(len(names))}), shape)

    def _in_chunks(self: NDArray, axis: int, low: int, high: int) -> list[Column]:
        """The chunks of a stored array that hold these positions of an axis."""
        if not self.chunks:
            return []
        name, edge = self.chunks[axis]
        return [F.col(name).between(low // edge, high // edge)]

    def _selector(self: NDArray, key, n: int) -> tuple[DataFrame, int]:
        """(position, source) frame of an index list, an index array or a mask over an axis."""
        from ndspark.array import NDArray

        if isinstance(key, NDArray):
            if key.ndim != 1:
                raise IndexError("an axis takes a one-dimensional index")
            if key.dtype == dt.Bit:
                if key.shape[0] != n:
                    raise IndexError(f"mask of {key.shape[0]} for axis of size {n}")
                key = key.where()
            at = F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v")).cast("bigint")
            checked = F.when(at.between(0, n - 1), at).otherwise(F.raise_error(F.lit("index out of range")))
            return key.df.select(F.col("i0").alias("position"), checked.alias("source")), key.shape[0]
        if isinstance(key, (list, range)) and len(key) and all(isinstance(x, bool) for x in key):
            if len(key) != n:
                raise IndexError(f"mask of {len(key)} for axis of size {n}")
            key = [i for i, x in enumerate(key) if x]
        rows = [(i, normal_index(x, n)) for i, x in enumerate(key)]
        return self.spark.createDataFrame(rows, "position bigint, source bigint"), len(rows)

    def at(self: NDArray, *keys: Sequence[int]) -> NDArray:
        """One-dimensional: the elements at (keys[0][j], keys[1][j], …)."""
        if len(keys) != self.ndim:
            raise DimensionError(f"{len(keys)} index lists for {self.ndim} dimensions")
        if len({len(k) for k in keys}) > 1:
            raise ShapeError("index lists differ in length")
        rows = [(j, *(normal_index(k[j], n) for k, n in zip(keys, self.shape))) for j in range(len(keys[0]))]
        names = [f"s{k}" for k in range(self.ndim)]
        picks = self.spark.createDataFrame(rows, "p bigint, " + ", ".join(f"{n} bigint" for n in names))
        mine = self.base.select(*[c.alias(n) for c, n in zip(self.indices, names)], self.value.alias("v"))
        picks = F.broadcast(picks) if len(rows) <= SMALL_SELECTOR else picks
        return self._frame(mine.join(picks, names).select(F.col("p").alias("i0"), "v"), [len(rows)])

    def take_flat(self: NDArray, index: NDArray) -> NDArray:
        """Gather by row-major position, shaped like the index array: an equi-join on the position."""
        n = self.size
        at = F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v")).cast("bigint")
        names = [f"i{k}" for k in range(index.ndim)]
        wanted = index.df.select(*names, F.when(at.between(0, n - 1), at).otherwise(F.raise_error(F.lit("index out of range"))).alias("f"))
        mine = self.base.select(self.flat().alias("f"), self.value.alias("v"))
        return self._frame(wanted.join(mine, "f").select(*names, "v"), index.shape)

    def mask(self: NDArray, bits: NDArray) -> NDArray:
        """The elements where ``bits`` is true, in row-major order, one-dimensional."""
        if bits.shape != self.shape:
            raise ShapeError(f"mask shape {list(bits.shape)} for {list(self.shape)}")
        pair = self._paired(bits, lambda a, b, t: (F.when(b, F.struct(a.alias("x"))), t), upcast=False)
        kept = pair.base.select(pair.flat().alias("f"), pair.value.alias("s")).where("s is not null").select("f", F.col("s.x").alias("v"))
        return self._numbered(kept, self.dtype)

    def _numbered(self: NDArray, kept: DataFrame, dtype: dt.DType) -> NDArray:
        """One-dimensional, from some elements (f, v) in the order of their positions f: counts of earlier chunks, and a number within the chunk."""
        total = F.count(F.lit(1))
        before = lambda w: F.coalesce(F.sum("_total").over(w), F.lit(0))
        out = scan(kept, [], "f", self.size, F.row_number(), total, before, lambda offset, own: F.coalesce(offset, F.lit(0)) + own - 1, "i0")
        return self._frame(out.select(F.col("i0").cast("bigint").alias("i0"), "v"), [kept.count()], dtype)

    def where(self: NDArray) -> NDArray:
        """Row-major positions of true bits, ascending."""
        return self._numbered(self.base.where(self.value).select(self.flat().alias("f")).withColumn("v", F.col("f")), dt.Int64)

    def where2(self: NDArray) -> tuple[NDArray, NDArray]:
        """Positions of true and of false bits."""
        return self.where(), self.bit_not().where()

    def assign(self: NDArray, keys, value) -> NDArray:
        """A new array with the selected part replaced by ``value`` (broadcast)."""
        from ndspark.array import NDArray

        keys = list(keys) if isinstance(keys, tuple) else [keys]
        if isinstance(keys[0], NDArray) and keys[0].dtype == dt.Bit:
            new = NDArray._lift(value, self)
            chosen = self._paired(keys[0], lambda a, b, t: (F.struct(a.alias("x"), b.alias("b")), t), upcast=False)
            return chosen._paired(new, lambda a, b, t: (F.when(a["b"], dt.cast(b, new.dtype, self.dtype)).otherwise(a["x"]), self.dtype), upcast=False)
        places = NDArray(self.base, self.indices, self.flat(), self.shape, dt.Int64, self.tag)._select(keys)
        new = places.cast_to(self.dtype).store(value) if isinstance(value, NDArray) else places._like(dt.literal(value, self.dtype), self.dtype)
        names = [f"i{k}" for k in range(places.ndim)]
        changes = places.df.withColumnRenamed("v", "f").join(new.df, names) if names else places.df.withColumnRenamed("v", "f").crossJoin(new.df)
        mine = self.base.select(*[c.alias(f"i{k}") for k, c in enumerate(self.indices)], self.flat().alias("f"), self.value.alias("old"))
        changes = changes.select("f", F.struct(F.col("v").alias("new")).alias("new"))
        joined = mine.join(changes, "f", "left").withColumn("v", F.when(F.col("new").isNotNull(), F.col("new.new")).otherwise(F.col("old")))
        return self._frame(joined.select(*[f"i{k}" for k in range(self.ndim)], "v"), self.shape)

    def delete(self: NDArray, index: int | Sequence[int] | NDArray, axis: int | None = None) -> NDArray:
        """Without the given positions, a list or an array of integers of any length; flattened without an axis."""
        from ndspark.array import NDArray
        from ndspark.sources.create import array

        if axis is None and self.ndim != 1:
            return self.flatten().delete(index, 0)
        axis = self._axis(0 if axis is None else axis)
        n = self.shape[axis]
        if not isinstance(index, NDArray):
            gone = {normal_index(i, n) for i in ([index] if isinstance(index, int) else index)}
            if len(gone) <= FEW:
                return self._delete_few(sorted(gone), axis)
            index = array(self.spark, sorted(gone), "Int64")
        hit = index.cast_to("Int64")._in_range(n).bincount(minlength=n).gt(0)
        left = n - int(hit.count_true().item())
        before = hit.cast_to("Int64").cumsum()
        marks = hit.df.select(F.col("i0").alias("j"), F.col("v").alias("hit")).join(before.df.select(F.col("i0").alias("j"), F.col("v").alias("s")), "j").where("not hit")
        rows = self.df.join(marks, F.col(f"i{axis}") == F.col("j")).withColumn(f"i{axis}", F.col(f"i{axis}") - F.col("s"))
        return self._frame(rows.drop("j", "hit", "s"), [left if k == axis else m for k, m in enumerate(self.shape)])

    def _delete_few(self: NDArray, gone: list[int], axis: int) -> NDArray:
        if not gone:
            return self
        at = self.indices[axis]
        list_ = F.array(*[F.lit(g).cast("bigint") for g in gone])
        shift = F.size(F.filter(list_, lambda x: x < at))
        indices = [at - shift if k == axis else c for k, c in enumerate(self.indices)]
        from ndspark.array import NDArray

        shape = [n - len(gone) if k == axis else n for k, n in enumerate(self.shape)]
        return NDArray(self.base.where(~at.isin(gone)), indices, self.value, shape, self.dtype)

    def each_over_axis(self: NDArray, axis: int = 0):
        """Arrays of one dimension less, along an axis."""
        axis = self._axis(axis)
        for i in range(self.shape[axis]):
            yield self._select([True] * axis + [i] + [True] * (self.ndim - axis - 1))
