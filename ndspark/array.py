"""NDArray: a dense n-dimensional array as a DataFrame of (indices, value).

An array is a base frame, one expression for each index and one for the value. Elementwise
operations of arrays over the same base with the same index expressions combine the value
expressions and need no join; only arrays of different origin are joined on their indices. Shape
and element type are known on the driver, so shape errors raise before any job runs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.errors import CastError, DimensionError, OperationError, ShapeError
from ndspark.functions import complexes as cx
from ndspark.functions import elementwise as ew
from ndspark.functions import ieee, nmath
from ndspark.operators.combine import Combining
from ndspark.operators.indexing import Indexing
from ndspark.operators.linear import Linear
from ndspark.operators.reducing import Reducing
from ndspark.operators.scanning import Scanning
from ndspark.operators.shaping import Shaping

_TAGS = itertools.count()


def index_names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def row_count(df: DataFrame) -> int:
    """Rows of a frame, counted once for all arrays that are made from it."""
    if "_nd_rows" not in df.__dict__:
        df.__dict__["_nd_rows"] = df.count()
    return df.__dict__["_nd_rows"]


class NDArray(Indexing, Shaping, Reducing, Scanning, Combining, Linear):
    """See the module. ``tag`` names the index expressions: equal tags over one base mean equal rows."""

    def __init__(self, base: DataFrame, indices: Sequence[Column], value: Column, shape: Sequence[int], dtype: DType, tag: object = None):
        if len(shape) > dt.MAX_DIMENSIONS:
            raise DimensionError(f"at most {dt.MAX_DIMENSIONS} dimensions")
        self.base, self.indices, self.value, self.shape, self.dtype = base, tuple(indices), value, tuple(int(n) for n in shape), dtype
        self.tag = next(_TAGS) if tag is None else tag
        #: (frame, index, array column) where a row of the base's source holds a row of this matrix.
        self.row_form: tuple[DataFrame, Column, Column] | None = None
        #: The same where it holds all elements of one position of the first axis, in row-major order.
        self.image_form: tuple[DataFrame, Column, Column] | None = None
        #: (partition column, edge) of each axis, where the base is a stored array on a chunk grid.
        self.chunks: list[tuple[str, int]] | None = None
        #: Like row_form, where a row of the source holds a column.
        self.column_form: tuple[DataFrame, Column, Column] | None = None
        #: (left, right, factor) where this is the product of two matrices.
        self.factors: tuple[NDArray, NDArray, object] | None = None

    # ---- construction -----------------------------------------------------------------

    @classmethod
    def from_coo(cls, df: DataFrame, shape: Sequence[int], dtype: DType | str | None = None, value: str = "v") -> NDArray:
        """From a frame with columns i0 … and a value; every index tuple once, in range."""
        dtype = dt.of(dtype) if dtype else dt.of_spark(df.schema[value].dataType.simpleString())
        names = index_names(len(shape))
        base = df.select(*[F.col(n).cast("bigint").alias(n) for n in names], F.col(value).alias("v"))
        return cls(base, [F.col(n) for n in names], F.col("v").cast(dtype.spark), shape, dtype)

    @classmethod
    def from_column(cls, df: DataFrame, value: str | Column, index: str, dtype: DType | str | None = None, size: int | None = None) -> NDArray:
        """A one-dimensional array: a column of a table whose ``index`` column is its dense 0-based key.

        Arrays made from one DataFrame object with one index share its rows: operations between them are projections.
        """
        value = F.col(value) if isinstance(value, str) else value
        dtype = dt.of(dtype) if dtype else dt.of_spark(df.select(value.alias("v")).schema["v"].dataType.simpleString())
        size = row_count(df) if size is None else size
        return cls(df, [F.col(index).cast("bigint")], value.cast(dtype.spark), [size], dtype, ("column", index))

    @classmethod
    def from_rows(cls, df: DataFrame, value: str, index: str, width: int, dtype: DType | str | None = None, size: int | None = None) -> NDArray:
        """A two-dimensional array: each row of a table holds a row of the array."""
        kind = df.schema[value].dataType.elementType.simpleString()
        dtype = dt.of(dtype) if dtype else dt.of_spark(kind)
        size = row_count(df) if size is None else size
        base = df.select(F.col(index).cast("bigint").alias("i0"), F.posexplode(value).alias("i1", "v"))
        out = cls(base, [F.col("i0"), F.col("i1").cast("bigint")], F.col("v").cast(dtype.spark), [size, width], dtype)
        out.row_form = (df, F.col(index).cast("bigint"), F.col(value))
        return out

    def _like(self, value: Column, dtype: DType) -> NDArray:
        """Same rows, another value."""
        return NDArray(self.base, self.indices, value.cast(dtype.spark) if dtype.is_complex else value, self.shape, dtype, self.tag)

    def _frame(self, df: DataFrame, shape: Sequence[int], dtype: DType | None = None) -> NDArray:
        """From a frame with i0 …, v."""
        return NDArray(df, [F.col(n) for n in index_names(len(shape))], F.col("v"), shape, dtype or self.dtype)

    # ---- introspection ----------------------------------------------------------------

    @cached_property
    def df(self) -> DataFrame:
        """(i0 …, v)."""
        return self.base.select(*[c.alias(n) for c, n in zip(self.indices, index_names(self.ndim))], self.value.alias("v"))

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def ndim(self) -> int:
        return len(self.shape)

    rank = ndim

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    length = total = size

    @property
    def byte_size(self) -> int:
        return math.ceil(self.size * self.dtype.byte_size)

    def is_empty(self) -> bool:
        return self.size == 0

    @property
    def strides(self) -> list[int]:
        return [math.prod(self.shape[k + 1 :]) for k in range(self.ndim)]

    def flat(self) -> Column:
        """Row-major position, as an expression over the base."""
        terms = [c * F.lit(s) if s != 1 else c for c, s in zip(self.indices, self.strides)]
        return sum(terms[1:], terms[0]).cast("bigint") if terms else F.lit(0).cast("bigint")

    def to_list(self) -> list | object:
        """Nested lists; brings all elements to the driver."""
        rows = [r["v"] for r in self.base.select(self.flat().alias("f"), self.value.alias("v")).orderBy("f").collect()]
        if self.dtype.is_complex:
            rows = [complex(x["re"], x["im"]) for x in rows]
        for n in reversed(self.shape[1:]):
            rows = [rows[i : i + n] for i in range(0, len(rows), n)] if n else []
        return rows if self.shape else rows[0]

    def item(self) -> object:
        """The only element."""
        if self.size != 1:
            raise CastError(f"an array of {self.size} elements is no scalar")
        x = self.base.select(self.value.alias("v")).first()["v"]
        return complex(x["re"], x["im"]) if self.dtype.is_complex else x

    def __int__(self) -> int:
        return int(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __complex__(self) -> complex:
        return complex(self.item())

    def __repr__(self) -> str:
        return f"NDArray({self.dtype}, shape={list(self.shape)})"

    def format(self, pattern: str = "%s") -> DataFrame:
        """(i0 …, text)."""
        return self.df.select(*index_names(self.ndim), F.format_string(pattern, "v").alias("text"))

    def format_to_list(self, pattern: str = "%s") -> list[str]:
        return [r["text"] for r in self.format(pattern).orderBy(*index_names(self.ndim)).collect()]

    def inspect(self, rows: int = 20) -> str:
        """Type, shape and the first elements."""
        some = self.df.orderBy(*index_names(self.ndim)).limit(rows).collect()
        return f"{self!r}\n" + "\n".join(f"{list(r)[:-1]}: {r['v']}" for r in some)

    def same_as(self, other: NDArray) -> bool:
        """Equal shape and all elements equal; empty arrays are equal whatever their type."""
        if self.shape != other.shape:
            return False
        return self.size == 0 or bool(self.eq(other).all().item())

    def copy(self) -> NDArray:
        """Arrays never change, so a copy is the array."""
        return self

    def is_contiguous(self) -> bool:
        """Layout is logical: every array is row-major."""
        return True

    is_row_major = is_contiguous

    def is_column_major(self) -> bool:
        return False

    is_fortran_contiguous = is_column_major

    def cache(self) -> NDArray:
        return self._frame(self.df.cache(), self.shape)

    def free(self) -> None:
        self.base.unpersist()

    # ---- conversion -------------------------------------------------------------------

    def cast_to(self, dtype: DType | str) -> NDArray:
        dtype = dt.of(dtype)
        out = self._like(dt.cast(self.value, self.dtype, dtype), dtype)
        if dtype == self.dtype or dtype == dt.DFloat and self.dtype == dt.SFloat:
            out.row_form, out.column_form, out.image_form = self.row_form, self.column_form, self.image_form
        return out

    def fill(self, x: object) -> NDArray:
        return self._like(dt.literal(x, self.dtype), self.dtype)

    def store(self, other: NDArray | object) -> NDArray:
        """This shape and type with the values of ``other``, broadcast; a shorter last axis is filled with zeros."""
        if not isinstance(other, NDArray):
            return self.fill(other)
        if other.ndim == self.ndim and all(a <= b for a, b in zip(other.shape, self.shape)) and other.shape != self.shape and 1 not in other.shape:
            names = index_names(self.ndim)
            joined = self.df.select(*names).join(other.cast_to(self.dtype).df, names, "left")
            return self._frame(joined.withColumn("v", F.coalesce("v", dt.literal(0, self.dtype))), self.shape)
        out = self._paired(other, lambda a, b, t: (b, other.dtype), dtype=other.dtype, upcast=False)
        if out.shape != self.shape:
            raise ShapeError(f"can't store shape {list(other.shape)} in {list(self.shape)}")
        return out.cast_to(self.dtype)

    # ---- elementwise ------------------------------------------------------------------

    def _broadcast_shape(self, other: NDArray) -> tuple[int, ...]:
        n = max(self.ndim, other.ndim)
        a, b = (1,) * (n - self.ndim) + self.shape, (1,) * (n - other.ndim) + other.shape
        if any(x != y and 1 not in (x, y) for x, y in zip(a, b)):
            raise ShapeError(f"{list(self.shape)} can't be broadcast with {list(other.shape)}")
        return tuple(y if x == 1 else x for x, y in zip(a, b))

    def _paired(self, other: NDArray, f: Callable[[Column, Column, DType], tuple], dtype: DType | None = None, upcast: bool = True) -> NDArray | tuple[NDArray, ...]:
        t = dt.upcast(self.dtype, other.dtype) if upcast else self.dtype

        def both(a: Column, b: Column) -> tuple:
            return f(dt.cast(a, self.dtype, t), dt.cast(b, other.dtype, t), t) if upcast else f(a, b, t)

        if self.base is other.base and self.tag == other.tag and self.shape == other.shape:
            value, out = both(self.value, other.value)
            return tuple(self._like(v, out) for v in value) if isinstance(value, tuple) else self._like(value, out)
        shape = self._broadcast_shape(other)
        n = len(shape)
        left = self.df.withColumnsRenamed({f"i{k}": f"x{k + n - self.ndim}" for k in range(self.ndim)} | {"v": "xv"})
        right = other.df.withColumnsRenamed({f"i{k}": f"y{k + n - other.ndim}" for k in range(other.ndim)} | {"v": "yv"})
        on, pick = [], []
        for k, size in enumerate(shape):
            x = k >= n - self.ndim and (self.shape[k - n + self.ndim] == size)
            y = k >= n - other.ndim and (other.shape[k - n + other.ndim] == size)
            if x and y:
                on.append(F.col(f"x{k}") == F.col(f"y{k}"))
            pick.append(F.col(f"x{k}" if x else f"y{k}").alias(f"i{k}"))
        # without a common axis one side is repeated along the other's axes: the smaller is sent around
        joined = left.join(right, on) if on else left.crossJoin(right)
        value, out = both(F.col("xv"), F.col("yv"))
        base = joined.select(*pick, *[v.alias(f"v{j}") for j, v in enumerate(value if isinstance(value, tuple) else (value,))])
        names, tag = [F.col(x) for x in index_names(n)], next(_TAGS)
        made = tuple(NDArray(base, names, F.col(f"v{j}"), shape, out, tag) for j in range(len(value) if isinstance(value, tuple) else 1))
        return made if isinstance(value, tuple) else made[0]

    def _binary(self, other: NDArray | object, f: Callable[[Column, Column, DType], tuple], reflected: bool = False):
        if isinstance(other, NDArray):
            return other._paired(self, f) if reflected else self._paired(other, f)
        t = dt.upcast_scalar(self.dtype, other)
        a, b = dt.cast(self.value, self.dtype, t), dt.literal(other, t)
        value, out = f(b, a, t) if reflected else f(a, b, t)
        return tuple(self._like(v, out) for v in value) if isinstance(value, tuple) else self._like(value, out)

    def _unary(self, f: Callable[[Column, DType], tuple]):
        value, out = f(self.value, self.dtype)
        return tuple(self._like(v, out) for v in value) if isinstance(value, tuple) else self._like(value, out)

    def add(self, other, wrap: bool = False) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.add(a, b, t, wrap))

    def sub(self, other, wrap: bool = False) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.sub(a, b, t, wrap))

    def mul(self, other, wrap: bool = False) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.mul(a, b, t, wrap))

    def div(self, other, wrap: bool = False) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.div(a, b, t, wrap))

    def mod(self, other) -> NDArray:
        return self._binary(other, ew.mod)

    def divmod(self, other) -> tuple[NDArray, NDArray]:
        return self._binary(other, ew.divmod_)

    def pow(self, other, wrap: bool = False) -> NDArray:
        if isinstance(other, NDArray):
            return self._paired(other, lambda a, b, t: ew.power(a, b, t, wrap))
        t = self.dtype if isinstance(other, int) else dt.upcast_scalar(self.dtype, other)
        return self._like(*ew.power(dt.cast(self.value, self.dtype, t), other, t, wrap))

    __add__, __sub__, __mul__, __truediv__, __mod__, __pow__, __divmod__ = add, sub, mul, div, mod, pow, divmod

    def __radd__(self, other) -> NDArray:
        return self._binary(other, ew.add, True)

    def __rsub__(self, other) -> NDArray:
        return self._binary(other, ew.sub, True)

    def __rmul__(self, other) -> NDArray:
        return self._binary(other, ew.mul, True)

    def __rtruediv__(self, other) -> NDArray:
        return self._binary(other, ew.div, True)

    def __rmod__(self, other) -> NDArray:
        return self._binary(other, ew.mod, True)

    def negate(self, wrap: bool = False) -> NDArray:
        return self._unary(lambda a, t: ew.negate(a, t, wrap))

    def abs(self) -> NDArray:
        return self._unary(ew.absolute)

    def square(self, wrap: bool = False) -> NDArray:
        return self._unary(lambda a, t: ew.square(a, t, wrap))

    def reciprocal(self) -> NDArray:
        return self._unary(ew.reciprocal)

    def sign(self) -> NDArray:
        return self._unary(ew.sign)

    def floor(self) -> NDArray:
        return self._unary(lambda a, t: ew.rounding("floor", a, t))

    def ceil(self) -> NDArray:
        return self._unary(lambda a, t: ew.rounding("ceil", a, t))

    def round(self) -> NDArray:
        return self._unary(lambda a, t: ew.rounding("round", a, t))

    def rint(self) -> NDArray:
        return self._unary(lambda a, t: ew.rounding("rint", a, t))

    def trunc(self) -> NDArray:
        return self._unary(lambda a, t: ew.rounding("trunc", a, t))

    def modf(self) -> tuple[NDArray, NDArray]:
        return self._unary(ew.modf)

    def copysign(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: (ieee.copysign(a.cast("double"), b.cast("double")).cast(t.spark), t))

    def clip(self, low=None, high=None) -> NDArray:
        if not isinstance(low, NDArray) and not isinstance(high, NDArray):
            if low is not None and high is not None and low > high:
                raise OperationError("min > max")
            t = self.dtype
            for x in (low, high):
                t = t if x is None else dt.upcast_scalar(t, x)
            lits = [None if x is None else dt.literal(x, t) for x in (low, high)]
            return self._like(*ew.clip(dt.cast(self.value, self.dtype, t), *lits, t))
        out = self if low is None else self._binary(low, lambda a, b, t: ew.clip(a, b, None, t))
        if low is not None and high is not None and bool((NDArray._lift(low, self).gt(high)).any().item()):
            raise OperationError("min > max")
        return out if high is None else out._binary(high, lambda a, b, t: ew.clip(a, None, b, t))

    @staticmethod
    def _lift(x: NDArray | object, like: NDArray) -> NDArray:
        return x if isinstance(x, NDArray) else like._like(dt.literal(x, like.dtype), like.dtype)

    def poly(self, *coefficients) -> NDArray:
        """Sum of coefficients[k] * self**k; coefficients are numbers."""
        t = self.dtype
        for c in coefficients:
            t = dt.upcast_scalar(t, c)
        return self._like(*ew.poly(dt.cast(self.value, self.dtype, t), [dt.literal(c, t) for c in coefficients], t))

    @staticmethod
    def maximum(a: NDArray, b, nan: bool = False) -> NDArray:
        return a._binary(b, lambda x, y, t: ew.extremum("maximum", x, y, t, nan))

    @staticmethod
    def minimum(a: NDArray, b, nan: bool = False) -> NDArray:
        return a._binary(b, lambda x, y, t: ew.extremum("minimum", x, y, t, nan))

    def map(self, f: Callable[[object], object], dtype: DType | str | None = None) -> NDArray:
        """Any Python function of a pandas Series of values (vectorised)."""
        dtype = dt.of(dtype) if dtype else self.dtype
        return self._like(F.pandas_udf(f, dtype.spark)(self.value), dtype)

    def map_with_index(self, f: Callable, dtype: DType | str | None = None) -> NDArray:
        """f(values, i0, …) of pandas Series."""
        dtype = dt.of(dtype) if dtype else self.dtype
        return self._like(F.pandas_udf(f, dtype.spark)(self.value, *self.indices), dtype)

    def each(self) -> Iterator[object]:
        """Values in row-major order, partition by partition."""
        return (r["v"] for r in self.base.select(self.flat().alias("f"), self.value.alias("v")).orderBy("f").toLocalIterator())

    def each_with_index(self) -> Iterator[tuple]:
        return (tuple(r)[::-1] if self.ndim == 1 else (r["v"], *tuple(r)[:-1]) for r in self.df.orderBy(*index_names(self.ndim)).toLocalIterator())

    def rad2deg(self) -> NDArray:
        return self.mul(180 / math.pi)

    def deg2rad(self) -> NDArray:
        return self.mul(math.pi / 180)

    # ---- bits -------------------------------------------------------------------------

    def bit_and(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.bitwise("and", a, b, t))

    def bit_or(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.bitwise("or", a, b, t))

    def bit_xor(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.bitwise("xor", a, b, t))

    def bit_not(self) -> NDArray:
        return self._unary(ew.bit_not)

    def left_shift(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.shift("left", a, b, t))

    def right_shift(self, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.shift("right", a, b, t))

    __and__, __or__, __xor__, __invert__, __lshift__, __rshift__, __neg__, __abs__ = bit_and, bit_or, bit_xor, bit_not, left_shift, right_shift, negate, abs

    # ---- comparison -------------------------------------------------------------------

    def _compare(self, name: str, other) -> NDArray:
        return self._binary(other, lambda a, b, t: ew.compare(name, a, b, t))

    def eq(self, other) -> NDArray:
        return self._compare("eq", other)

    def ne(self, other) -> NDArray:
        return self._compare("ne", other)

    def gt(self, other) -> NDArray:
        return self._compare("gt", other)

    def ge(self, other) -> NDArray:
        return self._compare("ge", other)

    def lt(self, other) -> NDArray:
        return self._compare("lt", other)

    def le(self, other) -> NDArray:
        return self._compare("le", other)

    def nearly_eq(self, other) -> NDArray:
        return self._compare("nearly_eq", other)

    close_to = nearly_eq
    __gt__, __ge__, __lt__, __le__ = gt, ge, lt, le

    def _predicate(self, name: str) -> NDArray:
        return self._unary(lambda a, t: ew.predicate(name, a, t))

    def isnan(self) -> NDArray:
        return self._predicate("isnan")

    def isinf(self) -> NDArray:
        return self._predicate("isinf")

    def isposinf(self) -> NDArray:
        return self._predicate("isposinf")

    def isneginf(self) -> NDArray:
        return self._predicate("isneginf")

    def isfinite(self) -> NDArray:
        return self._predicate("isfinite")

    def signbit(self) -> NDArray:
        return self._predicate("signbit")

    # ---- complex ----------------------------------------------------------------------

    def real(self) -> NDArray:
        return self._like(self.value["re"], self.dtype.real) if self.dtype.is_complex else self

    def imag(self) -> NDArray:
        return self._like(self.value["im"], self.dtype.real) if self.dtype.is_complex else self.fill(0)

    def conj(self) -> NDArray:
        return self._like(cx.conj(self.value), self.dtype) if self.dtype.is_complex else self

    conjugate = conj

    def im(self) -> NDArray:
        """Times i; a real array is returned as it is."""
        return self._like(cx.times_i(self.value), self.dtype) if self.dtype.is_complex else self

    def arg(self) -> NDArray:
        if not self.dtype.is_complex:
            raise OperationError("arg is defined for complex arrays")
        return self._like(cx.arg(self.value).cast(self.dtype.real.spark), self.dtype.real)

    angle = arg

    def set_real(self, other) -> NDArray:
        return self._set_part("re", other)

    def set_imag(self, other) -> NDArray:
        return self._set_part("im", other)

    def _set_part(self, part: str, other) -> NDArray:
        if not self.dtype.is_complex:
            raise OperationError("only complex arrays have parts to set")
        kind = self.dtype.real.spark
        if isinstance(other, NDArray):
            return self._paired(other, lambda a, b, t: (a.withField(part, b.cast(kind)), t), upcast=False)
        return self._like(self.value.withField(part, F.lit(other).cast(kind)), self.dtype)

    # ---- mathematics ------------------------------------------------------------------

    def math(self, name: str, other=None) -> NDArray:
        """A function of ``ndspark.functions.nmath`` by name."""
        if name == "frexp":
            return (self._like((x := nmath.frexp(self.value, self.dtype))[0][0], x[1]), self._like(x[0][1], dt.Int32))
        if other is None:
            if name not in nmath.UNARY:
                raise OperationError(f"no function {name}")
            return self._unary(lambda a, t: nmath.unary(name, a, t))
        return self._binary(other, lambda a, b, t: nmath.binary(name, a, b, t))
