"""Arrays from shapes, sequences, literals and text."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray, index_names
from ndspark.dtypes import DType
from ndspark.errors import CastError, DimensionError, ShapeError, ValueRangeError


def _shape(shape: int | Sequence[int]) -> list[int]:
    shape = [shape] if isinstance(shape, int) else list(shape)
    if any(n < 0 for n in shape):
        raise ShapeError(f"negative size in {shape}")
    if len(shape) > dt.MAX_DIMENSIONS:
        raise DimensionError(f"at most {dt.MAX_DIMENSIONS} dimensions")
    return shape


def new(spark: SparkSession, shape: int | Sequence[int], dtype: DType | str, value=None) -> NDArray:
    """An array over row-major positions; value(flat) gives the elements, zeros by default."""
    shape, dtype = _shape(shape), dt.of(dtype)
    base = spark.range(math.prod(shape))
    indices = []
    for k, n in enumerate(shape):
        stride = math.prod(shape[k + 1 :])
        c = F.call_function("div", F.col("id"), F.lit(stride).cast("bigint")) if stride > 1 else F.col("id")
        indices.append(c % F.lit(n) if k and n else c)
    return NDArray(base, indices, dt.literal(0, dtype) if value is None else value(F.col("id")), shape, dtype)


def zeros(spark: SparkSession, shape, dtype="DFloat") -> NDArray:
    return new(spark, shape, dtype)


def ones(spark: SparkSession, shape, dtype="DFloat") -> NDArray:
    return zeros(spark, shape, dtype).fill(1)


def full(spark: SparkSession, shape, x: object, dtype="DFloat") -> NDArray:
    return zeros(spark, shape, dtype).fill(x)


def new_like(a: NDArray, x: object = 0) -> NDArray:
    """Shape and type of ``a``, filled with ``x``."""
    return a.fill(x)


def seq(spark: SparkSession, shape, begin: float = 0, step: float = 1, dtype="DFloat") -> NDArray:
    """begin + step * position; integers are computed in double precision, then wrapped."""
    dtype = dt.of(dtype)
    return new(spark, shape, dtype, lambda i: dt.cast(F.lit(float(begin)) + F.lit(float(step)) * i, dt.DFloat, dtype))


indgen = seq


def logseq(spark: SparkSession, shape, begin: float, step: float, base: float = 10, dtype="DFloat") -> NDArray:
    dtype = dt.of(dtype)
    return new(spark, shape, dtype, lambda i: F.pow(F.lit(float(base)), F.lit(float(begin)) + F.lit(float(step)) * i).cast(dtype.spark))


def linspace(spark: SparkSession, a: float, b: float, n: int = 100, dtype="DFloat") -> NDArray:
    return seq(spark, n, a, (b - a) / (n - 1) if n > 1 else 0.0, dtype)


def logspace(spark: SparkSession, a: float, b: float, n: int = 50, base: float = 10, dtype="DFloat") -> NDArray:
    return logseq(spark, n, a, (b - a) / (n - 1) if n > 1 else 0.0, base, dtype)


def step_range(spark: SparkSession, begin: float, end: float, step: float = 1, exclude_end: bool = False, dtype=None) -> NDArray:
    """begin, begin + step, … up to end, with slack for rounding of the number of steps."""
    if step == 0:
        raise ValueRangeError("step is 0")
    whole = all(isinstance(x, int) for x in (begin, end, step))
    n = (end - begin) / step
    slack = 0.0 if whole else (abs(begin) + abs(end) + abs(end - begin)) / abs(step) * 2.0**-52
    slack = min(slack, 0.5)
    if exclude_end:
        size = 0 if n <= 0 else (1 if n < 1 else math.floor(n - slack) + 1)
    else:
        size = 0 if n < 0 else math.floor(n + slack) + 1
    return seq(spark, size, begin, step, dtype or ("Int32" if whole else "DFloat"))


def eye(spark: SparkSession, n: int, m: int | None = None, dtype="DFloat", element: object = 1, offset: int = 0) -> NDArray:
    """``element`` on a diagonal of the last two axes."""
    m = n if m is None else m
    if not -n < offset < m:
        raise ValueRangeError(f"offset {offset} is outside {n} x {m}")
    z = zeros(spark, [n, m], dtype)
    return z._like(F.when(z.indices[1] == z.indices[0] + F.lit(offset), dt.literal(element, z.dtype)).otherwise(dt.literal(0, z.dtype)), z.dtype)


# ---- literals -----------------------------------------------------------------------------


def array_shape(data: object) -> list[int]:
    """Shape of nested lists: the longest at each level."""
    if isinstance(data, range):
        return [len(data)]
    if not isinstance(data, (list, tuple)):
        return []
    inner = [array_shape(x) for x in data]
    deepest = max((len(s) for s in inner), default=0)
    if any(len(s) not in (0, deepest) for s in inner) or deepest and any(not s for s in inner):
        raise ShapeError("scalars and lists are mixed")
    return [len(data), *(max((s[k] for s in inner), default=0) for k in range(deepest))]


def _leaves(data: object):
    if isinstance(data, (list, tuple, range)):
        for x in data:
            yield from _leaves(x)
    else:
        yield data


def array_type(data: object) -> DType:
    """Common type of all literals; of an empty list Int32."""
    kinds = list({dt.of_scalar(x) for x in _leaves(data)})
    if not kinds:
        return dt.Int32
    if any(x is None for x in _leaves(data)) and any(k.is_float for k in kinds):
        kinds = [k for k in kinds if k.kind != "b"]
    return reduce(dt.upcast, sorted(kinds, key=lambda k: "biufc".index(k.kind)))


def array(spark: SparkSession, data: object, dtype: DType | str | None = None) -> NDArray:
    """From nested lists; shorter rows are filled with zeros."""
    if isinstance(data, NDArray):
        return data if dtype is None else data.cast_to(dtype)
    inferred = array_type(data)
    t = dt.of(dtype) if dtype else inferred
    shape = array_shape(data)
    rows: list[tuple] = []

    def walk(x: object, at: tuple[int, ...]) -> None:
        if len(at) == len(shape):
            rows.append((*at, x))
            return
        for k in range(shape[len(at)]):
            walk(x[k] if k < len(x) else [0] * 0 if len(at) + 1 < len(shape) else 0, (*at, k))

    walk(list(data) if isinstance(data, range) else data, ())
    source = inferred if inferred.kind != "b" or not t.is_float else dt.DFloat

    def stored(x: object) -> object:
        if source.is_complex:
            z = complex(0 if x is None else x)
            return (z.real, z.imag)
        if x is None:
            return math.nan if source.is_float or t.is_float else False
        return float(x) if source.is_float else bool(x) if source.kind == "b" else int(x)

    names = index_names(len(shape))
    schema = ", ".join([*(f"{n} bigint" for n in names), f"v {source.spark}"])
    df = spark.createDataFrame([(*r[:-1], stored(r[-1])) for r in rows], schema)
    out = NDArray(df, [F.col(n) for n in names], F.col("v"), shape, source)
    return out.cast_to(t)


_NUMBER = re.compile(r"[+-]?(?:\d+(?:_\d+)*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
_COMPLEX = re.compile(r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)?([+-]?\d*(?:\.\d+)?(?:[eE][+-]?\d+)?)i$")


def _token(s: str) -> object:
    words = {"true": True, "false": False, "nil": None}
    if s in words:
        return words[s]
    if _NUMBER.match(s):
        s = s.replace("_", "")
        return float(s) if re.search(r"[.eE]", s) else int(s)
    if m := _COMPLEX.match(s):
        im = m[2] if m[2] not in ("", "+", "-") else f"{m[2]}1"
        return complex(float(m[1] or 0), float(im))
    raise ValueRangeError(f"{s!r} is no number")


def parse(spark: SparkSession, text: str, dtype: DType | str | None = None) -> NDArray:
    """White space separates elements, ``;`` or a line break rows, a blank line planes; literals only."""
    planes = []
    for plane in re.split(r"\n[ \t]*\n", text.strip()):
        rows = [[_token(x) for x in re.split(r"[\s,]+", row.strip()) if x] for row in re.split(r"[;\n]", plane) if row.strip()]
        planes.append(rows)
    data = planes if len(planes) > 1 else planes[0] if len(planes[0]) > 1 else planes[0][0] if planes[0] else []
    return array(spark, data, dtype)


def cast(spark: SparkSession, data: object, dtype: DType | str | None = None) -> NDArray:
    """Anything with a meaning as an array: an array, nested lists, a number, a NumPy array."""
    if isinstance(data, NDArray) or isinstance(data, (list, tuple, range, bool, int, float, complex)) or data is None:
        return array(spark, data, dtype)
    if hasattr(data, "tolist"):
        return array(spark, data.tolist(), dtype)
    raise CastError(f"no array from {type(data).__name__}")
