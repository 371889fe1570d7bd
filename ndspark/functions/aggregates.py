"""Reductions as aggregate expressions, with the NaN policy of each.

By default sums, means and spreads pass NaN on, while extrema skip it; ``nan=True`` is the other
way round. Every expression has a partial and a final step, so Spark combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.dtypes import DType
from ndspark.errors import OperationError
from ndspark.functions import complexes as cx
from ndspark.functions import ieee



def nan_value() -> Column:
    return F.lit(float("nan"))


def _floats_only(name: str, t: DType) -> None:
    if not (t.is_float or t.is_complex):
        raise OperationError(f"{name} isn't defined for {t}")


def _complex_nan(v: Column) -> Column:
    return F.isnan(v["re"]) | F.isnan(v["im"])


def sum_(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    """Integers widen to 64 bits and are checked; with ``nan`` an all-NaN sum is 0."""
    out = t.sum_type
    if t.is_complex:
        keep = F.when(~_complex_nan(v), v) if nan else v
        return cx.make(F.coalesce(F.sum(keep["re"]), F.lit(0.0)), F.coalesce(F.sum(keep["im"]), F.lit(0.0)), out), out
    if t.kind == "b":
        return F.count_if(v).cast(out.spark), out
    if t.is_int:
        return F.sum(v.cast("bigint" if t.kind == "i" else "decimal(20,0)")).cast(out.spark), out
    return F.coalesce(F.sum((ieee.without_nan(v) if nan else v).cast("double")), F.lit(0.0)).cast(out.spark), out


def mean(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    _floats_only("mean", t)
    if t.is_complex:
        keep = F.when(~_complex_nan(v), v) if nan else v
        return cx.make(F.coalesce(F.avg(keep["re"]), nan_value()), F.coalesce(F.avg(keep["im"]), nan_value()), t), t
    return F.coalesce(F.avg((ieee.without_nan(v) if nan else v).cast("double")), nan_value()).cast(t.spark), t


def var(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    """Sample variance: NaN for one element; with ``nan``, 0 if all are NaN."""
    _floats_only("var", t)
    if t.is_complex:
        keep = F.when(~_complex_nan(v), v) if nan else v
        return F.coalesce(F.var_samp(keep["re"]) + F.var_samp(keep["im"]), nan_value()).cast(t.real.spark), t.real
    x = (ieee.without_nan(v) if nan else v).cast("double")
    spread = F.when(F.count(x) == 1, nan_value()).otherwise(F.var_samp(F.when(x == x, x)))
    return F.coalesce(spread, F.lit(0.0)).cast(t.spark), t


def stddev(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    c, out = var(v, t, nan)
    return F.sqrt(c.cast("double")).cast(out.spark), out


def rms(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    _floats_only("rms", t)
    if t.is_complex:
        square = v["re"] * v["re"] + v["im"] * v["im"]
        return F.sqrt(F.coalesce(F.avg(ieee.without_nan(square) if nan else square), nan_value())).cast(t.real.spark), t.real
    x = v.cast("double")
    x = ieee.without_nan(x) if nan else x
    return F.sqrt(F.coalesce(F.avg(x * x), nan_value())).cast(t.spark), t


def _extreme(f, v: Column, t: DType, nan: bool) -> Column:
    if not t.is_comparable:
        raise OperationError(f"{t} has no order")
    if not t.is_float:
        return f(v)
    best = F.coalesce(f(ieee.without_nan(v)), nan_value().cast(t.spark))
    return F.when(F.bool_or(F.isnan(v)), nan_value().cast(t.spark)).otherwise(best) if nan else best


def min_(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    return _extreme(F.min, v, t, nan), t


def max_(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    return _extreme(F.max, v, t, nan), t


def ptp(v: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    return (max_(v, t, nan)[0] - min_(v, t, nan)[0]).cast(t.spark), t


def index_of(which: str, v: Column, index: Column, t: DType, nan: bool = False) -> tuple[Column, DType]:
    """Index of the extreme element; the earliest on ties. NaN is skipped (all NaN: the first), or wins first with ``nan``."""
    if not t.is_comparable:
        raise OperationError(f"{t} has no order")
    x = v
    if t.is_float:
        x = F.when(v == 0, F.lit(0.0).cast(t.spark)).otherwise(v)
    if which == "max":
        best = F.max_by(index, F.struct(ieee.without_nan(x) if t.is_float else x, -index))
    else:
        best = F.min_by(index, F.when(~F.isnan(x), F.struct(x, index))) if t.is_float else F.min_by(index, F.struct(x, index))
    if t.is_float:
        best = F.coalesce(F.when(F.count_if(~F.isnan(v)) > 0, best), F.min(index))
        if nan:
            best = F.coalesce(F.min(F.when(F.isnan(v), index)), best)
    return best.cast("bigint"), dt.Int64


def median(v: Column, t: DType) -> tuple[Column, DType]:
    """NaN is dropped; the middle two of an even number are averaged, in integer division for integers."""
    if not t.is_comparable:
        raise OperationError(f"{t} has no order")
    if t.is_int:
        p = F.percentile(v.cast("double"), F.lit(0.5))
        return F.call_function("div", (p * 2).cast("bigint"), F.lit(2).cast("bigint")).cast(t.spark), t
    return F.coalesce(F.percentile(ieee.without_nan(v), F.lit(0.5)), nan_value()).cast(t.spark), t


def percentile(v: Column, q: float, t: DType) -> tuple[Column, DType]:
    """Linear interpolation; NaN counts as the largest."""
    out = dt.DFloat if t.is_int else t
    return F.percentile(v, F.lit(q / 100)).cast(out.spark), out


def count_true(v: Column) -> tuple[Column, DType]:
    return F.count_if(v), dt.Int64


def count_false(v: Column) -> tuple[Column, DType]:
    return F.count_if(~v), dt.Int64


def all_(v: Column) -> tuple[Column, DType]:
    """False for no elements."""
    return F.coalesce(F.bool_and(v), F.lit(False)), dt.Bit


def any_(v: Column) -> tuple[Column, DType]:
    return F.coalesce(F.bool_or(v), F.lit(False)), dt.Bit


def none_(v: Column) -> tuple[Column, DType]:
    return ~any_(v)[0], dt.Bit
