"""A matrix whose columns are columns of one table: reductions over its rows in one pass, without unpivoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray
from ndspark.dtypes import DType
from ndspark.errors import OperationError
from ndspark.functions import aggregates as ag

_REDUCTIONS = {"sum": ag.sum_, "mean": ag.mean, "var": ag.var, "stddev": ag.stddev, "rms": ag.rms, "min": ag.min_, "max": ag.max_, "ptp": ag.ptp}


class ColumnMatrix:
    """[rows, columns] of one element type; rows have no order here."""

    def __init__(self, df: DataFrame, columns: Sequence[str], dtype: DType | str = "DFloat"):
        self.df, self.columns, self.dtype = df, list(columns), dt.of(dtype)

    def reduce(self, name: str, by: Sequence[str] = (), nan: bool = False) -> DataFrame | NDArray:
        """Over the rows: an array [columns]; with ``by`` a frame (by …, i0, v), one reduction a group."""
        if name not in _REDUCTIONS:
            raise OperationError(f"no reduction {name}")
        out = _REDUCTIONS[name](F.col(self.columns[0]).cast(self.dtype.spark), self.dtype, nan)[1]
        values = [_REDUCTIONS[name](F.col(c).cast(self.dtype.spark), self.dtype, nan)[0].alias(f"c{k}") for k, c in enumerate(self.columns)]
        wide = self.df.groupBy(*by).agg(*values) if by else self.df.agg(*values)
        tall = wide.select(*by, F.posexplode(F.array(*[f"c{k}" for k in range(len(self.columns))])).alias("i0", "v"))
        tall = tall.withColumn("i0", F.col("i0").cast("bigint"))
        return tall if by else NDArray(tall, [F.col("i0")], F.col("v"), [len(self.columns)], out)
