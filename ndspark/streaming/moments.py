"""Sums, moments and extremes of a stream of elements: the batch aggregates, which merge across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ndspark.dtypes import DFloat
from ndspark.functions import aggregates as ag


def moments(stream: DataFrame, value: str, keys: list[str], time: str | None = None, window: str = "1 hour", late: str = "1 hour", nan: bool = False, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Count, sum, mean, var, min and max by keys, and by windows of ``time`` if given (late rows up to ``late``).

    Windows tumble, begin every ``slide``, or are sessions that end after a ``gap`` without rows.
    """
    v = F.col(value).cast("double")
    by = [F.col(k) for k in keys]
    if time:
        stream = stream.withWatermark(time, late)
        by.append(F.session_window(time, gap).alias("window") if gap else F.window(time, window, slide))
    kinds = {"sum": ag.sum_, "mean": ag.mean, "var": ag.var, "min": ag.min_, "max": ag.max_}
    out = stream.groupBy(*by).agg(F.count(v).alias("count"), *[f(v, DFloat, nan)[0].alias(name) for name, f in kinds.items()])
    if time:
        out = out.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")
    return out
