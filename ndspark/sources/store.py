"""Stored arrays on a chunk grid: a slice reads only the folders of its chunks.

Elements are Parquet rows (i0 …, v) in folders named by chunk index along each axis (c0=…/c1=…), in
row-major order of the chunk within files, so that row groups are skipped as well. Shape, type and grid lie beside them as JSON,
written last. A chunk is any number of files, since the writer splits it by range.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray, index_names
from ndspark.errors import DimensionError, OperationError, ShapeError

#: Folders of an array at most; the default grid has about as many as this root.
MOST_CHUNKS, USUAL_CHUNKS = 10_000, 256
VERSION = 2


def default_chunks(shape: Sequence[int]) -> list[int]:
    """Edges that halve the longest axis again and again, up to about USUAL_CHUNKS chunks of no fewer than 1,024 elements."""
    edges = [max(1, n) for n in shape]
    while math.prod(-(-n // e) for n, e in zip(shape, edges)) * 2 <= USUAL_CHUNKS and math.prod(edges) >= 2048:
        k = max(range(len(edges)), key=lambda j: edges[j])
        edges[k] = -(-edges[k] // 2)
    return edges


def save(a: NDArray, path: str, chunks: Sequence[int] | None = None) -> None:
    """Writes the array, with chunks of the given edges; what was stored there is replaced."""
    if not a.ndim:
        raise DimensionError("a scalar has no chunks")
    edges = default_chunks(a.shape) if chunks is None else [int(e) for e in chunks]
    if len(edges) != a.ndim or min(edges) < 1:
        raise DimensionError(f"{edges} are no chunk edges of {list(a.shape)}")
    if (count := math.prod(-(-n // e) for n, e in zip(a.shape, edges))) > MOST_CHUNKS:
        raise ShapeError(f"{count} chunks; take larger ones")
    names, grid = index_names(a.ndim), [f"c{k}" for k in range(a.ndim)]
    rows = a.df.withColumns({c: F.call_function("div", F.col(i), F.lit(e).cast("bigint")) for c, i, e in zip(grid, names, edges)})
    parts = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *grid, *names).sortWithinPartitions(*grid, *names)
    rows.write.mode("overwrite").partitionBy(*grid).parquet(f"{path}/elements")
    meta = json.dumps({"version": VERSION, "shape": a.shape, "dtype": a.dtype.name, "chunks": edges})
    a.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> NDArray:
    """What ``save`` wrote. Indexing by positions, slices and lists adds the chunks that they touch to the filters."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("version") != VERSION:
        raise OperationError("unknown version of a stored array")
    t, shape, edges = dt.of(meta["dtype"]), meta["shape"], meta["chunks"]
    names, grid = index_names(len(shape)), [f"c{k}" for k in range(len(shape))]
    schema = ", ".join([*[f"{n} bigint" for n in names], f"v {t.spark}", *[f"{c} bigint" for c in grid]])
    df = spark.read.schema(schema).parquet(f"{path}/elements") if math.prod(shape) else spark.createDataFrame([], schema)
    out = NDArray(df, [F.col(n) for n in names], F.col("v"), shape, t)
    out.chunks = list(zip(grid, edges))
    return out
