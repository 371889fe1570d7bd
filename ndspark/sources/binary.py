"""Binary strings and stored arrays: little-endian packed elements in row-major order."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray, index_names
from ndspark.dtypes import DType
from ndspark.errors import OperationError, ShapeError

#: Elements of one block of a stored array.
BLOCK = 1 << 16


def numpy_type(t: DType) -> np.dtype:
    if t.kind == "b":
        raise OperationError("bits have no byte form")
    return np.dtype(f"<{t.kind}{t.bits // 8}")


def _spark_values(x: np.ndarray, t: DType) -> list:
    if t.is_complex:
        return [(float(z.real), float(z.imag)) for z in x]
    return x.tolist()


def from_binary(spark: SparkSession, data: bytes, shape: Sequence[int] | int | None = None, dtype: DType | str = "DFloat") -> NDArray:
    """From a packed string; too short a string raises, what is over is ignored."""
    t = dt.of(dtype)
    kind = numpy_type(t)
    shape = [len(data) // kind.itemsize] if shape is None else [shape] if isinstance(shape, int) else list(shape)
    n = math.prod(shape)
    if len(data) < n * kind.itemsize:
        raise ShapeError(f"{len(data)} bytes are too few for {shape}")
    blocks = [(i // BLOCK, bytes(data[i * kind.itemsize : min(n, i + BLOCK) * kind.itemsize])) for i in range(0, n, BLOCK)]
    return unpack(spark.createDataFrame(blocks, "block bigint, data binary"), shape, t)


def unpack(blocks: DataFrame, shape: Sequence[int], dtype: DType | str) -> NDArray:
    """From (block, data): block k holds elements k * BLOCK and on."""
    t = dt.of(dtype)
    kind = numpy_type(t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["data"]):
                x = np.frombuffer(data, kind)
                at = np.arange(len(x)) + block * BLOCK
                if t.is_complex:
                    yield pd.DataFrame({"f": at, "re": x.real, "im": x.imag})
                else:
                    yield pd.DataFrame({"f": at, "v": [int(y) for y in x] if t == dt.UInt64 else x})

    if t.is_complex:
        part = t.real.spark
        rows = blocks.mapInPandas(run, f"f bigint, re {part}, im {part}").select("f", F.struct("re", "im").alias("v"))
    elif t == dt.UInt64:
        raise OperationError("UInt64 has no packed form in Arrow; use Int64 and cast")
    else:
        rows = blocks.mapInPandas(run, f"f bigint, v {t.spark}")
    flat = NDArray(rows, [F.col("f")], F.col("v"), [math.prod(shape)], t)
    return flat if len(shape) == 1 or not flat.size else flat.reshape(*shape)


def pack(a: NDArray, swap: bool = False) -> DataFrame:
    """(block, data): the array as packed blocks, each from at most BLOCK elements."""
    kind = numpy_type(a.dtype)
    rows = a.base.select(F.expr("0").alias("zero"), a.flat().alias("f"), a.value.alias("v"))
    block = F.call_function("div", F.col("f"), F.lit(BLOCK).cast("bigint"))
    rows = rows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("x")).select("block", F.col("x.v").alias("x"))
    is_complex = a.dtype.is_complex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["x"]:
                y = np.array([complex(z["re"], z["im"]) for z in x] if is_complex else x).astype(kind)
                out.append((y.byteswap() if swap else y).tobytes())
            yield pd.DataFrame({"block": batch["block"], "data": out})

    return rows.mapInPandas(run, "block bigint, data binary")


def to_binary(a: NDArray, swap: bool = False) -> bytes:
    """The packed string, on the driver; ``swap`` for the other byte order."""
    return b"".join(bytes(r["data"]) for r in pack(a, swap).orderBy("block").collect())


def store_binary(a: NDArray, data: bytes, offset: int = 0) -> NDArray:
    """The shape and type of ``a`` with elements from ``data`` after ``offset`` bytes."""
    return from_binary(a.spark, data[offset:], a.shape, a.dtype)


def swap_byte(data: bytes, dtype: DType | str) -> bytes:
    t = dt.of(dtype)
    width = numpy_type(t.real).itemsize
    return np.frombuffer(data, f"<u{width}").byteswap().tobytes()


def save(a: NDArray, path: str) -> None:
    """As Parquet (indices and values) with shape and type beside it."""
    a.df.write.mode("overwrite").parquet(f"{path}/elements")
    meta = json.dumps({"version": 1, "shape": a.shape, "dtype": a.dtype.name})
    a.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> NDArray:
    """What ``save`` wrote; rejects an unknown version."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("version") != 1:
        raise OperationError("unknown version of a stored array")
    t = dt.of(meta["dtype"])
    df = spark.read.parquet(f"{path}/elements")
    return NDArray(df, [F.col(n) for n in index_names(len(meta["shape"]))], F.col("v"), meta["shape"], t)


def to_network(a: NDArray) -> bytes:
    """Packed in network byte order (big-endian)."""
    return to_binary(a, swap=True)


to_swapped = to_network
to_host = to_vacs = to_binary


def hton(data: bytes, dtype: DType | str) -> bytes:
    """Little-endian elements in network byte order."""
    return swap_byte(data, dtype)


def is_host_order(_: NDArray) -> bool:
    """Elements have no byte order until they are packed."""
    return True
