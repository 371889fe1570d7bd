"""Record arrays: an array whose elements have named fields, each of an element type with an optional shape."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray, index_names
from ndspark.dtypes import DType
from ndspark.errors import CastError, ShapeError


@dataclass
class RecordType:
    """Fields by name: (element type, shape)."""

    fields: dict[str, tuple[DType, tuple[int, ...]]] = field(default_factory=dict)

    def add(self, name: str, dtype: DType | str, shape: Sequence[int] = ()) -> RecordType:
        if name in self.fields:
            raise CastError(f"field {name} exists")
        self.fields[name] = (dt.of(dtype), tuple(shape))
        return self

    def definition(self, name: str) -> tuple[DType, tuple[int, ...]]:
        if name not in self.fields:
            raise CastError(f"no field {name}")
        return self.fields[name]

    @property
    def spark(self) -> str:
        def kind(t: DType, shape: tuple[int, ...]) -> str:
            return f"array<{kind(t, shape[1:])}>" if shape else t.spark

        return "struct<" + ", ".join(f"{n}: {kind(*x)}" for n, x in self.fields.items()) + ">"

    def array(self, spark: SparkSession, rows: Sequence[Sequence | dict]) -> Records:
        """A one-dimensional record array of tuples or dictionaries."""
        data = [(i, tuple(r[n] for n in self.fields) if isinstance(r, dict) else tuple(r)) for i, r in enumerate(rows)]
        if any(len(r) != len(self.fields) for _, r in data):
            raise ShapeError("a record lacks fields")
        return Records(spark.createDataFrame(data, f"i0 bigint, v {self.spark}"), [len(data)], self)


class Records:
    """A record array: (i0 …, v struct)."""

    def __init__(self, df: DataFrame, shape: Sequence[int], kind: RecordType):
        self.df, self.shape, self.kind = df, list(shape), kind

    def field(self, name: str) -> NDArray:
        """A field as an array; a field's own shape is appended to the shape."""
        t, inner = self.kind.definition(name)
        rows = self.df.select(*index_names(len(self.shape)), F.col("v")[name].alias("v"))
        for k in range(len(inner)):
            at = len(self.shape) + k
            rows = rows.select(*index_names(at), F.posexplode("v").alias("p", "v")).withColumnRenamed("p", f"i{at}")
        return NDArray.from_coo(rows, [*self.shape, *inner], t)

    __getitem__ = field

    def with_field(self, name: str, values: NDArray) -> Records:
        """With a scalar field replaced, cast to the field's type."""
        t, inner = self.kind.definition(name)
        if inner or list(values.shape) != self.shape:
            raise ShapeError("values must have the records' shape")
        names = index_names(len(self.shape))
        new = values.cast_to(t).df.withColumnRenamed("v", "n")
        return Records(self.df.join(new, names).withColumn("v", F.col("v").withField(name, F.col("n"))).drop("n"), self.shape, self.kind)

    def to_list(self) -> list[tuple]:
        return [tuple(r["v"]) for r in self.df.orderBy(*index_names(len(self.shape))).collect()]
