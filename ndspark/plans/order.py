"""Global order without a single task: dense row numbers in two passes.

Rows are range-partitioned by the order and sorted within partitions; one aggregate row a
partition then gives every partition's offset. The sorted rows are materialised (reliable
checkpoint), so that both passes see the same partitions also after an executor is lost.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOW = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a temporary one in local mode without any."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ndspark-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted rows with _place: partition number above, row number within it below."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))


def dense_index(df: DataFrame, order: list[Column], name: str = "i0") -> DataFrame:
    """Adds a dense 0-based row number in the given (total) order."""
    placed = _placed(df, order).withColumn("_part", F.shiftrightunsigned("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row a partition: a size bounded by the number of partitions
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit(_LOW))).drop("_place", "_part", "_offset")
