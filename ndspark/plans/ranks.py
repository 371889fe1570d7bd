"""Elements of given ranks, by group, without a sort of all rows.

Quantile summaries (mergeable, of bounded size) give each group splitters; those around the wanted
ranks bracket them with a known error. Rows below, inside and above the bracket are then counted in one pass with partial
aggregation, equal values inside as one, so that only the distinct values of the bracket are ordered. Large
groups are bracketed several times, each time within the bracket before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Splitters of a summary, its accuracy (rank errors are below 1 / ACCURACY of the rows), rows of a group that are ordered without a bracket.
SPLITTERS, ACCURACY, DIRECT = 256, 10_000, 1 << 18
#: Groups whose brackets are sent to all tasks.
SMALL = 100_000


def _joined(rows: DataFrame, keys: list[str], states: DataFrame, groups: int) -> DataFrame:
    """Each row with the state of its group."""
    if not keys:
        return rows.crossJoin(F.broadcast(states))  # a single row
    return rows.join(F.broadcast(states) if groups <= SMALL else states, keys)


def at_ranks(df: DataFrame, keys: list[str], ranks: dict[str, Column], most: int, groups: int, direct: int = DIRECT) -> DataFrame:
    """(keys, n, one column a rank) from rows (keys, v): the elements of 0-based ranks, which are expressions of n, in ascending order.

    most: no group has more rows; groups: there are no more groups. Equal values keep their type, NaN is the largest;
    groups without rows are absent (n = 0 and nulls without keys).
    """
    rows = df.select(*keys, "v", F.col("v").cast("double").alias("d"))
    first, last = F.least(*ranks.values()) if len(ranks) > 1 else next(iter(ranks.values())), F.greatest(*ranks.values()) if len(ranks) > 1 else next(iter(ranks.values()))
    rounds = 0 if most <= direct else max(1, math.ceil(math.log(most / direct) / math.log(SPLITTERS / 4)))
    states = None
    for _ in range(rounds):
        inside, below = F.lit(True), F.lit(0).cast("bigint")
        seen = rows
        if states is not None:
            seen = _joined(rows, keys, states, groups)
            inside, below = F.col("d").between(F.col("lo"), F.col("hi")), F.count_if(F.col("d") < F.col("lo"))
        points = F.array(*[F.lit(k / SPLITTERS) for k in range(SPLITTERS + 1)])
        summary = F.percentile_approx(F.when(inside, F.col("d")), points, F.lit(ACCURACY))
        found = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), below.alias("below") if states is not None else F.lit(0).cast("bigint").alias("below"), F.count_if(inside).alias("m"), summary.alias("p"))
        margin = 4 / ACCURACY + 1e-9
        low = F.floor(((first - F.col("below")) / F.col("m") - margin) * SPLITTERS)
        high = F.ceil(((last + 1 - F.col("below")) / F.col("m") + margin) * SPLITTERS)
        place = lambda k: F.element_at("p", (F.greatest(F.lit(0), F.least(F.lit(SPLITTERS), k)) + 1).cast("int"))
        # the ends of a summary are exact only about as well as its inner points
        lo = F.when(low <= 0, F.lit(float("-inf"))).otherwise(place(low))
        hi = F.when(high >= SPLITTERS, F.lit(float("nan"))).otherwise(place(high))
        states = found.where("n > 0").select(*keys, lo.alias("lo"), hi.alias("hi"))
    side = F.lit(0)
    if states is not None:
        rows = _joined(rows, keys, states, groups)
        side = F.when(F.col("d") < F.col("lo"), -1).when(F.col("d") > F.col("hi"), 1).otherwise(0)
    counts = rows.select(*keys, side.alias("side"), "v").select(*keys, "side", F.when(F.col("side") == 0, F.col("v")).alias("v"))
    counts = counts.groupBy(*keys, "side", "v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy("side", "v")
    placed = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("n", F.sum("c").over(Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    here = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r)
    picked = [F.max(F.when(here(r), F.struct("side", "v"))).alias(name) for name, r in ranks.items()]
    found = placed.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picked)
    lost = F.raise_error(F.lit("a wanted rank lies outside its bracket"))
    return found.select(*keys, "n", *[F.when(F.col(name).isNull() | (F.col(name)["side"] == 0), F.col(name)["v"]).otherwise(lost.cast(df.schema["v"].dataType)).alias(name) for name in ranks])
