"""Sums of doubles without rounding, in plain expressions: order-free, with partial aggregation.

A double is a whole number times a power of two. It is cut into three limbs of 32 bits at fixed places
(limb k stands for 2**(32 k - OFFSET)); limbs are whole numbers, so their sums don't depend on order or partitions.
The limbs of a total are carried into digits, and the leading digits are rounded once, to the nearest double (ties to even).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Power of two below every double, a multiple of 32; digits of a total, with room for the sum of 2**60 doubles.
OFFSET, DIGITS = 1152, 72
_BASE = 1 << 32
#: Limb numbers that stand for NaN and the infinities.
NAN, UP, DOWN = -1, -2, -3


def _power(e: Column) -> tuple[Column, Column]:
    """Two factors whose product is 2**e; each is within the range of doubles."""
    half = F.call_function("div", e.cast("bigint"), F.lit(2).cast("bigint"))
    return F.pow(F.lit(2.0), half.cast("double")), F.pow(F.lit(2.0), (e - half).cast("double"))


def limbs(df: DataFrame, value: str) -> DataFrame:
    """Rows with _limbs: an array of (k, part) with sum(part * 2**(32 k - OFFSET)) = value; parts are below 2**33. One projection a step."""
    x = F.col(value)
    # any power between the last bit of the number and 2**62 below its first will do, so the logarithm may err
    real = ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)
    df = df.withColumn("_low", F.when(real, F.floor(F.log2(F.abs(x))) - 53))
    first, second = _power(-F.col("_low"))
    df = df.withColumns({"_whole": (F.abs(x) * first * second).cast("bigint"), "_place": F.col("_low") + OFFSET})
    mask, shift = F.lit(_BASE - 1), (F.col("_place") % 32).cast("int")
    df = df.withColumns({"_k": F.call_function("div", F.col("_place"), F.lit(32).cast("bigint")), "_bottom": F.call_function("shiftleft", F.col("_whole").bitwiseAND(mask), shift), "_top": F.call_function("shiftleft", F.shiftright("_whole", 32), shift)})
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    parts = [F.col("_bottom").bitwiseAND(mask), F.shiftrightunsigned("_bottom", 32) + F.col("_top").bitwiseAND(mask), F.shiftrightunsigned("_top", 32)]
    pieces = F.array(*[F.struct((F.col("_k") + j).cast("int").alias("k"), (p * sign).alias("part")) for j, p in enumerate(parts)])
    special = F.when(F.isnan(x), NAN).when(x == float("inf"), UP).otherwise(DOWN)
    nothing = F.array().cast("array<struct<k:int,part:bigint>>")
    odd = F.array(F.struct(special.cast("int").alias("k"), F.lit(1).cast("bigint").alias("part")))
    return df.withColumn("_limbs", F.when(F.col("_low").isNotNull(), pieces).when(x == 0, nothing).otherwise(odd))


def _digits(at: Column) -> Column:
    """(digits, carry) of a total from its limbs as a map k -> sum: digits below 2**32, the carry is negative where the total is."""
    big = "decimal(38,0)"
    base = F.lit(_BASE).cast(big)

    def step(acc: Column, k: Column) -> Column:
        total = F.coalesce(at[k], F.lit(0).cast(big)) + acc["carry"].cast(big)
        digit = F.pmod(total.cast(big), base)
        carry = F.call_function("div", (total - digit).cast(big), base)
        return F.struct(F.concat(acc["digits"], F.array(digit.cast("bigint"))).alias("digits"), carry.cast("bigint").alias("carry"))

    start = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast("bigint").alias("carry"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DIGITS - 1)), start, step)


def _negated(digits: Column) -> Column:
    """The digits of the number times -1, without the carry."""

    def step(acc: Column, d: Column) -> Column:
        total = -d - acc["borrow"]
        return F.struct(F.concat(acc["digits"], F.array(F.pmod(total, F.lit(_BASE)))).alias("digits"), (total < 0).cast("bigint").alias("borrow"))

    start = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast("bigint").alias("borrow"))
    return F.aggregate(digits, start, step)["digits"]


def _leading(digits: Column) -> Column:
    """(n, place, a, b, c, rest): place of the leading digit, it and the next two, and whether any other is set."""

    def step(acc: Column, d: Column) -> Column:
        n = acc["n"]
        none = (n == 0) & (d == 0)
        return F.struct(
            F.when(none, F.lit(0)).otherwise(n + 1).alias("n"), F.when(none, acc["place"] - 1).otherwise(acc["place"]).alias("place"),
            F.when(n == 0, d).otherwise(acc["a"]).alias("a"), F.when(n == 1, d).otherwise(acc["b"]).alias("b"), F.when(n == 2, d).otherwise(acc["c"]).alias("c"),
            (acc["rest"] | ((n >= 3) & (d > 0))).alias("rest"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(0).alias("n"), F.lit(DIGITS - 1).alias("place"), zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit(False).alias("rest"))
    return F.aggregate(F.reverse(digits), start, step)


def totals(df: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """(keys, out) from limbs as a map k -> sum (decimals): 55 leading bits, the last of which is set if anything follows, are converted and scaled."""
    df = df.withColumn("_sum", _digits(F.col(at)))
    df = df.withColumn("_less", F.col("_sum.carry") < 0)
    df = df.withColumn("_lead", _leading(F.when(F.col("_less"), _negated(F.col("_sum.digits"))).otherwise(F.col("_sum.digits"))))
    df = df.select(*keys, at, "_less", "_lead.*").withColumns({"bits": F.length(F.bin("a")), "high": F.shiftleft("a", 32).bitwiseOR(F.col("b"))})
    df = df.withColumns({"down": F.greatest(F.col("bits") - 23, F.lit(0)), "up": F.greatest(F.lit(23) - F.col("bits"), F.lit(0))})
    one, high, c = F.lit(1).cast("bigint"), F.col("high"), F.col("c")

    def low(n: Column) -> Column:
        return F.call_function("shiftleft", one, n) - 1

    enough, lost = F.call_function("shiftrightunsigned", high, F.col("down")), high.bitwiseAND(low(F.col("down"))) > 0
    more = F.call_function("shiftleft", high, F.col("up")).bitwiseOR(F.call_function("shiftrightunsigned", c, F.lit(32) - F.col("up")))
    missed = c.bitwiseAND(low(F.lit(32) - F.col("up"))) > 0
    full = F.col("bits") >= 23
    sticky = F.when(full, lost | (c > 0)).otherwise(missed) | F.col("rest")
    df = df.withColumns({"bits55": F.when(full, enough).otherwise(more).bitwiseOR(sticky.cast("bigint")), "e": (F.col("place") - 1) * 32 + F.col("bits") - 23 - OFFSET})
    first, second = _power(F.col("e"))
    size = F.when(F.col("a") == 0, F.lit(0.0)).otherwise(F.col("bits55").cast("double") * first * second)
    up, down = (F.coalesce(F.col(at)[F.lit(k)], F.lit(0)) > 0 for k in (UP, DOWN))
    odd = (F.coalesce(F.col(at)[F.lit(NAN)], F.lit(0)) > 0) | (up & down)
    value = F.when(odd, F.lit(float("nan"))).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf"))).when(F.col("_less"), -size).otherwise(size)
    return df.select(*keys, value.alias(out))


def exact_sum(df: DataFrame, keys: list[str], value: str, out: str, most: int) -> DataFrame:
    """(keys, out): sums by group, each rounded once; 0 without keys and rows. most: there are no more rows."""
    kind = "bigint" if most < 1 << 29 else "decimal(11,0)"  # sums of parts fit a bigint up to 2**30 rows
    parts = limbs(df.select(*keys, value), value).select(*keys, F.explode_outer("_limbs").alias("limb"))
    parts = parts.select(*keys, F.col("limb.k").alias("_k"), F.col("limb.part").cast(kind).alias("_part"))
    sums = parts.groupBy(*keys, "_k").agg(F.sum("_part").alias("_part"))
    pairs = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", F.col("_part").cast("decimal(38,0)").alias("_part"))))
    return totals(sums.groupBy(*keys).agg(F.map_from_entries(pairs).alias("_at")), keys, "_at", out)
