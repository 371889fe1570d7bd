"""Exact sums against fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ndspark.functions.exact import exact_sum
from ndspark.sources.create import array

TINY, HUGE = 5e-324, 1.7976931348623157e308


def cases():
    r = random.Random(3)
    yield [0.1] * 10
    yield [1e16, 1.0, -1e16]
    yield [1.0, 2.0**-53]
    yield [1.0, 2.0**-53, TINY]
    yield [1.0, -(2.0**-54)]
    yield [1.0 + 2.0**-52, 2.0**-53]
    yield [TINY, TINY, -3 * TINY]
    yield [2.0**-1022, -TINY]
    yield [HUGE, 2.0**969, -(2.0**969)]
    yield [HUGE, HUGE, -HUGE]
    yield [0.0, -0.0]
    yield [-1.5]
    yield [2.0**k for k in range(-1074, 1023, 31)]
    yield [-(2.0**k) for k in range(-1074, 1023, 7)]
    for scale in (3, 40, 300):
        for _ in range(8):
            x = [r.choice([-1, 1]) * r.random() * 2.0 ** r.randint(-scale, scale) for _ in range(r.randrange(1, 60))]
            yield x + [-v for v in x[: r.randrange(len(x) + 1)]]


def test_sums_are_rounded_once(spark):
    data = list(cases())
    rows = [(g, x) for g, xs in enumerate(data) for x in xs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g bigint, x double")
    for parts in (1, 4, 16):
        found = {r["g"]: r["s"] for r in exact_sum(df.repartition(parts), ["g"], "x", "s", 10**6).collect()}
        assert [found[g] for g in range(len(data))] == [float(sum(map(Fraction, xs))) for xs in data]
    wide = {r["g"]: r["s"] for r in exact_sum(df, ["g"], "x", "s", 1 << 40).collect()}
    assert wide == found


def test_odd_values(spark):
    inf, nan = math.inf, math.nan
    for xs, want in (([1.0, nan], nan), ([inf, 1.0, HUGE], inf), ([-inf, 3.0], -inf), ([inf, -inf], nan), ([HUGE, HUGE], inf)):
        got = array(spark, xs).kahan_sum().item()
        assert got == want or math.isnan(got) and math.isnan(want)
    x = array(spark, [[1e100, 1.0, -1e100], [nan, 2.0, 0.25]])
    assert x.kahan_sum(axis=1, nan=True).to_list() == [1.0, 2.25]
    assert array(spark, [nan]).kahan_sum(nan=True).item() == 0.0
    assert exact_sum(spark.range(0).select(F.lit(1.0).alias("x")), [], "x", "s", 5).collect()[0]["s"] == 0.0


def test_no_python(spark):
    plan = array(spark, [0.1] * 50).kahan_sum().df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "partial_sum" in plan
    with pytest.raises(Exception, match="double"):
        array(spark, [1]).kahan_sum()
