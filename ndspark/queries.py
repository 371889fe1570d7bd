"""Named queries over the standard tables: one for each operator, with SQL that gives the same rows.

Array inputs are written once as SQL that Spark and the oracle both read. Results of floating-point
operations are rounded to 6 places on both sides, since the last bits of sums depend on their order
and those of transcendental functions on the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray
from ndspark.operators import nn
from ndspark.operators.columns import ColumnMatrix
from ndspark.sources import binary, create
from ndspark.streaming.moments import moments

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- inputs -------------------------------------------------------------------------------

EVENTS = "SELECT event_id AS i, value AS x, CAST(event_id % 17 AS DOUBLE) * CAST(0.75 AS DOUBLE) - CAST(6.0 AS DOUBLE) AS y, CAST(user_id AS BIGINT) AS u, value > CAST(50 AS DOUBLE) AS p, event_id % 3 = 0 AS q FROM events"
HOLES = "SELECT event_id AS i, CAST(user_id AS BIGINT) AS u, CASE WHEN event_id % 7 = 3 OR user_id % 10 = 4 THEN CAST('NaN' AS DOUBLE) ELSE value END AS x FROM events"
KEYS = "SELECT o_orderkey AS i, CAST(o_custkey AS BIGINT) AS a, CAST(o_orderkey % 97 + 1 AS BIGINT) AS b, CAST(o_orderkey % 5 AS BIGINT) AS s, o_totalprice AS t FROM orders"
LINES = "SELECT CAST(l_linenumber AS BIGINT) AS i0, l_orderkey AS i1, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t, l_partkey AS p, l_returnflag AS f FROM lineitem"
VECTORS = "SELECT vec_id AS i0, embedding AS r, label FROM embeddings"
#: The error function as a series of positive terms, added up to where they vanish for arguments up to 6.
ERF = "CASE WHEN {0} = 0 THEN 0 ELSE sign({0}) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 240), lambda n: exp(2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2) + (2 * n + 1) * ln(abs({0})) - {0} * {0}))) END"
#: The oracle's view of the vectors by element.
ELEMENTS = "SELECT vec_id AS i0, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i1, label FROM embeddings"
WIDTH = 64


def base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an input, read from a folder of Parquet tables."""
    return spark.sql(re.sub(rf"FROM ({'|'.join(TABLES)})\b", rf"FROM parquet.`{sf_dir}/\1.parquet`", sql))


def column(df: DataFrame, name: str) -> NDArray:
    """A one-dimensional array over the dense key ``i``."""
    return NDArray.from_column(df, name, "i")


def vectors(spark: SparkSession, sf_dir: str, dtype: str = "DFloat") -> NDArray:
    return NDArray.from_rows(base(spark, sf_dir, VECTORS), "r", "i0", WIDTH, "SFloat").cast_to(dtype)


def rounded(a: NDArray) -> DataFrame:
    """(i0 …, v) with 6 places and no negative zero."""
    df = a.df
    return df.withColumn("v", F.round(F.col("v").cast("double"), 6) + F.lit(0.0)) if a.dtype.is_float else df.withColumn("v", F.col("v").cast("boolean" if a.dtype == dt.Bit else "bigint"))


def pair(a: NDArray, b: NDArray) -> DataFrame:
    """(i0 …, v, w) of two arrays over the same rows."""
    r = rounded(b).withColumnRenamed("v", "w")
    if a.base is b.base and a.tag == b.tag:
        both = a.base.select(*[c.alias(f"i{k}") for k, c in enumerate(a.indices)], a.value.alias("v"), b.value.alias("w"))
        for c, t in (("v", a.dtype), ("w", b.dtype)):
            both = both.withColumn(c, F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if t.is_float else F.col(c).cast("bigint"))
        return both
    return rounded(a).join(r, [f"i{k}" for k in range(a.ndim)]) if a.ndim else rounded(a).crossJoin(r)


def R(sql: str) -> str:  # noqa: N802
    return f"round(CAST({sql} AS DOUBLE), 6) + 0.0"


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def over(name: str, source: str, f: Callable[[DataFrame], NDArray], sql: str, rows: str = "base") -> None:
    """A query of one array result over a source; ``sql`` selects from ``base``."""
    register(name, lambda s, d: rounded(f(base(s, d, source))), f"WITH base AS ({source}) {sql if sql.lstrip().upper().startswith(('SELECT', ',')) else f'SELECT i AS i0, {sql} AS v FROM {rows}'}")


# ---- elementwise --------------------------------------------------------------------------


def _elementwise() -> None:
    x, y, a, b = (lambda n: lambda df: column(df, n))("x"), (lambda n: lambda df: column(df, n))("y"), (lambda n: lambda df: column(df, n))("a"), (lambda n: lambda df: column(df, n))("b")
    nan, inf = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
    quotient = f"CASE WHEN y = 0 AND x = 0 THEN {nan} WHEN y = 0 THEN sign(x) * {inf} ELSE x / y END"
    binary_ = {
        "add": (lambda p, q: p + q, "x + y"), "sub": (lambda p, q: p - q, "x - y"), "mul": (lambda p, q: p * q, "x * y"),
        "div": (lambda p, q: p / q, quotient), "mod": (lambda p, q: p % q, f"CASE WHEN y = 0 THEN {nan} ELSE x - y * trunc(x / y) END"),
        "copysign": (lambda p, q: p.copysign(q), "CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END"),
        "maximum": (NDArray.maximum, "greatest(x, y)"), "minimum": (NDArray.minimum, "least(x, y)"),
        "atan2": (lambda p, q: p.math("atan2", q), "atan2(x, y)"), "hypot": (lambda p, q: p.math("hypot", q), "sqrt(x * x + y * y)"),
    }
    for name, (f, sql) in binary_.items():
        over(f"elementwise_{name}", EVENTS, lambda df, f=f: f(x(df), y(df)), R(sql))
    # exact, so not rounded: halves of the last place would fall either way
    register("elementwise_ldexp", lambda s, d: (lambda df: x(df).math("ldexp", y(df).trunc()).df)(base(s, d, EVENTS)), f"WITH base AS ({EVENTS}) SELECT i AS i0, x * pow(2, trunc(y)) AS v FROM base")
    for name, sql in {"eq": "x = y", "ne": "x <> y", "gt": "x > y", "ge": "x >= y", "lt": "x < y", "le": "x <= y"}.items():
        over(f"compare_{name}", EVENTS, lambda df, n=name: getattr(x(df), n)(y(df)), sql)
    over("compare_nearly_eq", EVENTS, lambda df: x(df).nearly_eq(x(df) * 1.0000000000000002), "abs(x - x * 1.0000000000000002::DOUBLE) <= (abs(x) + abs(x * 1.0000000000000002::DOUBLE)) * 2 * 2.220446049250313e-16")
    unary = {
        "negate": "-y", "abs": "abs(y)", "square": "y * y", "reciprocal": f"CASE WHEN y = 0 THEN {inf} ELSE 1 / y END", "sign": "sign(y)",
        "floor": "floor(y)", "ceil": "ceil(y)", "trunc": "trunc(y)", "round": "CASE WHEN y < 0 THEN -floor(-y + 0.5) ELSE floor(y + 0.5) END", "rint": "round_even(y, 0)",
        "rad2deg": "degrees(y)", "deg2rad": "radians(y)",
    }
    for name, sql in unary.items():
        over(f"elementwise_{name}", EVENTS, lambda df, n=name: getattr(y(df), n)(), R(sql))
    over("elementwise_clip", EVENTS, lambda df: x(df).clip(10.0, 60.0), R("greatest(10.0, least(60.0, x))"))
    over("elementwise_poly", EVENTS, lambda df: y(df).poly(1.0, -2.0, 0.5), R("1 + y * (-2 + y * 0.5)"))
    over("elementwise_pow_int", EVENTS, lambda df: y(df) ** 3, R("y * y * y"))
    over("elementwise_pow_float", EVENTS, lambda df: x(df).abs() ** 0.5, R("pow(abs(x), 0.5)"))
    over("elementwise_scalar", EVENTS, lambda df: (x(df) * 2.0 + 1.0) / 4.0, R("(x * 2 + 1) / 4"))
    over("elementwise_map", EVENTS, lambda df: x(df).map(lambda v: v * 3 - 1), R("x * 3 - 1"))
    over("elementwise_map_with_index", EVENTS, lambda df: x(df).map_with_index(lambda v, i: v + i), R("x + i"))
    register("elementwise_modf", lambda s, d: pair(*y(base(s, d, EVENTS)).modf()), f"WITH base AS ({EVENTS}) SELECT i AS i0, {R('y - trunc(y)')} AS v, {R('trunc(y)')} AS w FROM base")
    # a factor of many digits, since decimals over powers of two lie midway between two rounded mantissas
    register("elementwise_frexp", lambda s, d: pair(*(x(base(s, d, EVENTS)) * 0.7310585786300049).math("frexp")), f"WITH base AS (SELECT i, x * CAST(0.7310585786300049 AS DOUBLE) AS x FROM ({EVENTS})), g AS (SELECT i, x, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) + 1 END AS e FROM base), h AS (SELECT i, x, e + CASE WHEN abs(x) >= pow(2.0, e) THEN 1 WHEN abs(x) < pow(2.0, e - 1) AND x <> 0 THEN -1 ELSE 0 END AS e FROM g) SELECT i AS i0, {R('x / pow(2.0, e)')} AS v, e::BIGINT AS w FROM h")
    for name, sql in {"isnan": "isnan(z)", "isinf": "isinf(z)", "isposinf": f"z = {inf}", "isneginf": f"z = -{inf}", "isfinite": "isfinite(z)"}.items():
        over(f"predicate_{name}", EVENTS, lambda df, n=name: getattr((lambda w: w / w)(y(df)) if n == "isnan" else x(df) / y(df), n)(), f"SELECT i AS i0, {sql} AS v FROM (SELECT i, {quotient if name != 'isnan' else f'CASE WHEN y = 0 THEN {nan} ELSE 1.0 END'} AS z FROM base)")
    over("predicate_signbit", EVENTS, lambda df: y(df).signbit(), "y < 0")
    ints = {
        "add": (lambda p, q: p + q, "a + b"), "sub": (lambda p, q: p - q, "a - b"), "mul": (lambda p, q: p * q, "a * b"), "div": (lambda p, q: p / q, "(a - 700) // b"), "mod": (lambda p, q: p % q, "a % b"),
        "bit_and": (lambda p, q: p & q, "a & b"), "bit_or": (lambda p, q: p | q, "a | b"), "bit_xor": (lambda p, q: p ^ q, "xor(a, b)"),
    }
    for name, (f, sql) in ints.items():
        if name == "div":
            sql = "CASE WHEN a < 700 THEN -((700 - a) // b) ELSE (a - 700) // b END"
            over("integer_div", KEYS, lambda df: (a(df) - 700) / b(df), f"({sql})::BIGINT")
        else:
            over(f"integer_{name}", KEYS, lambda df, f=f: f(a(df), b(df)), f"({sql})::BIGINT")
    over("integer_bit_not", KEYS, lambda df: ~a(df), "(~a)::BIGINT")
    over("integer_left_shift", KEYS, lambda df: a(df) << column(df, "s"), "(a << s)::BIGINT")
    over("integer_right_shift", KEYS, lambda df: a(df) >> column(df, "s"), "(a >> s)::BIGINT")
    over("integer_pow", KEYS, lambda df: b(df) ** 4, "(b * b * b * b)::BIGINT")
    over("integer_pow_negative", KEYS, lambda df: b(df) ** -2, "0::BIGINT")
    over("integer_reciprocal", KEYS, lambda df: b(df).reciprocal(), "CASE WHEN b = 1 THEN 1 ELSE 0 END::BIGINT")
    over("integer_wrap_int8", KEYS, lambda df: a(df).cast_to("Int8").mul(7, wrap=True), "((((((a + 128) % 256 - 128) * 7) + 128) % 256 + 256) % 256 - 128)::BIGINT")
    over("integer_cast_uint8", KEYS, lambda df: (a(df) * -1).cast_to("UInt8"), "((256 - a % 256) % 256)::BIGINT")
    over("promote_int8_uint8", KEYS, lambda df: (b(df).cast_to("Int8") + b(df).cast_to("UInt8")), "(2 * b)::BIGINT")
    register("integer_divmod", lambda s, d: (lambda df: pair(*a(df).divmod(b(df))))(base(s, d, KEYS)), f"WITH base AS ({KEYS}) SELECT i AS i0, (a // b)::BIGINT AS v, (a % b)::BIGINT AS w FROM base")
    functions = {
        "sqrt": ("abs(x)", "sqrt({})"), "cbrt": ("x", "cbrt({})"), "log": ("x", f"CASE WHEN {{0}} = 0 THEN -{inf} WHEN {{0}} < 0 THEN {nan} ELSE ln({{0}}) END"), "log2": ("abs(x)", f"CASE WHEN {{0}} = 0 THEN -{inf} ELSE log2({{0}}) END"),
        "log10": ("abs(x)", f"CASE WHEN {{0}} = 0 THEN -{inf} ELSE log10({{0}}) END"), "log1p": ("abs(x)", "ln(1 + {})"), "exp": ("y", "exp({})"), "exp2": ("y", "pow(2, {})"), "exp10": ("y / 3", "pow(10, {})"), "expm1": ("y", "exp({}) - 1"),
        "sin": ("x", "sin({})"), "cos": ("x", "cos({})"), "tan": ("y", "tan({})"), "asin": ("y / 7", "asin({})"), "acos": ("y / 7", "acos({})"), "atan": ("x", "atan({})"),
        "sinh": ("y", "sinh({})"), "cosh": ("y", "cosh({})"), "tanh": ("y", "tanh({})"), "asinh": ("y", "asinh({})"), "acosh": ("abs(y) + 1", "acosh({})"), "atanh": ("y / 7", "atanh({})"),
        "sinc": ("y", "CASE WHEN {0} = 0 THEN 1 ELSE sin({0}) / {0} END"), "erf": ("y", ERF), "erfc": ("y", f"1 - ({ERF})"),
    }
    inputs = {
        "x": x, "y": y, "abs(x)": lambda df: x(df).abs(), "y / 3": lambda df: y(df) / 3.0, "y / 7": lambda df: y(df) / 7.0, "abs(y) + 1": lambda df: y(df).abs() + 1.0,
    }
    for name, (arg, sql) in functions.items():
        over(f"math_{name}", EVENTS, lambda df, n=name, g=inputs[arg]: g(df).math(n), R(sql.format(f"({arg})")))


# ---- complex and bits ---------------------------------------------------------------------


def _complex() -> None:
    def z(df: DataFrame, re: str = "x", im: str = "y") -> NDArray:
        return NDArray(df, [F.col("i")], F.struct(F.col(re).alias("re"), F.col(im).alias("im")), [1], dt.DComplex, ("z", re, im))

    def parts(f: Callable[[DataFrame], NDArray]) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            a = f(base(s, d, EVENTS))
            return a.df.select("i0", *[(F.round(F.col("v")[p], 6) + F.lit(0.0)).alias(p) for p in ("re", "im")])

        return run

    def sql(re: str, im: str) -> str:
        return f"WITH base AS ({EVENTS}) SELECT i AS i0, {R(re)} AS re, {R(im)} AS im FROM base"

    w = lambda df: NDArray(df, [F.col("i")], F.struct(F.col("y").alias("re"), F.lit(2.0).alias("im")), [1], dt.DComplex, ("z", "x", "y"))
    register("complex_add", parts(lambda df: z(df) + w(df)), sql("x + y", "y + 2"))
    register("complex_sub", parts(lambda df: z(df) - w(df)), sql("x - y", "y - 2"))
    register("complex_mul", parts(lambda df: z(df) * w(df)), sql("x * y - y * 2", "x * 2 + y * y"))
    register("complex_div", parts(lambda df: z(df) / w(df)), sql("(x * y + y * 2) / (y * y + 4)", "(y * y - x * 2) / (y * y + 4)"))
    register("complex_conj", parts(lambda df: z(df).conj()), sql("x", "-y"))
    register("complex_im", parts(lambda df: z(df).im()), sql("-y", "x"))
    register("complex_set_real", parts(lambda df: z(df).set_real(5.0)), sql("5", "y"))
    register("complex_set_imag", parts(lambda df: z(df).set_imag(5.0)), sql("x", "5"))
    register("complex_square", parts(lambda df: z(df) ** 2), sql("x * x - y * y", "2 * x * y"))
    register("complex_exp", parts(lambda df: w(df).math("exp")), sql("exp(y) * cos(2.0)", "exp(y) * sin(2.0)"))
    register("complex_log", parts(lambda df: z(df).math("log")), sql("CASE WHEN x = 0 AND y = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(sqrt(x * x + y * y)) END", "atan2(y, x)"))
    over("complex_abs", EVENTS, lambda df: z(df).abs(), R("sqrt(x * x + y * y)"))
    over("complex_arg", EVENTS, lambda df: z(df).arg(), R("atan2(y, x)"))
    over("complex_real", EVENTS, lambda df: z(df).real(), R("x"))
    over("complex_imag", EVENTS, lambda df: z(df).imag(), R("y"))
    register("complex_sum", lambda s, d: z(base(s, d, EVENTS)).sum().df.select(*[(F.round(F.col("v")[p], 4)).alias(p) for p in ("re", "im")]), f"WITH base AS ({EVENTS}) SELECT round(sum(x), 4) AS re, round(sum(y), 4) AS im FROM base")
    p, q = (lambda df: column(df, "p")), (lambda df: column(df, "q"))
    for name, (f, text) in {"and": (lambda a, b: a & b, "p AND q"), "or": (lambda a, b: a | b, "p OR q"), "xor": (lambda a, b: a ^ b, "p <> q"), "eq": (lambda a, b: a.eq(b), "p = q")}.items():
        over(f"bit_{name}", EVENTS, lambda df, f=f: f(p(df), q(df)), f"({text})")
    over("bit_not", EVENTS, lambda df: ~p(df), "(NOT p)")
    for name, text in {"count_true": "count(*) FILTER (p)::BIGINT", "count_false": "count(*) FILTER (NOT p)::BIGINT", "all": "bool_and(p)", "any": "bool_or(p)", "none": "NOT bool_or(p)"}.items():
        over(f"bit_{name}", EVENTS, lambda df, n=name: getattr(p(df), n)(), f"SELECT {text} AS v FROM base")
    over("bit_where", EVENTS, lambda df: p(df).where(), "SELECT row_number() OVER (ORDER BY i) - 1 AS i0, i AS v FROM base WHERE p")
    over("bit_mask", EVENTS, lambda df: column(df, "x")[p(df)], f"SELECT row_number() OVER (ORDER BY i) - 1 AS i0, {R('x')} AS v FROM base WHERE p")
    register("bit_where2", lambda s, d: (lambda w: rounded(w[0]).withColumn("b", F.lit(True)).unionByName(rounded(w[1]).withColumn("b", F.lit(False))))(p(base(s, d, EVENTS)).where2()), f"WITH base AS ({EVENTS}) SELECT row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i0, i AS v, p AS b FROM base")


# ---- reductions ---------------------------------------------------------------------------


def _reductions() -> None:
    columns = ["q", "e", "d", "t"]
    sums = {"sum": "sum({})", "mean": "avg({})", "var": "var_samp({})", "stddev": "stddev_samp({})", "rms": "sqrt(avg({0} * {0}))", "min": "min({})", "max": "max({})", "ptp": "max({0}) - min({0})"}
    for name, text in sums.items():
        register(f"reduce_{name}_axis0", lambda s, d, n=name: ColumnMatrix(base(s, d, LINES), columns).reduce(n).df.withColumn("v", F.round("v", 3) + F.lit(0.0)),
                 f"WITH base AS ({LINES}), r AS (SELECT {', '.join(f'round({text.format(c)}, 3) + 0.0 AS c{k}' for k, c in enumerate(columns))} FROM base) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS i0, c{k} AS v FROM r" for k in range(4)))
        register(f"reduce_{name}_by_flag", lambda s, d, n=name: ColumnMatrix(base(s, d, LINES), columns).reduce(n, ["f"]).withColumn("v", F.round("v", 3) + F.lit(0.0)),
                 f"WITH base AS ({LINES}), r AS (SELECT f, {', '.join(f'round({text.format(c)}, 3) + 0.0 AS c{k}' for k, c in enumerate(columns))} FROM base GROUP BY f) " + " UNION ALL ".join(f"SELECT f, {k}::BIGINT AS i0, c{k} AS v FROM r" for k in range(4)))
        # rows of vectors: the last axis of a two-dimensional array
        register(f"reduce_{name}_axis1", lambda s, d, n=name: rounded(getattr(vectors(s, d), n)(axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, {R(text.format('v'))} AS v FROM e GROUP BY i0")
    by_user = {"sum": "sum", "mean": "mean", "var": "var", "stddev": "stddev", "rms": "rms", "min": "min", "max": "max", "ptp": "ptp"}
    number, bad = "CASE WHEN NOT isnan(x) THEN x END", "bool_or(isnan(x))"
    nan = "CAST('NaN' AS DOUBLE)"
    # a two-dimensional array [users, events] with holes would not be dense: each user's events are reduced as a group
    grid = lambda df: NDArray(df, [F.col("u"), F.col("i")], F.col("x"), [1, 1], dt.DFloat)
    text = {
        ("sum", False): f"CASE WHEN {bad} THEN {nan} ELSE sum({number}) END", ("sum", True): f"coalesce(sum({number}), 0)",
        ("mean", False): f"CASE WHEN {bad} THEN {nan} ELSE avg({number}) END", ("mean", True): f"coalesce(avg({number}), {nan})",
        ("var", False): f"CASE WHEN {bad} OR count(*) = 1 THEN {nan} ELSE var_samp({number}) END", ("var", True): f"CASE count({number}) WHEN 0 THEN 0 WHEN 1 THEN {nan} ELSE var_samp({number}) END",
        ("stddev", False): f"CASE WHEN {bad} OR count(*) = 1 THEN {nan} ELSE stddev_samp({number}) END", ("stddev", True): f"CASE count({number}) WHEN 0 THEN 0 WHEN 1 THEN {nan} ELSE stddev_samp({number}) END",
        ("rms", False): f"CASE WHEN {bad} THEN {nan} ELSE sqrt(avg(({number}) * ({number}))) END", ("rms", True): f"coalesce(sqrt(avg(({number}) * ({number}))), {nan})",
        ("min", False): f"coalesce(min({number}), {nan})", ("min", True): f"CASE WHEN {bad} THEN {nan} ELSE min({number}) END",
        ("max", False): f"coalesce(max({number}), {nan})", ("max", True): f"CASE WHEN {bad} THEN {nan} ELSE max({number}) END",
        ("ptp", False): f"coalesce(max({number}) - min({number}), {nan})", ("ptp", True): f"CASE WHEN {bad} THEN {nan} ELSE max({number}) - min({number}) END",
    }
    for name in by_user:
        for flag in (False, True):
            over(f"nan_{name}_{'flag' if flag else 'default'}", HOLES, lambda df, n=name, f=flag: getattr(grid(df), n)(axis=1, nan=f), f"SELECT u AS i0, {R(text[name, flag])} AS v FROM base GROUP BY u")
    for name, order in {"argmax": "CASE WHEN isnan(x) THEN 1 ELSE 0 END, x DESC, i", "argmin": "CASE WHEN isnan(x) THEN 1 ELSE 0 END, x, i"}.items():
        over(f"nan_{name}_default", HOLES, lambda df, n=name: getattr(grid(df), n)(axis=1), f"SELECT u AS i0, i AS v FROM (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY {order}) AS k FROM base) WHERE k = 1")
        flagged = order.replace("THEN 1 ELSE 0", "THEN 0 ELSE 1").replace("x DESC", "CASE WHEN isnan(x) THEN 0 ELSE -x END").replace(", x,", ", CASE WHEN isnan(x) THEN 0 ELSE x END,")
        over(f"nan_{name}_flag", HOLES, lambda df, n=name: getattr(grid(df), n)(axis=1, nan=True), f"SELECT u AS i0, i AS v FROM (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY {flagged}) AS k FROM base) WHERE k = 1")
    over("nan_median", HOLES, lambda df: grid(df).median(axis=1), f"SELECT u AS i0, {R(f'coalesce(median({number}), {nan})')} AS v FROM base GROUP BY u")
    register("nan_minmax", lambda s, d: pair(*grid(base(s, d, HOLES)).minmax(axis=1)), f"WITH base AS ({HOLES}) SELECT u AS i0, {R(text['min', False])} AS v, {R(text['max', False])} AS w FROM base GROUP BY u")
    first = "SELECT i0, {} AS v FROM (SELECT i0, i1, row_number() OVER (PARTITION BY i0 ORDER BY v {}, i1) AS k FROM e) WHERE k = 1"
    for name, column_, order in (("argmax", "i1", "DESC"), ("argmin", "i1", "ASC"), ("max_index", f"i0 * {WIDTH} + i1", "DESC"), ("min_index", f"i0 * {WIDTH} + i1", "ASC")):
        register(f"reduce_{name}_axis1", lambda s, d, n=name: rounded(getattr(vectors(s, d), n)(axis=1)), f"WITH e AS ({ELEMENTS}) " + first.format(f"({column_})::BIGINT", order))
    register("reduce_argmax_axis0", lambda s, d: rounded(vectors(s, d).argmax(axis=0)), f"WITH e AS ({ELEMENTS}) SELECT i1::BIGINT AS i0, i0 AS v FROM (SELECT i0, i1, row_number() OVER (PARTITION BY i1 ORDER BY v DESC, i0) AS k FROM e) WHERE k = 1")
    register("reduce_keepdims", lambda s, d: rounded(vectors(s, d).sum(axis=0, keepdims=True)), f"WITH e AS ({ELEMENTS}) SELECT 0::BIGINT AS i0, i1::BIGINT AS i1, {R('sum(v)')} AS v FROM e GROUP BY i1")
    register("reduce_all", lambda s, d: rounded(vectors(s, d).sum()), f"WITH e AS ({ELEMENTS}) SELECT {R('sum(v)')} AS v FROM e")
    register("reduce_median_axis0", lambda s, d: rounded(vectors(s, d).median(axis=0)), f"WITH e AS ({ELEMENTS}) SELECT i1::BIGINT AS i0, {R('median(v)')} AS v FROM e GROUP BY i1")
    register("reduce_percentile", lambda s, d: rounded(vectors(s, d).percentile(90, axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, {R('quantile_cont(v, 0.9)')} AS v FROM e GROUP BY i0")
    over("reduce_percentile_all", EVENTS, lambda df: column(df, "x").percentile(37.5), f"SELECT {R('quantile_cont(x, 0.375)')} AS v FROM base")
    over("reduce_median_all", EVENTS, lambda df: column(df, "x").median(), f"SELECT {R('median(x)')} AS v FROM base")
    over("reduce_median_int", KEYS, lambda df: column(df, "a").median(), "SELECT ((quantile_disc(a, 0.5) + (SELECT min(a) FROM (SELECT a, row_number() OVER (ORDER BY a) AS k, count(*) OVER () AS n FROM base) WHERE k > n // 2)) // 2)::BIGINT AS v FROM base")
    over("reduce_prod", EVENTS, lambda df: (column(df, "y") / 100.0 + 1.0).reshape(None, 10).prod(axis=1), f"SELECT i // 10 AS i0, {R('product(y / 100 + 1)')} AS v FROM base GROUP BY i // 10")
    over("reduce_prod_int", KEYS, lambda df: column(df, "b").reshape(None, 5).prod(axis=1), "SELECT i // 5 AS i0, product(b)::BIGINT AS v FROM base GROUP BY i // 5")
    over("reduce_sum_int", KEYS, lambda df: column(df, "a").sum(), "SELECT sum(a)::BIGINT AS v FROM base")
    over("reduce_kahan_sum", EVENTS, lambda df: column(df, "x").kahan_sum(), f"SELECT {R('kahan_sum(x)')} AS v FROM base")
    over("reduce_mulsum", EVENTS, lambda df: column(df, "x").mulsum(column(df, "y")), "SELECT round(sum(x * y), 6) + 0.0 AS v FROM base")
    over("reduce_bincount", KEYS, lambda df: column(df, "b").bincount(), "SELECT range AS i0, coalesce(n, 0)::BIGINT AS v FROM range((SELECT max(b) + 1 FROM base)) LEFT JOIN (SELECT b, count(*) AS n FROM base GROUP BY b) ON range = b")
    over("reduce_bincount_weights", KEYS, lambda df: column(df, "b").bincount(column(df, "t"), minlength=110), "SELECT range AS i0, round(coalesce(n, 0), 6) + 0.0 AS v FROM range(110) LEFT JOIN (SELECT b, sum(t) AS n FROM base GROUP BY b) ON range = b")
    register("reduce_bincount_labels", lambda s, d: rounded(NDArray.from_column(base(s, d, "SELECT vec_id AS i, CAST(label AS BIGINT) AS l FROM embeddings"), "l", "i").bincount()), "SELECT range AS i0, coalesce(n, 0)::BIGINT AS v FROM range((SELECT max(label) + 1 FROM embeddings)) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON range = label")


# ---- scans, sorts, shapes -----------------------------------------------------------------


def _scans() -> None:
    x = lambda df: column(df, "x")
    over("scan_cumsum", EVENTS, lambda df: x(df).cumsum(), "SELECT i AS i0, round(sum(x) OVER (ORDER BY i), 6) + 0.0 AS v FROM base")
    over("scan_cumsum_int", KEYS, lambda df: column(df, "a").cumsum(), "SELECT i AS i0, (sum(a) OVER (ORDER BY i))::BIGINT AS v FROM base")
    register("scan_cumsum_axis1", lambda s, d: rounded(vectors(s, d).cumsum(axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('sum(v) OVER (PARTITION BY i0 ORDER BY i1)')} AS v FROM e")
    register("scan_cumsum_axis0", lambda s, d: rounded(vectors(s, d).cumsum(axis=0)), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('sum(v) OVER (PARTITION BY i1 ORDER BY i0)')} AS v FROM e")
    over("scan_cumsum_nan", HOLES, lambda df: x(df).cumsum(nan=True), "SELECT i AS i0, round(CASE WHEN count(*) FILTER (NOT isnan(x)) OVER w = 0 THEN CAST('NaN' AS DOUBLE) ELSE sum(CASE WHEN NOT isnan(x) THEN x END) OVER w END, 6) + 0.0 AS v FROM base WINDOW w AS (ORDER BY i)")
    over("scan_cumprod", EVENTS, lambda df: (column(df, "y") / 1000.0 + 1.0).reshape(None, 100).cumprod(axis=1), f"SELECT i // 100 AS i0, i % 100 AS i1, {R('product(y / 1000 + 1) OVER (PARTITION BY i // 100 ORDER BY i)')} AS v FROM base")
    over("sort_values", EVENTS, lambda df: x(df).sort(), f"SELECT row_number() OVER (ORDER BY x) - 1 AS i0, {R('x')} AS v FROM base")
    over("sort_index", EVENTS, lambda df: x(df).sort_index(), "SELECT row_number() OVER (ORDER BY x, i) - 1 AS i0, i AS v FROM base")
    register("sort_axis1", lambda s, d: rounded(vectors(s, d).sort(axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v) - 1 AS i1, {R('v')} AS v FROM e")
    register("sort_index_axis1", lambda s, d: rounded(vectors(s, d).sort_index(axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, (i0 * {WIDTH} + i1)::BIGINT AS v FROM e")
    over("sort_top", EVENTS, lambda df: x(df).top(10), f"SELECT i0, {R('x')} AS v FROM (SELECT row_number() OVER (ORDER BY x DESC) - 1 AS i0, x FROM base) WHERE i0 < 10")
    over("diff_1", EVENTS, lambda df: x(df).diff(), f"SELECT i AS i0, {R('d')} AS v FROM (SELECT i, lead(x) OVER (ORDER BY i) - x AS d FROM base) WHERE d IS NOT NULL")
    over("diff_2", EVENTS, lambda df: x(df).diff(2), f"SELECT i AS i0, {R('d')} AS v FROM (SELECT i, lead(x, 2) OVER (ORDER BY i) - 2 * lead(x) OVER (ORDER BY i) + x AS d FROM base) WHERE d IS NOT NULL")
    register("diff_axis1", lambda s, d: rounded(vectors(s, d).diff(axis=1)), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('d')} AS v FROM (SELECT i0, i1, lead(v) OVER (PARTITION BY i0 ORDER BY i1) - v AS d FROM e) WHERE d IS NOT NULL")


def _shapes() -> None:
    x = lambda df: column(df, "x")
    over("index_slice", EVENTS, lambda df: x(df)[10:-10:3], f"SELECT (i - 10) // 3 AS i0, {R('x')} AS v FROM base WHERE i >= 10 AND i < (SELECT count(*) FROM base) - 10 AND (i - 10) % 3 = 0")
    over("index_reverse", EVENTS, lambda df: x(df).reverse(), f"SELECT (SELECT count(*) FROM base) - 1 - i AS i0, {R('x')} AS v FROM base")
    over("index_scalar", EVENTS, lambda df: x(df)[-5], f"SELECT {R('x')} AS v FROM base WHERE i = (SELECT count(*) FROM base) - 5")
    over("index_list", EVENTS, lambda df: x(df)[[5, 3, 3, -1]], f"SELECT t.k::BIGINT AS i0, {R('x')} AS v FROM base JOIN (VALUES (0, 5), (1, 3), (2, 3), (3, (SELECT count(*) - 1 FROM base))) t(k, j) ON i = j")
    over("index_delete", EVENTS, lambda df: x(df).delete([0, 7, -1]), f"SELECT (i - 1 - (i > 7)::INT)::BIGINT AS i0, {R('x')} AS v FROM base WHERE i NOT IN (0, 7) AND i < (SELECT count(*) FROM base) - 1")
    over("index_assign", EVENTS, lambda df: x(df).assign(slice(0, 100), -1.0), f"SELECT i AS i0, CASE WHEN i < 100 THEN -1.0::DOUBLE ELSE {R('x')} END AS v FROM base")
    over("index_assign_mask", EVENTS, lambda df: x(df).assign(column(df, "p"), 50.0), f"SELECT i AS i0, {R('CASE WHEN p THEN 50.0 ELSE x END')} AS v FROM base")
    register("index_gather", lambda s, d: _gather(s, d), f"WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_orderkey % 1999 % (SELECT count(*) FROM part) AS k FROM orders) SELECT i0, {R('p_retailprice')} AS v FROM l JOIN part ON p_partkey = k")
    register("index_rows", lambda s, d: rounded(vectors(s, d)[[3, 0], True]), f"WITH e AS ({ELEMENTS}) SELECT CASE i0 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS i0, i1::BIGINT AS i1, {R('v')} AS v FROM e WHERE i0 IN (0, 3)")
    register("index_outer", lambda s, d: rounded(vectors(s, d)[[0, 2], [1, 5, 9]]), f"WITH e AS ({ELEMENTS}) SELECT (i0 // 2)::BIGINT AS i0, (i1 // 4)::BIGINT AS i1, {R('v')} AS v FROM e WHERE i0 IN (0, 2) AND i1 IN (1, 5, 9)")
    register("index_at", lambda s, d: rounded(vectors(s, d).at([0, 1, 2], [3, 3, 63])), f"WITH e AS ({ELEMENTS}) SELECT i0, {R('v')} AS v FROM e WHERE (i0, i1) IN ((0, 3), (1, 3), (2, 63))")
    register("index_new_axis", lambda s, d: rounded(vectors(s, d)[:, None, 0]), f"WITH e AS ({ELEMENTS}) SELECT i0, 0::BIGINT AS i1, {R('v')} AS v FROM e WHERE i1 = 0")
    views = {
        "transpose": (lambda a: a.transpose(), "i1::BIGINT AS i0, i0 AS i1", ""), "swapaxes": (lambda a: a.swapaxes(0, 1), "i1::BIGINT AS i0, i0 AS i1", ""), "fliplr": (lambda a: a.fliplr(), "i0, (63 - i1)::BIGINT AS i1", ""),
        "flipud": (lambda a: a.flipud(), "(SELECT max(vec_id) FROM embeddings) - i0 AS i0, i1::BIGINT AS i1", ""), "rot90": (lambda a: a.rot90(), "(63 - i1)::BIGINT AS i0, i0 AS i1", ""),
        "reshape": (lambda a: a.reshape(None, 32), "(i0 * 64 + i1) // 32 AS i0, (i1 % 32)::BIGINT AS i1", ""), "flatten": (lambda a: a.flatten(), "i0 * 64 + i1 AS i0", ""), "expand_dims": (lambda a: a.expand_dims(0), "0::BIGINT AS i0, i0 AS i1, i1::BIGINT AS i2", ""),
        "diagonal": (lambda a: a.diagonal(1), "i0", "WHERE i1 = i0 + 1"), "split": (lambda a: a.split(4, 1)[1], "i0, (i1 - 16)::BIGINT AS i1", "WHERE i1 BETWEEN 16 AND 31"),
    }
    for name, (f, keys, where) in views.items():
        register(f"shape_{name}", lambda s, d, f=f: rounded(f(vectors(s, d))), f"WITH e AS ({ELEMENTS}) SELECT {keys}, {R('v')} AS v FROM e {where}")
    register("shape_triu", lambda s, d: rounded(vectors(s, d).triu(1)), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('CASE WHEN i0 + 1 <= i1 THEN v ELSE 0 END')} AS v FROM e")
    register("shape_tril", lambda s, d: rounded(vectors(s, d).tril()), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('CASE WHEN i0 >= i1 THEN v ELSE 0 END')} AS v FROM e")
    register("shape_trace", lambda s, d: rounded(vectors(s, d).trace()), f"WITH e AS ({ELEMENTS}) SELECT {R('sum(v)')} AS v FROM e WHERE i0 = i1")
    price = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey AS DOUBLE) + 0.5 AS x FROM nation"
    over("shape_diag", price, lambda df: x(df).diag(), f"SELECT a.range AS i0, b.range AS i1, {R('CASE WHEN a.range = b.range THEN a.range + 0.5 ELSE 0 END')} AS v FROM range(25) a, range(25) b")


def _gather(s: SparkSession, d: str) -> DataFrame:
    part = base(s, d, "SELECT p_partkey AS i, p_retailprice AS x FROM part")
    prices = column(part, "x")
    keys = base(s, d, f"SELECT o_orderkey AS i, CAST(o_orderkey % 1999 % {prices.size} AS BIGINT) AS k FROM orders")
    return rounded(prices[column(keys, "k")])


# ---- combination, products, neural nets ---------------------------------------------------


def _combinations() -> None:
    def balances(s: SparkSession, d: str) -> list[NDArray]:
        return [column(base(s, d, q), "x") for q in ("SELECT c_custkey AS i, c_acctbal AS x FROM customer", "SELECT s_suppkey AS i, s_acctbal AS x FROM supplier")]

    both = f"SELECT c_custkey AS i0, {R('c_acctbal')} AS v FROM customer UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer) AS i0, {R('s_acctbal')} AS v FROM supplier"
    register("combine_concatenate", lambda s, d: rounded(NDArray.concatenate(balances(s, d))), both)
    register("combine_append", lambda s, d: rounded((lambda a, b: a.append(b))(*balances(s, d))), both)
    register("combine_hstack", lambda s, d: rounded(NDArray.hstack(balances(s, d))), both)
    nations = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey * n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation"
    x, y = (lambda df: column(df, "x")), (lambda df: column(df, "y"))
    over("combine_vstack", nations, lambda df: NDArray.vstack([x(df), y(df)]), f"SELECT 0::BIGINT AS i0, i AS i1, {R('x')} AS v FROM base UNION ALL SELECT 1::BIGINT, i, {R('y')} FROM base")
    over("combine_dstack", nations, lambda df: NDArray.dstack([x(df), y(df)]), f"SELECT 0::BIGINT AS i0, i AS i1, 0::BIGINT AS i2, {R('x')} AS v FROM base UNION ALL SELECT 0::BIGINT, i, 1::BIGINT, {R('y')} FROM base")
    over("combine_column_stack", nations, lambda df: NDArray.column_stack([x(df), y(df)]), f"SELECT i AS i0, 0::BIGINT AS i1, {R('x')} AS v FROM base UNION ALL SELECT i, 1::BIGINT, {R('y')} FROM base")
    over("combine_insert", nations, lambda df: x(df).insert([1, 3], -1.0), f"SELECT (i + (i >= 1)::INT + (i >= 3)::INT)::BIGINT AS i0, {R('x')} AS v FROM base UNION ALL VALUES (1, -1.0), (4, -1.0)")
    over("combine_tile", nations, lambda df: x(df).tile(2, 3), f"SELECT a.range AS i0, i + 25 * b.range AS i1, {R('x')} AS v FROM base, range(2) a, range(3) b")
    over("combine_repeat", nations, lambda df: x(df).repeat(3), f"SELECT i * 3 + range AS i0, {R('x')} AS v FROM base, range(3)")
    over("combine_broadcast", nations, lambda df: x(df).expand_dims(1) + y(df), f"SELECT a.i AS i0, b.i AS i1, {R('a.x + b.y')} AS v FROM base a, base b")
    over("linear_outer", nations, lambda df: x(df).outer(y(df)), f"SELECT a.i AS i0, b.i AS i1, {R('a.x * b.y')} AS v FROM base a, base b")
    over("linear_kron", nations, lambda df: x(df).kron(y(df)), f"SELECT a.i * 25 + b.i AS i0, {R('a.x * b.y')} AS v FROM base a, base b")
    over("linear_dot", EVENTS, lambda df: x(df).dot(y(df)), "SELECT round(sum(x * y), 6) + 0.0 AS v FROM base")
    over("linear_inner", EVENTS, lambda df: x(df).inner(y(df)), "SELECT round(sum(x * y), 6) + 0.0 AS v FROM base")
    register("linear_gemm", lambda s, d: rounded(vectors(s, d).gemm(create.seq(s, [WIDTH, 8], 0.0, 0.01), alpha=2.0)), f"WITH e AS ({ELEMENTS}) SELECT i0, range AS i1, {R('2 * sum(v * (i1 * 8 + range) * 0.01)')} AS v FROM e, range(8) GROUP BY i0, range")
    register("linear_gram", lambda s, d: rounded(vectors(s, d).gram()), f"WITH e AS ({ELEMENTS}) SELECT a.i1::BIGINT AS i0, b.i1::BIGINT AS i1, {R('sum(a.v * b.v)')} AS v FROM e a JOIN e b USING (i0) GROUP BY a.i1, b.i1")
    register("linear_matvec", lambda s, d: rounded(vectors(s, d).dot(create.seq(s, WIDTH, 1.0, 0.5))), f"WITH e AS ({ELEMENTS}) SELECT i0, {R('sum(v * (1 + i1 * 0.5))')} AS v FROM e GROUP BY i0")
    register("linear_cov", lambda s, d: rounded(vectors(s, d).transpose().cov()), f"WITH e AS ({ELEMENTS}) SELECT a.i1::BIGINT AS i0, b.i1::BIGINT AS i1, {R('covar_samp(a.v, b.v)')} AS v FROM e a JOIN e b USING (i0) GROUP BY a.i1, b.i1")
    register("kmeans_assign", lambda s, d: rounded(_nearest(s, d)), f"WITH e AS ({ELEMENTS}), dist AS (SELECT a.i0, c.i0 AS k, round(sum((a.v - c.v) * (a.v - c.v)), 9) AS s FROM e a JOIN e c ON a.i1 = c.i1 AND c.i0 < 16 GROUP BY a.i0, c.i0) SELECT i0, k AS v FROM (SELECT i0, k, row_number() OVER (PARTITION BY i0 ORDER BY s, k) AS r FROM dist) WHERE r = 1")
    stats = f"WITH e AS ({ELEMENTS}), m AS (SELECT i1, avg(v) AS mean, var_pop(v) AS var FROM e GROUP BY i1) "
    ones = lambda s: create.ones(s, [1, WIDTH])
    register("nn_fixed_batch_norm", lambda s, d: rounded(nn.fixed_batch_norm(vectors(s, d), ones(s) * 2.0, ones(s), ones(s) * 0.5, ones(s) * 4.0)), f"WITH e AS ({ELEMENTS}) SELECT i0, i1::BIGINT AS i1, {R('(v - 0.5) / sqrt(4 + 2e-5) * 2 + 1')} AS v FROM e")


def _nearest(s: SparkSession, d: str) -> NDArray:
    """Index of the nearest of the first 16 vectors: squared distances by a matrix product."""
    v = vectors(s, d)
    centres = v[0:16, :]
    norms = v.square().sum(axis=1, keepdims=True)
    distance = norms.sub(v.gemm(centres.transpose()).mul(2.0)).add(centres.square().sum(axis=1).expand_dims(0))
    distance = distance._like(F.round(distance.value, 9), dt.DFloat)
    return distance.argmin(axis=1)


# ---- sources and streams ------------------------------------------------------------------


def _sources() -> None:
    over("source_store", EVENTS, lambda df: column(df, "x").cast_to("Int64").store(column(df, "y")), "trunc(y)::BIGINT")
    over("source_binary", EVENTS, lambda df: (lambda a: binary.unpack(binary.pack(a), a.shape, a.dtype))(column(df, "x")), R("x"))
    register("sink_format", lambda s, d: column(base(s, d, KEYS), "a").format("%05d"), f"WITH base AS ({KEYS}) SELECT i AS i0, lpad(a::VARCHAR, 5, '0') AS text FROM base")
    register("stream_moments", _stream, "SELECT event_type AS k, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream: micro-batches merge into the same moments as a batch gives."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    name = f"moments_{abs(hash(d)) % 10**9}"
    query = moments(stream.select("event_type", "value"), "value", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    out = s.table(name)
    return out.select(F.col("event_type").alias("k"), F.col("count").alias("n"), F.round("sum", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"), F.col("min").alias("lo"), F.col("max").alias("hi"))


_elementwise()
_complex()
_reductions()
_scans()
_shapes()
_combinations()
_sources()

from ndspark import queries_blocks, queries_tables  # noqa: E402, F401  register more queries
