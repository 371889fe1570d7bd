"""Named queries of what works by tile, chunk and rank: products, covariances, scans and selections along axes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark import dtypes as dt
from ndspark.array import NDArray, row_count
from ndspark.plans.order import dense_index
from ndspark.queries import ELEMENTS, WIDTH, R, base, register, rounded, vectors

# ---- products and covariances -------------------------------------------------------------


def _copies(n: int) -> int:
    """Copies of n vectors side by side that have more than 10^6 elements."""
    return math.ceil(1_000_000 / (n * WIDTH)) + 1


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Transposed vectors times many copies of the vectors, each copy with a factor of its own."""
    v = vectors(s, d)
    right = v.tile(1, _copies(v.shape[0]))
    factor = F.call_function("div", right.indices[1], F.lit(WIDTH).cast("bigint")) + 1
    return rounded(v.transpose().gemm(right._like(right.value * factor, dt.DFloat)))


def _batched(s: SparkSession, d: str) -> DataFrame:
    """Every vector as a matrix [4, 16] times itself as [16, 4], plus a part of it."""
    v = vectors(s, d)
    n = v.shape[0]
    return rounded(v.reshape(n, 4, 16).gemm(v.reshape(n, 16, 4), v[True, 0:16].reshape(n, 4, 4), alpha=2.0, beta=0.5))


def _weights(s: SparkSession, d: str) -> list[NDArray]:
    rows = base(s, d, "SELECT vec_id AS i, CAST(label + 1 AS BIGINT) AS f, 1 / CAST(1 + vec_id % 7 AS DOUBLE) AS a FROM embeddings")
    return [NDArray.from_column(rows, c, "i") for c in ("f", "a")]


def _products() -> None:
    gram = f"WITH e AS ({ELEMENTS}), g AS (SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY ALL)"
    register("linear_gemm_tiled", _wide, f"{gram}, c AS (SELECT count(*) AS n FROM embeddings) SELECT i0::BIGINT AS i0, range * {WIDTH} + i1 AS i1, {R('v * (range + 1)')} AS v FROM g, (SELECT unnest(range(ceil(1000000 / (n * {WIDTH}))::BIGINT + 1)) AS range FROM c)")
    register("linear_gemm_batched", _batched, f"""
WITH e AS ({ELEMENTS}), p AS (SELECT a.i0, a.i1 // 16 AS r, b.i1 % 4 AS c, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i0 = b.i0 AND a.i1 % 16 = b.i1 // 4 GROUP BY ALL)
SELECT p.i0, r::BIGINT AS i1, c::BIGINT AS i2, {R('2 * p.v + 0.5 * e.v')} AS v FROM p JOIN e ON e.i0 = p.i0 AND e.i1 = r * 4 + c""")
    register("linear_gemm_transposed", lambda s, d: (lambda v: rounded(v.gemm(v.transpose(), side=128).max(axis=1)))(vectors(s, d)), f"WITH e AS (SELECT vec_id AS i0, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.i0, {R('max(list_inner_product(a.e, b.e))')} AS v FROM e a, e b GROUP BY a.i0")
    register("linear_cov_weighted", lambda s, d: rounded(vectors(s, d).transpose().cov(None, 0, *_weights(s, d))), f"""
WITH e AS ({ELEMENTS}), w AS (SELECT i0, i1, v, label + 1 AS f, 1 / (1 + i0 % 7)::DOUBLE AS a FROM e), m AS (SELECT i1, sum(f * a * v) / sum(f * a) AS m, sum(f * a) AS total FROM w GROUP BY i1),
c AS (SELECT i0, i1, f * a AS w, v - m AS v, total FROM w JOIN m USING (i1))
SELECT x.i1::BIGINT AS i0, y.i1::BIGINT AS i1, {R('sum(x.w * x.v * y.v) / min(x.total)')} AS v FROM c x JOIN c y USING (i0) GROUP BY x.i1, y.i1""")
    register("linear_cov_reliability", lambda s, d: rounded(vectors(s, d).transpose().cov(aweights=_weights(s, d)[1])), f"""
WITH e AS ({ELEMENTS}), w AS (SELECT i0, i1, v, 1 / (1 + i0 % 7)::DOUBLE AS a FROM e), m AS (SELECT i1, sum(a * v) / sum(a) AS m, sum(a) - sum(a * a) / sum(a) AS factor FROM w GROUP BY i1),
c AS (SELECT i0, i1, a AS w, v - m AS v, factor FROM w JOIN m USING (i1))
SELECT x.i1::BIGINT AS i0, y.i1::BIGINT AS i1, {R('sum(x.w * x.v * y.v) / min(x.factor)')} AS v FROM c x JOIN c y USING (i0) GROUP BY x.i1, y.i1""")
    register("linear_cov_pair", lambda s, d: (lambda v: rounded(v[True, 0:8].transpose().cov(v[True, 8:16].transpose(), ddof=0)))(vectors(s, d)), f"WITH e AS ({ELEMENTS}) SELECT a.i1::BIGINT AS i0, b.i1::BIGINT AS i1, {R('covar_pop(a.v, b.v)')} AS v FROM e a JOIN e b USING (i0) WHERE a.i1 < 16 AND b.i1 < 16 GROUP BY a.i1, b.i1")


# ---- scans and ranks along axes -----------------------------------------------------------

#: Short, so that an axis of the small tables has several chunks.
CHUNK = 4096
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINES = f"WITH l AS (SELECT row_number() OVER (ORDER BY {ORDER}) - 1 AS i0, [l_quantity, l_extendedprice, l_discount, l_tax] AS r FROM lineitem), e AS (SELECT i0, unnest(r) AS v, generate_subscripts(r, 1) - 1 AS i1 FROM l) "


def _lines(s: SparkSession, d: str) -> NDArray:
    """lineitem in the order of all its columns, as [lines, 4]."""
    rows = base(s, d, f"SELECT {ORDER} FROM lineitem")
    rows = dense_index(rows, [F.col(c.strip()) for c in ORDER.split(",")], "i0")
    return NDArray.from_rows(rows.select("i0", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("r")), "r", "i0", 4)


def _lines_unordered(s: SparkSession, d: str) -> NDArray:
    """The same [lines, 4] for what doesn't depend on the order of the lines: they are numbered as they are read, without a sort."""
    rows = base(s, d, "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
    n = row_count(rows)
    rows = rows.select(F.monotonically_increasing_id().alias("i0"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("r"))
    return NDArray.from_rows(rows, "r", "i0", 4, size=n)


def cents(a: NDArray) -> DataFrame:
    """Two places: sums of amounts in whole cents."""
    return a.df.withColumn("v", F.round("v", 2) + F.lit(0.0))


def _keys(s: SparkSession, d: str) -> NDArray:
    return NDArray.from_column(base(s, d, "SELECT o_orderkey AS i, CAST(o_orderkey % 97 + 1 AS BIGINT) AS b FROM orders"), "b", "i")


def _turning(s: SparkSession, d: str) -> NDArray:
    """Complex numbers of about 1, fifty in a row."""
    rows = base(s, d, "SELECT event_id AS i, CAST(event_id % 17 AS DOUBLE) * 0.75D - 6.0D AS y FROM events")
    z = NDArray(rows, [F.col("i")], F.struct((F.col("y") * 0.0007310585786300049 + 1).alias("re"), F.lit(0.02).alias("im")), [rows.count()], dt.DComplex)
    return z.reshape(None, 50)


def _along() -> None:
    lines = f"SELECT i0, i1::BIGINT AS i1, round({{}}, 2) + 0.0 AS v FROM e"
    register("scan_cumsum_lines", lambda s, d: cents(_lines(s, d).cumsum(axis=0, chunk=CHUNK)), LINES + lines.format("sum(v) OVER (PARTITION BY i1 ORDER BY i0)"))
    register("sort_lines", lambda s, d: cents(_lines(s, d).sort(axis=0, chunk=CHUNK)), LINES + "SELECT row_number() OVER (PARTITION BY i1 ORDER BY v) - 1 AS i0, i1::BIGINT AS i1, round(v, 2) + 0.0 AS v FROM e")
    register("sort_index_lines", lambda s, d: rounded(_lines(s, d).sort_index(axis=0, chunk=CHUNK)), LINES + "SELECT row_number() OVER (PARTITION BY i1 ORDER BY v, i0) - 1 AS i0, i1::BIGINT AS i1, i0 * 4 + i1 AS v FROM e")
    register("diff_lines", lambda s, d: cents(_lines(s, d).diff(2, axis=0, chunk=CHUNK)), LINES + "SELECT * FROM (SELECT i0, i1::BIGINT AS i1, round(lead(v, 2) OVER w - 2 * lead(v) OVER w + v, 2) + 0.0 AS v FROM e WINDOW w AS (PARTITION BY i1 ORDER BY i0)) WHERE v IS NOT NULL")
    register("scan_cumprod_int", lambda s, d: rounded(_keys(s, d).square().reshape(None, 4).cumprod(axis=1)), "WITH b AS (SELECT o_orderkey AS i, (o_orderkey % 97 + 1)::BIGINT AS b FROM orders), l AS (SELECT i // 4 AS i0, i % 4 AS i1, list(b * b) OVER (PARTITION BY i // 4 ORDER BY i ROWS UNBOUNDED PRECEDING) AS x FROM b) SELECT i0, i1, list_reduce(x, lambda p, q: p * q) AS v FROM l")
    parts = ", ".join(f"round({p}, 6) + 0.0 AS {n}" for p, n in (("exp(m) * cos(a)", "re"), ("exp(m) * sin(a)", "im")))
    register("scan_cumprod_complex", lambda s, d: _turning(s, d).cumprod(axis=1, chunk=16).df.select("i0", "i1", *[(F.round(F.col("v")[p], 6) + F.lit(0.0)).alias(p) for p in ("re", "im")]), f"WITH z AS (SELECT event_id AS i, ((event_id % 17)::DOUBLE * 0.75::DOUBLE - 6) * 0.0007310585786300049::DOUBLE + 1 AS re, 0.02::DOUBLE AS im FROM events), p AS (SELECT i // 50 AS i0, i % 50 AS i1, sum(ln(sqrt(re * re + im * im))) OVER w AS m, sum(atan2(im, re)) OVER w AS a FROM z WINDOW w AS (PARTITION BY i // 50 ORDER BY i)) SELECT i0, i1, {parts} FROM p")
    register("reduce_median_lines", lambda s, d: rounded(_lines_unordered(s, d).median(axis=0, direct=1000)), LINES + f"SELECT i1::BIGINT AS i0, {R('median(v)')} AS v FROM e GROUP BY i1")
    register("reduce_percentile_lines", lambda s, d: rounded(_lines_unordered(s, d).percentile(99.5, axis=0, direct=1000)), LINES + f"SELECT i1::BIGINT AS i0, {R('quantile_cont(v, 0.995)')} AS v FROM e GROUP BY i1")
    register("reduce_median_ranked", lambda s, d: rounded(_lines_unordered(s, d).median(direct=1000)), LINES + f"SELECT {R('median(v)')} AS v FROM e")
    register("reduce_percentile_ranked", lambda s, d: rounded(_lines_unordered(s, d).percentile(12.5, direct=1000)), LINES + f"SELECT {R('quantile_cont(v, 0.125)')} AS v FROM e")
    big = "SELECT o_orderkey AS i, CAST(4611686018427387904 AS BIGINT) + o_orderkey * 3 AS x FROM orders"
    register("reduce_median_exact", lambda s, d: rounded(NDArray.from_column(base(s, d, big), "x", "i").reshape(None, 10).median(axis=1)), "WITH b AS (SELECT o_orderkey // 10 AS i0, list((4611686018427387904 + o_orderkey * 3)::HUGEINT ORDER BY o_orderkey) AS x FROM orders GROUP BY 1) SELECT i0, ((x[5] + x[6]) // 2)::BIGINT AS v FROM b")


_products()
_along()
