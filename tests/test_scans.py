"""Scans in chunks, sorts along long axes, products of whole and complex numbers, elements by rank: all against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndspark.array import NDArray
from ndspark.plans.chunks import Products
from ndspark.plans.ranks import at_ranks
from ndspark.sources.create import array
from tests.test_tiles import dense, frame


@pytest.fixture(scope="module")
def m():
    return np.random.default_rng(11).normal(size=(3, 41, 2)).round(3)


def test_one_segment_over_many_chunks(spark, m):
    x = frame(spark, m, "DFloat")
    for chunk in (1, 7, 40, 1000):
        assert np.allclose(dense(x.cumsum(axis=1, chunk=chunk)), m.cumsum(1))
        assert np.allclose(dense(x.cumprod(axis=1, chunk=chunk)), m.cumprod(1))
    assert np.allclose(dense(x.cumsum(chunk=10)).ravel(), m.ravel().cumsum())
    assert np.allclose(dense(x.cumsum(axis=0, chunk=2)), m.cumsum(0))
    w = np.arange(90).reshape(30, 3)
    assert (dense(frame(spark, w, "Int64").cumsum(axis=0, chunk=4)) == w.cumsum(0)).all()


def test_nan_is_skipped_across_chunks(spark):
    v = np.array([np.nan, np.nan, 1.0, np.nan, 2.0, np.nan, np.nan, 4.0])
    want = np.array([np.nan, np.nan, 1, 1, 3, 3, 3, 7])
    for chunk in (1, 2, 3, 99):
        assert np.allclose(dense(frame(spark, v, "DFloat").cumsum(nan=True, chunk=chunk)), want, equal_nan=True)


def test_no_window_holds_a_segment(spark):
    plan = array(spark, [1.0] * 20).cumsum(chunk=5).df._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan


def test_differences_overlap_by_n(spark, m):
    x = frame(spark, m, "DFloat")
    for n in (1, 2, 5):
        for chunk in (1, 6, 13, 500):
            assert np.allclose(dense(x.diff(n, axis=1, chunk=chunk)), np.diff(m, n, axis=1))
    u = np.array([3, 250, 7, 7, 0, 255, 1], np.uint8)
    assert dense(frame(spark, u.astype(int), "UInt8").diff(chunk=2)).tolist() == np.diff(u).tolist()


def test_long_axes_are_sorted_by_range(spark, m):
    m = m.copy()
    m[:, ::4] = m[:, :1]  # ties
    m[1, 5, 0] = np.nan
    x = frame(spark, m, "DFloat")
    assert np.allclose(dense(x.sort(axis=1, chunk=3)), np.sort(m, axis=1), equal_nan=True)
    places = np.argsort(m, axis=1, kind="stable")
    flat = np.take_along_axis(np.arange(m.size).reshape(m.shape), places, 1)
    assert (dense(x.sort_index(axis=1, chunk=3)) == flat).all()


def test_products_of_whole_numbers(spark):
    r = np.random.default_rng(5)
    v = r.integers(5, 9, (4, 30)).astype(object)
    v[:, 20:] = 1  # beyond 2**53 from here on
    v[1, 9] = -1
    v[2, 7] = 0
    want = np.multiply.accumulate(v, axis=1)
    for chunk in (1, 4, 99):
        assert dense(frame(spark, v.astype(int), "Int64").cumprod(axis=1, chunk=chunk)).tolist() == want.tolist()
    assert abs(want).max() > 2**53


def test_products_beyond_the_type_raise_or_wrap(spark):
    x = array(spark, [2] * 70, "Int64")
    with pytest.raises(Exception, match="too large"):
        x.cumprod(chunk=8).to_list()
    assert x[0:62].cumprod(chunk=8).to_list()[-1] == 2**62
    assert (-x[0:63]).cumprod(chunk=5).to_list()[-1] == -(2**63)  # the smallest Int64
    with pytest.raises(Exception, match="too large"):
        x[0:63].cumprod(chunk=5).to_list()
    assert x.cumprod(wrap=True, chunk=9).to_list() == [int(np.int64(np.uint64(2**k % 2**64))) for k in range(1, 71)]
    assert array(spark, [2] * 70 + [0, 5], "Int64").cumprod(wrap=True, chunk=9).to_list()[-2:] == [0, 0]
    assert [int(v) for v in x[0:63].cast_to("UInt64").cumprod(chunk=4).to_list()][-1] == 2**63
    with pytest.raises(Exception, match="too large"):
        array(spark, [100, 2], "Int8").cumprod().to_list()
    assert array(spark, [100, 2], "Int8").cumprod(wrap=True).to_list() == [100, -56]


def test_products_of_complex_numbers(spark):
    r = np.random.default_rng(6)
    z = (r.normal(size=(2, 12)) + 1j * r.normal(size=(2, 12))).round(2)
    for chunk in (1, 5, 50):
        assert np.allclose(dense(frame(spark, z, "DComplex").cumprod(axis=1, chunk=chunk)), np.cumprod(z, 1))
    assert np.allclose(dense(frame(spark, z, "DComplex").cumprod(chunk=5)).ravel(), np.cumprod(z))


@pytest.mark.parametrize("direct", [4, 60, 10**9])
def test_medians_and_percentiles_by_rank(spark, direct):
    r = np.random.default_rng(8)
    m = r.normal(size=(3, 700))
    m[1, :500] = 0.25  # one value has most of a group
    x = frame(spark, m, "DFloat")
    assert np.allclose(dense(x.median(axis=1, direct=direct)), np.median(m, 1))
    assert np.isclose(x.median(direct=direct).item(), np.median(m))
    for q in (0, 12.5, 50, 99.9, 100):
        assert np.allclose(dense(x.percentile(q, axis=1, direct=direct)), np.percentile(m, q, axis=1))
        assert np.isclose(x.percentile(q, direct=direct).item(), np.percentile(m, q))
    m[0, 3:400] = np.nan
    m[2] = np.nan
    x = frame(spark, m, "DFloat")
    assert np.allclose(dense(x.median(axis=1, keepdims=True, direct=direct)), np.nanmedian(np.where(np.isnan(m).all(1, keepdims=True), 7, m), 1, keepdims=True) * np.array([[1], [1], [np.nan]]), equal_nan=True)


def test_medians_of_whole_numbers_are_exact(spark):
    big = 2**62
    v = np.array([[big + 1, big + 5, big + 9, big + 11], [-3, -4, 10**6, -(10**6)], [5, 5, 5, 6]])
    x = frame(spark, v, "Int64")
    for direct in (1, 100):
        assert x.median(axis=1, direct=direct).to_list() == [big + 7, -3, 5]
        assert frame(spark, v[0, :3], "Int64").median(direct=direct).item() == big + 5
    assert [int(a) for a in (x[0:1, True].cast_to("UInt64") * 2).median(axis=1).to_list()] == [2 * big + 14]


def test_brackets_leave_few_values(spark):
    rows = spark.range(20_000).select((F.xxhash64("id") % 100_000).cast("double").alias("v"))
    found = at_ranks(rows, [], {"a": F.lit(5000).cast("bigint"), "b": F.lit(19_999).cast("bigint")}, 20_000, 1, direct=50).first()
    want = sorted(r["v"] for r in rows.collect())
    assert (found["n"], found["a"], found["b"]) == (20_000, want[5000], want[-1])
    assert at_ranks(rows.where("false"), [], {"a": F.lit(0).cast("bigint")}, 20_000, 1, direct=50).collect()[0]["n"] == 0


def test_products_of_many_factors(spark):
    from ndspark.operators import reducing

    before, reducing.PART = reducing.PART, 3
    try:
        v = np.random.default_rng(2).integers(1, 4, (2, 25))
        assert frame(spark, v, "Int64").prod(axis=1).to_list() == v.prod(1).tolist()
        assert frame(spark, v[:, :12], "Int64").prod().item() == v[:, :12].prod()
        z = v[:, :9] + 1j
        assert np.allclose(dense(frame(spark, z, "DComplex").prod(axis=0)), z.prod(0))
    finally:
        reducing.PART = before


def test_short_axes_are_dealt_once_and_multiplied_together(spark):
    v = np.random.default_rng(15).integers(-5, 6, (7000, 3))  # runs cross the ends of Arrow batches
    rows = spark.createDataFrame([(k, v[k].tolist()) for k in range(len(v))], "i long, r array<long>")
    x = NDArray.from_rows(rows, "r", "i", 3)
    product = x.cumprod(axis=1)
    plan = product.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    assert (dense(product) == np.cumprod(v, axis=1)).all()
    assert (dense(x.cumprod(axis=1, chunk=2)) == np.cumprod(v, axis=1)).all()


def test_runs_of_any_lengths_are_multiplied_together():
    r = np.random.default_rng(16)
    sizes = np.concatenate([r.integers(1, 9, 60), [1, 30, 1]])
    starts, x = np.append(0, sizes.cumsum()[:-1]), r.integers(-3, 4, sizes.sum())
    work = Products("i", -(2**63), 2**63 - 1)
    states = [work.one if k % 3 else (np.array([5], np.int64).tobytes(), 5.0, 4) for k in range(len(sizes))]
    p, about, count = work.along_runs(x, starts, states)
    want = [work.along(x[s : s + n], state) for s, n, state in zip(starts, sizes, states)]
    for k, found in enumerate((p, about, count)):
        assert (found == np.concatenate([w[k] for w in want])).all()


def test_percentiles_of_lines_need_no_order(spark, monkeypatch):
    from ndspark import queries_blocks
    from ndspark.queries import QUERIES

    def unwanted(*_):
        raise AssertionError("lines are sorted")

    monkeypatch.setattr(queries_blocks, "dense_index", unwanted)
    for name, n in (("reduce_percentile_lines", 4), ("reduce_percentile_ranked", 1), ("reduce_median_lines", 4), ("reduce_median_ranked", 1)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == n
