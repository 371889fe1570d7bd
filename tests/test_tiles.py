"""Products of tiled matrices and covariances against NumPy."""

import numpy as np
import pytest

from ndspark.array import NDArray
from ndspark.errors import OperationError, ShapeError
from ndspark.operators.tiles import Tiles
from ndspark.sources.create import array


def frame(spark, m, dtype):
    """An array of these elements, from a frame in no particular order."""
    m = np.asarray(m)
    names = [f"i{k}" for k in range(m.ndim)]
    rows = [(*map(int, i), complex(x) if dtype.endswith("Complex") else x.item()) for i, x in np.ndenumerate(m)]
    if dtype.endswith("Complex"):
        rows = [(*r[:-1], (r[-1].real, r[-1].imag)) for r in rows]
    kind = "struct<re: double, im: double>" if dtype.endswith("Complex") else "double" if dtype.endswith("Float") else "bigint"
    df = spark.createDataFrame(rows[::-1], ", ".join(f"{n} bigint" for n in names) + f", v {kind}").repartition(3)
    return NDArray.from_coo(df, m.shape).cast_to(dtype)


def dense(a):
    return np.array(a.to_list())


def test_elements_survive_tiles_of_any_side(spark):
    m = np.random.default_rng(1).normal(size=(2, 11, 7))
    for side in (1, 3, 16):
        assert (dense(Tiles.of(frame(spark, m, "DFloat"), side).array()) == m).all()
    z = m[0] + 1j * m[1]
    assert (dense(Tiles.of(frame(spark, z, "DComplex"), 4).array()) == z).all()


@pytest.mark.parametrize("dtype", ["DFloat", "DComplex", "Int64"])
def test_products(spark, dtype):
    r = np.random.default_rng(2)
    make = {"DFloat": lambda *s: r.normal(size=s), "DComplex": lambda *s: r.normal(size=s) + 1j * r.normal(size=s), "Int64": lambda *s: r.integers(-9, 9, s)}[dtype]
    a, b, c = make(13, 21), make(21, 10), make(13, 10)
    # tiles of four: the common axis is split, since there are fewer output tiles than tasks
    got = frame(spark, a, dtype).cast_to(dtype)._with_axes(2)
    tiled = Tiles.of(got, 4).multiply(Tiles.of(frame(spark, b, dtype), 4)).array()
    assert np.allclose(dense(tiled), a @ b)
    factors = (3, -2) if dtype == "Int64" else (0.5, -2.0)
    out = frame(spark, a, dtype)._with_axes(3).gemm(frame(spark, b, dtype)._with_axes(3), frame(spark, c, dtype)._with_axes(3), *factors, side=5)
    assert np.allclose(dense(out), [factors[0] * (a @ b) + factors[1] * c])


def test_batches_are_equal_or_one(spark):
    r = np.random.default_rng(3)
    a, b, c = r.normal(size=(3, 4, 6)), r.normal(size=(1, 6, 5)), r.normal(size=(3, 4, 5))
    x, y, z = (frame(spark, m, "DFloat") for m in (a, b, c))
    assert np.allclose(dense(x.gemm(y, side=4)), a @ b)
    assert np.allclose(dense(x.gemm(y, z, alpha=2.0, beta=0.25, side=4)), 2 * (a @ b) + 0.25 * c)
    # an addend that is repeated over the batches
    assert np.allclose(dense(x.gemm(y, z[0:1, True, True], beta=1.0, side=4)), a @ b + c[:1])
    assert np.allclose(dense(x.gemm(frame(spark, b[0], "DFloat"), side=4)), a @ b)
    with pytest.raises(ShapeError):
        x.gemm(frame(spark, r.normal(size=(2, 6, 5)), "DFloat"))


def test_whole_numbers_are_exact_and_checked(spark):
    big = 2**31 + 7
    a, b = np.array([[big, -big], [3, big]]), np.array([[big, 1], [big - 1, 2]])
    want = a.astype(object) @ b.astype(object)
    assert frame(spark, a, "Int64").gemm(frame(spark, b, "Int64"), side=1).to_list() == want.tolist()
    with pytest.raises(Exception, match="beyond Int64"):
        x = frame(spark, np.array([[2**62, 2**62]]), "Int64")
        x.gemm(x.transpose()).to_list()
    u = array(spark, [[2**62, 1]], "Int64").cast_to("UInt64") * 2
    assert [[int(x) for x in r] for r in u.gemm(array(spark, [[1], [5]], "UInt64"), side=1).to_list()] == [[2**63 + 10]]


def test_rows_of_a_source_and_chains(spark):
    m = np.random.default_rng(4).normal(size=(30, 9)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "i bigint, r array<float>")
    a = NDArray.from_rows(df, "r", "i", 9).cast_to("DFloat")
    assert (dense(Tiles.of(a, 4).array()) == m).all()
    gram = a.transpose().gemm(a._with_axes(2), side=4)
    chained = Tiles.of(a, 4).multiply(Tiles.of(a.transpose(), 4)).array().gemm(a, side=4)
    assert np.allclose(dense(chained), m.astype(float) @ m.T.astype(float) @ m)
    assert np.allclose(dense(gram), m.T.astype(float) @ m)


def test_shuffle_holds_tiles_not_products(spark):
    m = np.random.default_rng(5).normal(size=(64, 64))
    x = frame(spark, m, "DFloat")
    plan = Tiles.of(x, 16).multiply(Tiles.of(x, 16)).array().df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and "CartesianProduct" not in plan


def weighted(m, ddof, f, a):
    return np.cov(m, ddof=ddof, fweights=f, aweights=a)


def test_covariances(spark):
    r = np.random.default_rng(6)
    m, y = r.normal(size=(4, 25)) + 1e6, r.normal(size=(2, 25))
    f, a = r.integers(1, 5, 25), r.random(25) + 0.1
    x = frame(spark, m, "DFloat")
    for ddof in (0, 1):
        assert np.allclose(dense(x.cov(ddof=ddof)), weighted(m, ddof, None, None))
        assert np.allclose(dense(x.cov(ddof=ddof, fweights=frame(spark, f, "Int64"), aweights=frame(spark, a, "DFloat"))), weighted(m, ddof, f, a))
    assert np.allclose(dense(x.cov(aweights=a.tolist())), weighted(m, 1, None, a))
    assert np.allclose(dense(x.cov(fweights=[int(k) for k in f])), weighted(m, 1, f, None))
    assert np.allclose(dense(x.cov(frame(spark, y, "DFloat"))), np.cov(m, y))
    assert np.isclose(frame(spark, y[0], "DFloat").cov().item(), np.var(y[0], ddof=1))
    z = y[:1] + 1j * y[1:]
    assert np.allclose(dense(frame(spark, np.concatenate([z, z * 2j]), "DComplex").cov()), np.cov(np.concatenate([z, z * 2j])))
    with pytest.raises(OperationError):
        frame(spark, m[:, :1], "DFloat").cov()
    with pytest.raises(ShapeError):
        x.cov(fweights=[1, 2])


@pytest.mark.parametrize("alpha", [1, -2.0])
def test_extremes_of_a_product_without_its_elements(spark, monkeypatch, alpha):
    from ndspark.operators import linear, tiles

    monkeypatch.setattr(linear, "BROADCAST_ELEMENTS", 0)
    monkeypatch.setattr(tiles, "SIDE", 7)
    monkeypatch.setattr(tiles, "BAND", 10)
    monkeypatch.setattr(tiles, "BLOCK", 50)
    r = np.random.default_rng(12)
    a, b = r.normal(size=(41, 5)), r.normal(size=(5, 23))
    a[3] = np.nan
    b[1, 4] = np.nan
    p = alpha * (a @ b)
    product = frame(spark, a, "DFloat").gemm(frame(spark, b, "DFloat"), alpha=alpha, side=3)
    for axis in (0, 1):
        assert np.allclose(dense(product.max(axis=axis)), np.fmax.reduce(p, axis=axis), equal_nan=True)
        assert np.allclose(dense(product.min(axis=axis)), np.fmin.reduce(p, axis=axis), equal_nan=True)
        assert np.allclose(dense(product.max(axis=axis, nan=True)), p.max(axis=axis), equal_nan=True)
        assert product.min(axis=axis, keepdims=True).shape == ((1, 23) if axis == 0 else (41, 1))
    assert np.isclose(product.max().item(), np.nanmax(p))


def test_shuffle_of_extremes_does_not_grow_with_the_product(spark, monkeypatch):
    from ndspark.operators import linear

    monkeypatch.setattr(linear, "BROADCAST_ELEMENTS", 0)
    x = frame(spark, np.random.default_rng(13).normal(size=(60, 4)), "DFloat")
    plan = x.gemm(x.transpose(), side=4).max(axis=1).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "tk" not in plan
