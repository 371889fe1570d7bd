"""Convolutions and pools on overlapping tiles against plain loops."""

import itertools

import numpy as np
import pytest

from ndspark.array import NDArray
from ndspark.operators import halo, nn
from tests.test_tiles import dense, frame


@pytest.fixture(params=[False, True])
def small_tiles(request, monkeypatch):
    """Tiles of two results along an axis, or whole images."""
    if request.param:
        monkeypatch.setattr(nn, "axes", lambda x, out, kernel, stride, pad, channels, back=False: [halo.Axis(*v, 2, back) for v in zip(x, out, kernel, stride, pad)])
    return request.param


def windows(x, kernel, stride, pad, fill):
    """(position, window) of every result."""
    n = len(kernel)
    wide = np.full((*x.shape[:2], *(m + 2 * p for m, p in zip(x.shape[2:], pad))), fill)
    wide[(slice(None), slice(None), *(slice(p, p + m) for m, p in zip(x.shape[2:], pad)))] = x
    size = [(m - k) // s + 1 for m, k, s in zip(wide.shape[2:], kernel, stride)]
    for at in itertools.product(*map(range, size)):
        yield at, size, wide[(slice(None), slice(None), *(slice(at[j] * stride[j], at[j] * stride[j] + kernel[j]) for j in range(n)))]


CASES = [((2, 3, 7, 6), (4, 3, 3, 2), [1, 1], [0, 0]), ((2, 2, 8, 5), (3, 2, 3, 3), [2, 3], [1, 2]), ((1, 2, 5, 4, 6), (2, 2, 2, 1, 3), [1, 2, 2], [1, 0, 1]), ((2, 1, 9, 9), (1, 1, 2, 2), [3, 4], [0, 1])]


@pytest.mark.parametrize("shape, kernel, stride, pad", CASES)
def test_convolutions(spark, small_tiles, shape, kernel, stride, pad):
    r = np.random.default_rng(3)
    x, w = r.normal(size=shape), r.normal(size=kernel)
    found = {at: np.tensordot(win, w, (range(1, x.ndim), range(1, x.ndim))) for at, _, win in windows(x, kernel[2:], stride, pad, 0.0)}
    size = next(windows(x, kernel[2:], stride, pad, 0.0))[1]
    y = np.zeros((shape[0], kernel[0], *size))
    for at, v in found.items():
        y[(slice(None), slice(None), *at)] = v
    sx, sw = frame(spark, x, "DFloat"), frame(spark, w, "DFloat")
    assert np.allclose(dense(nn.conv(sx, sw, stride=stride, pad=pad)), y)
    gy = r.normal(size=y.shape)
    sg = frame(spark, gy, "DFloat")
    gw = np.zeros(kernel)
    gx = np.zeros((*shape[:2], *(m + 2 * p for m, p in zip(shape[2:], pad))))
    for at, _, win in windows(x, kernel[2:], stride, pad, 0.0):
        g = gy[(slice(None), slice(None), *at)]
        gw += np.tensordot(g, win, (0, 0))
        gx[(slice(None), slice(None), *(slice(a * s, a * s + k) for a, s, k in zip(at, stride, kernel[2:])))] += np.tensordot(g, w, (1, 0))
    gx = gx[(slice(None), slice(None), *(slice(p, p + m) for p, m in zip(pad, shape[2:])))]
    assert np.allclose(dense(nn.conv_grad_w(sx, sg, kernel, stride=stride, pad=pad)), gw)
    assert np.allclose(dense(nn.conv_transpose(sg, sw, stride=stride, pad=pad, out_size=shape[2:])), gx)


@pytest.mark.parametrize("kernel, stride, pad", [([3, 2], [1, 1], [0, 0]), ([3, 3], [2, 1], [1, 1]), ([5, 4], [2, 3], [2, 1]), ([2, 2], [3, 3], [1, 0])])
def test_pools(spark, small_tiles, kernel, stride, pad):
    r = np.random.default_rng(4)
    x = r.integers(0, 4, (2, 2, 7, 8)).astype(float)  # many ties
    s = frame(spark, x, "DFloat")
    size = next(windows(x, kernel, stride, pad, 0.0))[1]
    most, mean, padded = (np.zeros((2, 2, *size)) for _ in range(3))
    gy = r.normal(size=most.shape)
    wide = [m + 2 * p for m, p in zip(x.shape[2:], pad)]
    gmax, gmean, gpad = (np.zeros((2, 2, *wide)) for _ in range(3))
    for at, _, win in windows(x, kernel, stride, pad, np.nan):
        for n, c in itertools.product(range(2), range(2)):
            v, g = win[n, c], gy[(n, c, *at)]
            most[(n, c, *at)], mean[(n, c, *at)], padded[(n, c, *at)] = np.nanmax(v), np.nanmean(v), np.nansum(v) / v.size
            part = (n, c, *(slice(a * t, a * t + k) for a, t, k in zip(at, stride, kernel)))
            first = np.zeros(v.size)
            first[np.nanargmax(v)] = g
            gmax[part] += first.reshape(v.shape)
            gmean[part] += ~np.isnan(v) * g / (~np.isnan(v)).sum()
            gpad[part] += g / v.size
    inner = (slice(None), slice(None), *(slice(p, p + m) for p, m in zip(pad, x.shape[2:])))
    sg = frame(spark, gy, "DFloat")
    assert np.allclose(dense(nn.max_pool(s, kernel, stride, pad)), most)
    assert np.allclose(dense(nn.avg_pool(s, kernel, stride, pad)), mean)
    assert np.allclose(dense(nn.avg_pool(s, kernel, stride, pad, pad_value=0)), padded)
    assert np.allclose(dense(nn.max_pool_backward(s, sg, kernel, stride, pad)), gmax[inner])
    assert np.allclose(dense(nn.avg_pool_backward(s, sg, kernel, stride, pad)), gmean[inner])
    assert np.allclose(dense(nn.avg_pool_backward(s, sg, kernel, stride, pad, pad_value=0)), gpad[inner])


def test_images_in_rows_of_a_source_are_not_shuffled(spark):
    m = np.random.default_rng(6).normal(size=(5, 24))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "i bigint, r array<double>")
    x = NDArray.from_rows(df, "r", "i", 24).reshape(5, 2, 3, 4)
    w = np.random.default_rng(7).normal(size=(2, 2, 2, 3))
    for pad in (0, 1):
        got = nn.conv(x, frame(spark, w, "DFloat"), pad=pad)
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert np.allclose(dense(got), dense(nn.conv(frame(spark, m.reshape(5, 2, 3, 4), "DFloat"), frame(spark, w, "DFloat"), pad=pad)))
    # results that need fewer inputs than there are
    assert np.allclose(dense(nn.max_pool(x, 2, 3)), m.reshape(5, 2, 3, 4)[:, :, :2, :2].max((2, 3), keepdims=True))


def test_kernels_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "KERNEL", 40)
    r = np.random.default_rng(8)
    x, w = r.normal(size=(1, 3, 5, 5)), r.normal(size=(5, 3, 2, 2))
    want = np.zeros((1, 5, 4, 4))
    for at, _, win in windows(x, [2, 2], [1, 1], [0, 0], 0.0):
        want[(slice(None), slice(None), *at)] = np.tensordot(win, w, (range(1, 4), range(1, 4)))
    assert np.allclose(dense(nn.conv(frame(spark, x, "DFloat"), frame(spark, w, "DFloat"))), want)


def test_running_extremes_of_any_size():
    a = np.random.default_rng(9).normal(size=(2, 50))
    for k in (1, 2, 7, 31, 50):
        for step in (1, 3):
            plain = np.stack([a[:, i : i + k].max(1) for i in range(0, 50 - k + 1, step)], 1)
            assert (halo.running(a, 1, k, step, np.maximum, -np.inf) == plain).all()
            sums = np.stack([a[:, i : i + k].sum(1) for i in range(0, 50 - k + 1, step)], 1)
            assert np.allclose(halo.running(a, 1, k, step, np.add, 0.0), sums)
