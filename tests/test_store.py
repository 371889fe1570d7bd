"""Stored arrays: round trips, and slices that read only their chunks."""

import numpy as np
import pytest

from ndspark.errors import DimensionError, OperationError, ShapeError
from ndspark.sources import binary, store
from ndspark.sources.create import array, zeros
from tests.test_tiles import dense, frame


def files_read(a):
    """Files that a scan of the array opened."""
    df = a.df
    df.collect()
    leaves, plan = [], df._jdf.queryExecution().executedPlan().collectLeaves()
    for k in range(plan.size()):
        leaves.append(plan.apply(k).metrics().apply("numFiles").value())
    return sum(leaves)


def test_slices_read_their_chunks(spark, tmp_path):
    m = np.arange(60 * 20).reshape(60, 20)
    store.save(frame(spark, m, "Int64"), str(tmp_path / "a"), [10, 5])
    a = store.load(spark, str(tmp_path / "a"))
    assert a.shape == (60, 20) and a.dtype.name == "Int64"
    assert (dense(a) == m).all() and files_read(a) >= 24
    one = a[12:18, 5:9]
    assert (dense(one) == m[12:18, 5:9]).all() and files_read(one) <= 2
    assert (dense(a[-1, True]) == m[-1]).all() and files_read(a[-1, True]) <= 8
    some = a[[3, 57, 4], 0:5]
    assert (dense(some) == m[[3, 57, 4], 0:5]).all()
    assert (dense(a[55:5:-20, True]) == m[55:5:-20]).all()
    assert a.sum().item() == m.sum() and (dense(a.transpose()[0:2, True]) == m.T[:2]).all()


def test_types_survive(spark, tmp_path):
    for k, (values, dtype) in enumerate([([1.5, float("nan"), -0.0], "DFloat"), ([1 + 2j, 3j], "DComplex"), ([True, False], "Bit"), ([1, 255], "UInt8"), ([3, 2**62], "UInt64"), ([0.5], "SFloat")]):
        a = array(spark, values, dtype)
        store.save(a, str(tmp_path / str(k)))
        b = store.load(spark, str(tmp_path / str(k)))
        assert b.dtype == a.dtype and str(b.to_list()) == str(a.to_list())
    store.save(zeros(spark, [0]), str(tmp_path / "none"))
    assert store.load(spark, str(tmp_path / "none")).to_list() == []


def test_what_is_refused(spark, tmp_path):
    a = zeros(spark, [200, 200])
    with pytest.raises(ShapeError):
        store.save(a, str(tmp_path / "x"), [1, 1])
    with pytest.raises(DimensionError):
        store.save(a, str(tmp_path / "x"), [5])
    binary.save(zeros(spark, [3]), str(tmp_path / "old"))
    with pytest.raises(OperationError):
        store.load(spark, str(tmp_path / "old"))


def test_default_grids():
    assert store.default_chunks([5, 7]) == [5, 7]
    edges = store.default_chunks([10**9, 64])
    assert np.prod([-(-n // e) for n, e in zip([10**9, 64], edges)]) <= store.USUAL_CHUNKS and edges[1] == 64
