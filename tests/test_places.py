"""Insertion, repetition and deletion at places that an array holds, against NumPy."""

import numpy as np
import pytest

from ndspark.errors import ValueRangeError
from ndspark.operators import combine, indexing
from ndspark.sources.create import array
from tests.test_tiles import dense, frame


def test_insert_at_places_of_an_array(spark, monkeypatch):
    r = np.random.default_rng(1)
    v, places, new = r.normal(size=20), r.integers(-21, 21, 60), r.normal(size=60)
    places[10:30] = 7  # one place takes a third of all
    want = np.insert(v, [p % 21 for p in places], new)
    x = frame(spark, v, "DFloat")
    assert np.allclose(dense(x.insert(frame(spark, places, "Int64"), frame(spark, new, "DFloat"))), want)
    monkeypatch.setattr(combine, "FEW", 5)
    assert np.allclose(dense(x.insert([int(p) for p in places], frame(spark, new, "DFloat"))), want)
    m = r.normal(size=(3, 4))
    assert np.allclose(dense(frame(spark, m, "DFloat").insert(array(spark, [1, 4, 1]), -1.0, axis=1)), np.insert(m, [1, 4, 1], -1.0, axis=1))
    with pytest.raises(Exception, match="out of range"):
        x.insert(array(spark, [22]), 0.0).to_list()


def test_repeat_by_an_array(spark, monkeypatch):
    monkeypatch.setattr(combine, "SPAN", 3)
    r = np.random.default_rng(2)
    m, times = r.normal(size=(5, 2)), np.array([0, 10, 1, 0, 4])
    x = frame(spark, m, "DFloat")
    assert np.allclose(dense(x.repeat(frame(spark, times, "Int64"), axis=0)), np.repeat(m, times, axis=0))
    assert np.allclose(dense(x.repeat([2, 7], axis=1)), np.repeat(m, [2, 7], axis=1))
    assert np.allclose(dense(x.repeat(8)), np.repeat(m, 8))
    for wrong in ([1, 2], [1, -1, 0, 0, 0]):
        with pytest.raises(ValueRangeError):
            x.repeat(array(spark, wrong), axis=0)


def test_delete_at_places_of_an_array(spark, monkeypatch):
    v = np.arange(30.0)
    gone = np.array([0, 5, 5, -1, 12])
    x = frame(spark, v, "DFloat")
    assert dense(x.delete(frame(spark, gone, "Int64"))).tolist() == np.delete(v, gone).tolist()
    monkeypatch.setattr(indexing, "FEW", 2)
    assert dense(x.delete([int(g) for g in gone])).tolist() == np.delete(v, gone).tolist()
    m = v.reshape(5, 6)
    assert (dense(frame(spark, m, "DFloat").delete(array(spark, [1, 3, 1]), axis=1)) == np.delete(m, [1, 3], axis=1)).all()
    assert x.delete(list(range(30))).shape == (0,)
