"""Element types: promotion, limits, casts, wrapping."""

import math

import pytest

from ndspark import dtypes as dt
from ndspark.errors import CastError
from ndspark.sources.create import array

SIGNED = [dt.Int8, dt.Int16, dt.Int32, dt.Int64]
UNSIGNED = [dt.UInt8, dt.UInt16, dt.UInt32, dt.UInt64]
FLOATS, COMPLEX = [dt.SFloat, dt.DFloat], [dt.SComplex, dt.DComplex]


@pytest.mark.parametrize("t", list(dt.ALL.values()), ids=str)
def test_promotion_with_itself_and_bits(t):
    assert dt.upcast(t, t) == dt.upcast(t, dt.Bit) == dt.upcast(dt.Bit, t) == t


def test_promotion_of_integers():
    for i, a in enumerate(SIGNED):
        for j, b in enumerate(SIGNED):
            assert dt.upcast(a, b) == SIGNED[max(i, j)]
            assert dt.upcast(UNSIGNED[i], UNSIGNED[j]) == UNSIGNED[max(i, j)]
            assert dt.upcast(UNSIGNED[i], b) == SIGNED[max(i, j)]
    assert [dt.upcast(dt.Int8, u) for u in UNSIGNED] == [dt.Int16, dt.Int32, dt.Int64, dt.Int64]
    assert [dt.upcast(dt.Int16, u) for u in UNSIGNED] == [dt.Int16, dt.Int16, dt.Int32, dt.Int64]
    assert dt.upcast(dt.UInt8, dt.Int8) == dt.Int8


def test_promotion_of_floats_and_complex():
    for a in SIGNED + UNSIGNED:
        for f in FLOATS + COMPLEX:
            assert dt.upcast(a, f) == dt.upcast(f, a) == f
    assert dt.upcast(dt.SFloat, dt.DFloat) == dt.upcast(dt.DFloat, dt.SFloat) == dt.DFloat
    assert dt.upcast(dt.DFloat, dt.SComplex) == dt.upcast(dt.SComplex, dt.DFloat) == dt.DComplex
    assert dt.upcast(dt.SFloat, dt.SComplex) == dt.SComplex


def test_scalars():
    assert dt.upcast_scalar(dt.Int8, 5) == dt.Int8 and dt.upcast_scalar(dt.Int8, 1.5) == dt.DFloat
    assert dt.upcast_scalar(dt.SFloat, 1.5) == dt.SFloat and dt.upcast_scalar(dt.SFloat, 1j) == dt.SComplex and dt.upcast_scalar(dt.UInt16, 1j) == dt.DComplex


def test_limits():
    assert (dt.Int8.minimum, dt.Int8.maximum, dt.UInt64.maximum) == (-128, 127, 2**64 - 1)
    assert dt.DFloat.epsilon == 2.0**-52 and dt.SFloat.epsilon == 2.0**-23 and dt.DFloat.maximum == 1.7976931348623157e308


@pytest.mark.parametrize("t", SIGNED + UNSIGNED, ids=str)
def test_casts_wrap(spark, t):
    values = [0, 1, -1, 127, 128, 255, 256, 65535, 65536, -129, 2**31, 2**32, -(2**31) - 1, 2**62, -(2**63)]
    low, span = t.minimum, 1 << t.bits
    want = [(v - low) % span + low for v in values]
    assert [int(x) for x in array(spark, values, "Int64").cast_to(t).to_list()] == want


def test_casts_of_floats(spark):
    a = array(spark, [1.9, -1.9, 300.0, -1.0])
    assert a.cast_to("Int8").to_list() == [1, -1, 44, -1] and a.cast_to("UInt8").to_list() == [1, 255, 44, 255]
    assert array(spark, [0.0, 2.0]).cast_to("Bit").to_list() == [False, True] and array(spark, [True, False]).cast_to("DFloat").to_list() == [1.0, 0.0]
    assert math.isnan(array(spark, [None, 1.0], "DFloat").to_list()[0])
    with pytest.raises(CastError):
        array(spark, [1j]).cast_to("DFloat")
    with pytest.raises(CastError):
        dt.of("Float16")


@pytest.mark.parametrize("t", SIGNED + UNSIGNED, ids=str)
def test_wrapping_arithmetic(spark, t):
    top, low, span = t.maximum, t.minimum, 1 << t.bits
    a = array(spark, [0, 1]).cast_to(t)._like(dt.literal(top, t), t)
    for op, want in (("add", top + 3), ("sub", top - 3), ("mul", top * 3)):
        assert int(getattr(a, op)(3, wrap=True).to_list()[0]) == (want - low) % span + low
    with pytest.raises(Exception, match="(?i)overflow"):
        a.add(3).to_list()
