"""Array operations against values and plain Python."""

import itertools
import math

import numpy as np
import pytest

from ndspark.array import NDArray
from ndspark.errors import CastError, DimensionError, OperationError, ShapeError, ValueRangeError
from ndspark.operators import nn
from ndspark.sources import binary
from ndspark.sources.create import array, eye, full, linspace, ones, parse, seq, step_range, zeros
from ndspark.sources.random import Generator
from ndspark.sources.records import RecordType

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def a(spark):
    return array(spark, [1, 2, 3, 5, 7, 11])


@pytest.fixture(scope="module")
def b(spark):
    return array(spark, [[1, 2, 3], [5, 7, 11]])


CASES = {
    "b['all', 'sum']": [6, 23], "b['sum', 1]": 9, "b['new', '*', 0]": [[1, 5]], "b['rest', 0]": [1, 5], "b[1, '+']": 23,
    "b[1, 2]": 11, "b[3]": 5, "b[-1]": 11, "b[:, 1]": [2, 7], "b[..., 0]": [1, 5], "b[None, 0, :]": [[1, 2, 3]], "a[1:-1]": [2, 3, 5, 7], "a[::2]": [1, 3, 7], "a[-1:0:-2]": [11, 5, 2],
    "b[[0, 1], [0, 2]]": [[1, 3], [5, 11]], "b['reverse', 0]": [5, 1], "b.at([0, 1], [0, 2])": [1, 11], "b[b.gt(3)]": [5, 7, 11], "b[b.gt(100)]": [], "b.slice(0, 1)": [[2]], "a[a.gt(2).where()]": [3, 5, 7, 11],
    "a[array(spark, [[0, -1], [2, 2]])]": [[1, 11], [3, 3]], "b[:, [True, False, True]]": [[1, 3], [5, 11]], "b.gt(3).where()": [3, 4, 5], "b.gt(3).where2()[1]": [0, 1, 2],
    "b.assign((0, slice(None)), array(spark, [9, 8, 7]))": [[9, 8, 7], [5, 7, 11]], "b.assign((1, 1), 0)": [[1, 2, 3], [5, 0, 11]], "b.assign(b.gt(3), 0)": [[1, 2, 3], [0, 0, 0]],
    "b.transpose()": [[1, 5], [2, 7], [3, 11]], "b.swapaxes(0, 1)": [[1, 5], [2, 7], [3, 11]], "b.reverse()": [[11, 7, 5], [3, 2, 1]], "b.flipud()": [[5, 7, 11], [1, 2, 3]], "b.fliplr()": [[3, 2, 1], [11, 7, 5]],
    "b.rot90()": [[3, 11], [2, 7], [1, 5]], "b.rot90(2)": [[11, 7, 5], [3, 2, 1]], "b.rot90(3)": [[5, 1], [7, 2], [11, 3]], "b.reshape(3, None)": [[1, 2], [3, 5], [7, 11]], "b.flatten()": [1, 2, 3, 5, 7, 11],
    "b.expand_dims(1)": [[[1, 2, 3]], [[5, 7, 11]]], "b.diagonal()": [1, 7], "b.diagonal(-1)": [5], "b.trace()": 8, "b.triu()": [[1, 2, 3], [0, 7, 11]], "b.tril(-1)": [[0, 0, 0], [5, 0, 0]], "b.triu_indices()": [0, 1, 2, 4, 5],
    "a[0:2].diag(1)": [[0, 1, 0], [0, 0, 2], [0, 0, 0]], "b.split(2, 1)[0]": [[1, 2], [5, 7]], "b.hsplit([1])[1]": [[2, 3], [7, 11]], "b.delete(1, 1)": [[1, 3], [5, 11]], "a.delete([0, -1])": [2, 3, 5, 7],
    "b.sum()": 29, "b.sum(0)": [6, 9, 14], "b.sum([0, 1])": 29, "b.sum(-1, keepdims=True)": [[6], [23]], "b.prod(1)": [6, 385], "b.max(0)": [5, 7, 11], "b.min(1)": [1, 5], "b.ptp(1)": [2, 6], "b.minmax()[1]": 11,
    "b.max_index(0)": [3, 4, 5], "b.argmax(1)": [2, 2], "b.argmin()": 0, "array(spark, [3, 1, 1]).argmin()": 1, "array(spark, [3, 3, 1]).argmax()": 0, "b.median()": 4, "b.median(1)": [2, 7], "b.percentile(50, 0)": [3.0, 4.5, 7.0],
    "array(spark, [0, 1, 1, 3, 2, 1, 7]).bincount()": [1, 3, 1, 1, 0, 0, 0, 1], "array(spark, [[0, 1], [1, 3]]).bincount()": [[1, 1, 0, 0], [0, 1, 0, 1]], "array(spark, [1]).bincount(minlength=4)": [0, 1, 0, 0],
    "b.gt(2).count_true()": 4, "b.gt(2).count_false(1)": [2, 0], "b.gt(0).all()": True, "b.gt(20).any()": False, "b.gt(20).none()": True, "b.mulsum(b, axis=1)": [14, 195],
    "b.cumsum()": [[1, 3, 6], [11, 18, 29]], "b.cumsum(0)": [[1, 2, 3], [6, 9, 14]], "b.cumprod(1)": [[1, 2, 6], [5, 35, 385]], "a.cumprod()": [1, 2, 6, 30, 210, 2310], "a.diff()": [1, 1, 2, 2, 4], "a.diff(2)": [0, 1, 0, 2], "b.diff(1, 0)": [[4, 5, 8]],
    "array(spark, [[3, 1], [2, 0]]).sort()": [[0, 1], [2, 3]], "array(spark, [[3, 1], [2, 0]]).sort(1)": [[1, 3], [0, 2]], "array(spark, [3, 1, 2, 1]).sort_index()": [1, 3, 2, 0], "a.top(2)": [11, 7],
    "NDArray.concatenate([a, a[0:1]])": [1, 2, 3, 5, 7, 11, 1], "NDArray.vstack([a, a])[1, 5]": 11, "NDArray.hstack([b, b])": [[1, 2, 3, 1, 2, 3], [5, 7, 11, 5, 7, 11]], "NDArray.dstack([a[0:2], a[0:2]])": [[[1, 1], [2, 2]]],
    "NDArray.column_stack([a[0:2], a[0:2]])": [[1, 1], [2, 2]], "b.append(b, 0)": [[1, 2, 3], [5, 7, 11]] * 2, "b.append(b)": [1, 2, 3, 5, 7, 11] * 2, "a.insert(1, 99)": [1, 99, 2, 3, 5, 7, 11], "b.insert([0, 2], 5, axis=1)": [[5, 1, 2, 5, 3], [5, 5, 7, 5, 11]],
    "b.insert(1, [7, 8, 9], axis=0)": [[1, 2, 3], [7, 8, 9], [5, 7, 11]], "b.insert(1, [7, 8], axis=1)": [[1, 7, 2, 3], [5, 8, 7, 11]], "b.insert([0, 3], [8, 9], axis=1)": [[8, 1, 2, 3, 9], [8, 5, 7, 11, 9]], "b.insert(1, 9)": [1, 9, 2, 3, 5, 7, 11],
    "a.insert(2, [8, 9])": [1, 2, 8, 9, 3, 5, 7, 11], "b.tile(2)": [[1, 2, 3, 1, 2, 3], [5, 7, 11, 5, 7, 11]], "b.repeat(2, 1)": [[1, 1, 2, 2, 3, 3], [5, 5, 7, 7, 11, 11]], "b.repeat([1, 2], 0)": [[1, 2, 3], [5, 7, 11], [5, 7, 11]],
    "array(spark, [1, 10]).kron(array(spark, [5, 6]))": [5, 6, 50, 60], "b.dot(b.transpose())": [[14, 52], [52, 195]], "b.dot(array(spark, [1, 0, 2]))": [7, 27], "array(spark, [1, 2]).dot(b)": [11, 16, 25], "a.dot(a)": 209, "array(spark, [1, 2]).outer(array(spark, [3, 4]))": [[3, 4], [6, 8]], "array(spark, [3, 4]).outer(array(spark, [1, 2]), axis=0)": [[3, 6], [4, 8]],
    "array(spark, [[3, 1, 2], [2, 5, 8]]).cov()": [[1.0, -1.5], [-1.5, 9.0]], "array(spark, [1, 2, 3]).cov()": 1.0, "array(spark, [[1, 2, 3]]).cov(array(spark, [[1j, 2j, 3j]]))": [[1, -1j], [1j, 1]],
    "array(spark, [[3, 2, 7], [4, 2, 3]]).cov(array(spark, [6, 5, 4])).shape": (3, 3), "array(spark, [17, 20, 23]).divmod(array(spark, [5, 6, 7]))[1]": [2, 2, 2], "array(spark, [-7]) / 2": [-3], "array(spark, [-7]) % 2": [-1], "a ** 2": [1, 4, 9, 25, 49, 121], "a ** -1": [0] * 6,
    "array(spark, [1, -1, 5]).reciprocal()": [1, -1, 0], "-a[0:2]": [-1, -2], "2 - a[0:2]": [1, 0], "array(spark, [5]) & 3": [1], "~array(spark, [5])": [-6], "array(spark, [1]) << 3": [8], "a.clip(2, 5)": [2, 2, 3, 5, 5, 5], "seq(spark, 4, 1).poly(1, 2, 3)": [6, 17, 34, 57],
    "seq(spark, 4).poly()": [0, 1, 2, 3], "a.eq(3)": [False, False, True, False, False, False], "a[0:3] + array(spark, [[1], [2]])": [[2, 3, 4], [3, 4, 5]], "parse(spark, '1 2;3 4')": [[1, 2], [3, 4]], "parse(spark, '1 2\\n\\n3 4')": [[[1, 2]], [[3, 4]]],
    "array(spark, [[1, 2], [3]])": [[1, 2], [3, 0]], "step_range(spark, 1, 4)": [1, 2, 3, 4], "step_range(spark, 1, 4, 2, True)": [1, 3], "step_range(spark, 0.0, 1.0, 0.25)": [0.0, 0.25, 0.5, 0.75, 1.0], "linspace(spark, 0, 1, 3)": [0.0, 0.5, 1.0], "eye(spark, 2, 3, offset=1)": [[0, 1, 0], [0, 0, 1]],
    "seq(spark, 3, 254, 1, 'UInt8')": [254, 255, 0], "full(spark, 2, 7)": [7, 7], "array(spark, range(3))": [0, 1, 2], "zeros(spark, [2, 2]).store(array(spark, [1, 2]))": [[1, 2], [1, 2]], "zeros(spark, 4).store(array(spark, [1, 2]))": [1, 2, 0, 0],
    "array(spark, [1+2j, 3j]) * 1j": [-2 + 1j, -3 + 0j], "array(spark, [3+4j]).abs()": [5.0], "array(spark, [1+2j]).conj()": [1 - 2j], "array(spark, [1+2j]).im()": [-2 + 1j], "array(spark, [1+2j]).set_imag(9)": [1 + 9j], "array(spark, [1+1j, 2j]).sum()": 1 + 3j, "array(spark, [1+1j, 2j]).prod()": -2 + 2j,
    "array(spark, [1+1j]) ** 2": [2j], "array(spark, [1+2j]).eq(1+2j)": [True], "array(spark, [2.5, -2.5, 0.4]).round()": [3.0, -3.0, 0.0], "array(spark, [2.5, -2.5]).rint()": [2.0, -2.0], "array(spark, [1.5, -1.5]).trunc()": [1.0, -1.0], "array(spark, [1.5, -1.5]).modf()[0]": [0.5, -0.5],
    "array(spark, [1e300, INF, -INF]).floor()": [1e300, INF, -INF], "array(spark, [1., -1., 0.]) / 0.": [INF, -INF, NAN], "array(spark, [5.5, -5.5]) % 2.": [1.5, -1.5], "array(spark, [0., -0.0]).signbit()": [False, True], "array(spark, [1., 2.]).copysign(-1.0)": [-1.0, -2.0],
    "array(spark, [NAN, 1.]).clip(2., 3.)": [NAN, 2.0], "array(spark, [0., -1.]).math('log')": [-INF, NAN], "array(spark, [0.]).math('sinc')": [1.0], "array(spark, [8.]).math('frexp')[1]": [4], "array(spark, [3.]).math('hypot', 4.)": [5.0], "array(spark, [1.]).math('ldexp', 3)": [8.0],
    "array(spark, [0]).math('exp')": [1.0], "array(spark, [-1+0j]).math('sqrt')": [1j], "NDArray.maximum(array(spark, [1., NAN]), 0.)": [1.0, 0.0], "NDArray.maximum(array(spark, [1., NAN]), 0., nan=True)": [1.0, NAN], "array(spark, [NAN]).eq(NAN)": [False], "array(spark, [NAN]).ne(NAN)": [True], "array(spark, [NAN]).gt(1.)": [False],
    "a.map(lambda x: x + 1)": [2, 3, 4, 6, 8, 12], "a.map_with_index(lambda x, i: x * i)": [0, 2, 6, 15, 28, 55], "a[0:2].format_to_list('%03d')": ["001", "002"],
}


def same(x, y) -> bool:
    if isinstance(x, (list, tuple)):
        return isinstance(y, (list, tuple)) and len(x) == len(y) and all(map(same, x, y))
    if isinstance(x, float) and math.isnan(x):
        return isinstance(y, float) and math.isnan(y)
    if isinstance(x, complex) or isinstance(y, complex):
        return abs(x - y) < 1e-12
    return x == y


@pytest.mark.parametrize("text", CASES)
def test_value(spark, a, b, text):
    found = eval(text, globals() | {"spark": spark, "a": a, "b": b})  # noqa: S307
    found = found.to_list() if isinstance(found, NDArray) else found
    assert same(found, CASES[text]), found


ERRORS = {
    "b[6]": IndexError, "b[0, 3]": IndexError, "b[:, 0] + a": ShapeError, "a[0:4] + a[0:3]": ShapeError, "b[..., ..., 0]": IndexError, "a[::0]": IndexError, "b.reshape(4, 2)": ShapeError, "b.sum(2)": DimensionError, "b.transpose(0, 0)": DimensionError,
    "b.item()": CastError, "a.mean()": OperationError, "array(spark, [1j]).max()": OperationError, "array(spark, [1j]).gt(1j)": OperationError, "a.percentile(101)": ValueRangeError, "a.diff(6)": ShapeError, "a.outer(a, axis=1)": ValueRangeError, "array(spark, [-1]).bincount()": ValueRangeError,
    "a.clip()": ValueRangeError, "a.clip(5, 2)": OperationError, "NDArray.concatenate([a, b])": ShapeError, "a.tile(0)": ValueRangeError, "a.repeat(-1)": ValueRangeError, "b.gemm(b)": ShapeError, "b[a.gt(3)]": ShapeError, "b.mask(a.gt(3))": ShapeError, "parse(spark, '1 + 2 puts')": ValueRangeError,
    "zeros(spark, [1] * 13)": DimensionError, "array(spark, [1, 2]).gt(1).math('sin')": OperationError, "zeros(spark, 0).sum()": ShapeError, "Generator(1).rand(spark, 3, dtype='Int32')": ValueRangeError, "binary.from_binary(spark, b'123', 4)": ShapeError, "array(spark, [1.0]).cov()": (OperationError, ShapeError, ZeroDivisionError),
}


@pytest.mark.parametrize("text", ERRORS)
def test_error(spark, a, b, text):
    with pytest.raises(ERRORS[text]):
        eval(text, globals() | {"spark": spark, "a": a, "b": b})  # noqa: S307


def test_integer_division_by_zero_raises(spark):
    for op in ("div", "mod"):
        with pytest.raises(Exception, match="divided by 0"):
            getattr(array(spark, [1, 2]), op)(array(spark, [1, 0])).to_list()
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        array(spark, [-128], "Int8").abs().to_list()


def test_operations_on_one_base_need_no_join(spark, a):
    plan = ((a + a * 2).reverse() - a.reverse())._like((a.value), a.dtype).df._jdf.queryExecution().toString()
    assert "Join" not in ((a + a.square()) * a).df._jdf.queryExecution().toString() and "Join" not in plan


POLICY = {
    "sum": (lambda x: math.nan if any(map(math.isnan, x)) else sum(x), lambda x: sum(v for v in x if v == v)),
    "mean": (lambda x: math.nan if any(map(math.isnan, x)) else sum(x) / len(x), lambda x: (lambda y: sum(y) / len(y) if y else math.nan)([v for v in x if v == v])),
    "min": (lambda x: min([v for v in x if v == v], default=math.nan), lambda x: math.nan if any(map(math.isnan, x)) else min(x)),
    "max": (lambda x: max([v for v in x if v == v], default=math.nan), lambda x: math.nan if any(map(math.isnan, x)) else max(x)),
    "argmax": (lambda x: max(range(len(x)), key=lambda i: (x[i] == x[i], x[i] if x[i] == x[i] else 0, -i)), lambda x: next((i for i, v in enumerate(x) if v != v), max(range(len(x)), key=lambda i: (x[i] if x[i] == x[i] else 0, -i)))),
    "argmin": (lambda x: min(range(len(x)), key=lambda i: (x[i] != x[i], x[i] if x[i] == x[i] else 0, i)), lambda x: next((i for i, v in enumerate(x) if v != v), min(range(len(x)), key=lambda i: (x[i] if x[i] == x[i] else 0, i)))),
    "var": (lambda x: math.nan if any(map(math.isnan, x)) or len(x) == 1 else float(np.var(x, ddof=1)), lambda x: (lambda y: 0.0 if not y else math.nan if len(y) == 1 else float(np.var(y, ddof=1)))([v for v in x if v == v])),
    "prod": (lambda x: math.nan if any(map(math.isnan, x)) else math.prod(x), lambda x: math.prod(v for v in x if v == v)),
    "kahan_sum": (lambda x: math.nan if any(map(math.isnan, x)) else math.fsum(x), lambda x: math.fsum(v for v in x if v == v)),
}


@pytest.mark.parametrize("name", POLICY)
def test_nan_policy(spark, name):
    rows = [list(r) for r in itertools.product([NAN, 1.0, -2.5, 4.0], repeat=3)]
    x = array(spark, rows)
    for flag in (False, True):
        found = getattr(x, name)(axis=1, nan=flag)
        got = {r["i0"]: r["v"] for r in found.df.collect()}
        want = [POLICY[name][flag](r) for r in rows]
        assert all(same(got.get(i, 0.0), pytest.approx(w, nan_ok=True)) or math.isnan(w) and math.isnan(got[i]) for i, w in enumerate(want)), name


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitions_do_not_matter(spark, parts):
    rows = [(i, float((i * 37) % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "i0 bigint, v double").repartition(parts)
    x = NDArray.from_coo(df, [300])
    values = [v for _, v in rows]
    assert x.cumsum().to_list() == list(itertools.accumulate(values)) and x.sort().to_list() == sorted(values)
    assert x.sort_index().to_list() == sorted(range(300), key=lambda i: (values[i], i)) and x.argmax().item() == values.index(max(values))
    assert x.gt(50.0).where().to_list() == [i for i, v in enumerate(values) if v > 50] and x.median().item() == float(np.median(values))


def test_broadcast_against_numpy(spark):
    for s, t in (([3, 1], [1, 4]), ([2, 3], [3]), ([2, 1, 2], [3, 1]), ([1], [2, 2])):
        x, y = np.arange(np.prod(s)).reshape(s), np.arange(np.prod(t)).reshape(t) + 1
        assert (array(spark, x.tolist()) * array(spark, y.tolist())).to_list() == (x * y).tolist()


def test_binary_round_trip(spark, b, tmp_path):
    for t in ("Int8", "UInt16", "Int64", "SFloat", "DFloat", "DComplex"):
        x = b.cast_to(t)
        data = binary.to_binary(x)
        assert binary.from_binary(spark, data, x.shape, t).same_as(x)
        assert binary.swap_byte(binary.swap_byte(data, t), t) == data
    assert binary.to_binary(b.cast_to("Int32")) == np.array([[1, 2, 3], [5, 7, 11]], "<i4").tobytes()
    binary.save(b, str(tmp_path / "x"))
    assert binary.load(spark, str(tmp_path / "x")).same_as(b)


def test_weighted_covariance(spark):
    x, f, w = array(spark, [[3, 1, 2], [2, 5, 8]]), [1, 4, 2], [2, 0.5, 0.25]
    assert np.allclose(x.cov(ddof=0).to_list(), [[2 / 3, -1], [-1, 6]])
    assert np.allclose(x.cov(fweights=f).to_list(), [[0.6190476, -0.2857143], [-0.2857143, 4.2857143]])
    assert np.allclose(x.cov(aweights=w).to_list(), [[1.4230769, -2.6538461], [-2.6538461, 8.6538461]])
    assert np.allclose(x.cov(fweights=f, aweights=w).to_list(), [[1.1900826, -1.7851240], [-1.7851240, 5.3553719]])


def test_random_numbers(spark):
    x, y = Generator(7).rand(spark, 4000), Generator(7).rand(spark, [40, 100])
    assert x.to_list() == y.flatten().to_list() and abs(x.mean().item() - 0.5) < 0.02 and 0 <= x.min().item() and x.max().item() < 1
    g = Generator(7)
    z, w = g.rand_norm(spark, 4000, 2.0, 3.0), g.rand_norm(spark, 4000, 2.0, 3.0)
    assert abs(z.mean().item() - 2) < 0.2 and abs(z.stddev().item() - 3) < 0.2 and z.to_list() != w.to_list()
    assert set(Generator(1).rand(spark, 500, 5, 8, "Int16").to_list()) == {5, 6, 7}


def test_records(spark):
    r = RecordType().add("id", "Int32").add("x", "DFloat", [2]).array(spark, [(1, [1.0, 2.0]), {"id": 2, "x": [3.0, 4.0]}])
    assert r["id"].to_list() == [1, 2] and r["x"].to_list() == [[1.0, 2.0], [3.0, 4.0]]
    assert r.with_field("id", array(spark, [8, 9])).to_list() == [(8, [1.0, 2.0]), (9, [3.0, 4.0])]


# ---- neural nets --------------------------------------------------------------------------


def conv_plain(x, w, stride, pad):
    x = np.pad(x, [(0, 0), (0, 0), *[(p, p) for p in pad]])
    out = [(m - k) // s + 1 for m, k, s in zip(x.shape[2:], w.shape[2:], stride)]
    y = np.zeros((x.shape[0], w.shape[0], *out))
    for at in np.ndindex(*out):
        cut = tuple(slice(a * s, a * s + k) for a, s, k in zip(at, stride, w.shape[2:]))
        y[(slice(None), slice(None), *at)] = np.tensordot(x[(slice(None), slice(None), *cut)], w, [range(1, w.ndim)] * 2)
    return y


@pytest.mark.parametrize(("shape", "kernel", "stride", "pad"), [([2, 3, 5, 4], [2, 3, 2, 3], [1, 1], [0, 0]), ([1, 2, 6, 5], [3, 2, 3, 2], [2, 1], [1, 1]), ([1, 2, 3, 4, 3], [2, 2, 2, 2, 1], [1, 2, 1], [0, 0, 0])])
def test_convolution_and_its_gradients(spark, shape, kernel, stride, pad):
    g = np.random.default_rng(0)
    x, w = g.integers(-3, 4, shape).astype(float), g.integers(-3, 4, kernel).astype(float)
    y = conv_plain(x, w, stride, pad)
    sx, sw = array(spark, x.tolist()), array(spark, w.tolist())
    assert nn.conv(sx, sw, stride=stride, pad=pad).to_list() == y.tolist()
    gy = g.integers(-3, 4, y.shape).astype(float)
    gx, gw = np.zeros_like(x), np.zeros_like(w)
    for at in np.ndindex(*w.shape):
        one = np.zeros_like(w)
        one[at] = 1
        gw[at] = (conv_plain(x, one, stride, pad) * gy).sum()
    for at in np.ndindex(*x.shape):
        one = np.zeros_like(x)
        one[at] = 1
        gx[at] = (conv_plain(one, w, stride, pad) * gy).sum()
    sg = array(spark, gy.tolist())
    assert nn.conv_grad_w(sx, sg, kernel, stride=stride, pad=pad).to_list() == gw.tolist()
    assert nn.conv_transpose(sg, sw, stride=stride, pad=pad, out_size=shape[2:]).to_list() == gx.tolist()


def test_pooling(spark):
    x = np.array([[[[1.0, 5, 2, 0], [3, 4, 8, 8], [7, 0, 1, 2]]]])
    s = array(spark, x.tolist())
    assert nn.max_pool(s, 2).to_list() == [[[[5.0, 8.0]]]]
    assert nn.avg_pool(s, 2, stride=1).to_list() == [[[[3.25, 4.75, 4.5], [3.5, 3.25, 4.75]]]]
    assert nn.avg_pool(s, 2, 2, 1, pad_value=0).to_list()[0][0][0][0] == 0.25 and nn.avg_pool(s, 2, 2, 1).to_list()[0][0][0][0] == 1.0
    assert nn.max_pool_backward(s, array(spark, [[[[1.0, 2.0]]]]), 2).to_list() == [[[[0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]]]
    assert nn.avg_pool_backward(s, array(spark, [[[[4.0, 8.0]]]]), 2).to_list() == [[[[1, 1, 2, 2], [1, 1, 2, 2], [0, 0, 0, 0]]]]


def test_batch_norm(spark):
    x = np.random.default_rng(1).standard_normal((6, 3))
    gamma, beta, gy = np.array([[1.0, 2, 3]]), np.array([[0.5, 0, -1]]), np.random.default_rng(2).standard_normal((6, 3))
    to = lambda v: array(spark, v.tolist())
    y, mean, inv, rm, rv = nn.batch_norm(to(x), to(gamma), to(beta), zeros(spark, [1, 3]), ones(spark, [1, 3]))
    hat = (x - x.mean(0)) / np.sqrt(x.var(0) + 2e-5)
    assert np.allclose(y.to_list(), hat * gamma + beta) and np.allclose(rm.to_list(), 0.1 * x.mean(0)) and np.allclose(rv.to_list(), 0.9 + 0.1 * x.var(0, ddof=1))
    gx, ggamma, gbeta = nn.batch_norm_backward(to(x), to(gamma), to(gy))
    assert np.allclose(gbeta.to_list(), gy.sum(0)) and np.allclose(ggamma.to_list(), (gy * hat).sum(0))
    step = 1e-5
    bump = np.zeros_like(x)
    bump[2, 1] = step

    def loss(v):
        return ((v - v.mean(0)) / np.sqrt(v.var(0) + 2e-5) * gamma * gy).sum()

    assert gx.to_list()[2][1] == pytest.approx((loss(x + bump) - loss(x - bump)) / (2 * step), rel=1e-4)
    assert np.allclose(nn.fixed_batch_norm(to(x), to(gamma), to(beta), zeros(spark, [1, 3]), ones(spark, [1, 3])).to_list(), x / np.sqrt(1 + 2e-5) * gamma + beta)


def test_frexp_of_edges(spark):
    values = [0.0, 1.0, 0.5, -8.0, 3.0, 5e-324, 2.0**-1074 * 3, 2.2250738585072014e-308, 1.7976931348623157e308, -0.1, 1 - 2.0**-53, 2.0**1023, 1e300]
    mantissas, exponents = array(spark, values).math("frexp")
    assert list(zip(mantissas.to_list(), exponents.to_list())) == [math.frexp(v) for v in values]
    mantissas, exponents = array(spark, [math.inf, -math.inf]).math("frexp")
    assert mantissas.to_list() == [math.inf, -math.inf] and exponents.to_list() == [0, 0]


def test_ranks_with_one_dominant_value(spark):
    values = [7.0] * 500 + [1.0, 2.0, 9.0, -3.0]
    x = array(spark, values)
    assert x.median().item() == 7.0
    assert [x.percentile(q).item() for q in (0, 0.1, 50, 99.9, 100)] == pytest.approx([np.percentile(values, q) for q in (0, 0.1, 50, 99.9, 100)])
    assert array(spark, [4, 1, 2, 9]).percentile(50).item() == 3.0


def test_scan_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        values = [float(v % 13) - 6 for v in range(1000)]
        assert array(spark, values).cumsum().to_list() == np.cumsum(values).tolist()
        assert array(spark, [1.0, 2.0, -0.5, 3.0]).cumprod().to_list() == [1.0, 2.0, -1.0, -3.0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_error_functions_have_full_precision(spark):
    import math

    xs = [k / 64 for k in range(-448, 449)] + [0.46874999, 0.46875, 3.9999, 4.0, 4.0001, 5.99, 6.0, 7.5, 12.25, 26.0, 26.5, 28.0, 1e-300, 1e300, float("inf"), -float("inf"), float("nan"), -0.0]
    a = array(spark, xs)
    for name, f in (("erf", math.erf), ("erfc", math.erfc)):
        got = a.math(name)
        assert "Python" not in got.df._jdf.queryExecution().executedPlan().toString()
        for x, y in zip(xs, got.to_list()):
            assert y == pytest.approx(f(x), rel=2e-15, abs=1e-300, nan_ok=True), (name, x)


def test_mantissas_and_exponents(spark):
    import math

    xs = [0.0, -0.0, 1.0, -1.0, 0.5, 3.0, 5e-324, -2.0**-1060, 2.0**1023, 1.7976931348623157e308, *(2.0**k for k in range(-1074, 1024, 61)), *(2.0**k * (1 - 2.0**-53) for k in range(-900, 1000, 97)), float("inf"), -float("inf"), float("nan")]
    m, e = array(spark, xs).math("frexp")
    assert "Python" not in m.df._jdf.queryExecution().executedPlan().toString()
    for x, a, b in zip(xs, m.to_list(), e.to_list()):
        want = math.frexp(x) if math.isfinite(x) else (x, 0)
        assert (repr(a), b) == (repr(want[0]), want[1]), x
