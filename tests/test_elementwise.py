import warnings

import numpy as np
import pytest

import rarefy as R

from .conftest import agree, holey

pytestmark = pytest.mark.filterwarnings("ignore::RuntimeWarning")
SPECIAL = np.array([0.0, 1.0, -1.0, 0.5, -2.5, 3.0, np.inf, -np.inf, np.nan, 7.5])
UNARY = (
    "negative positive square abs sign sqrt exp expm1 log log1p log2 log10 sin cos tan asin acos atan sinh cosh tanh asinh acosh "
    "atanh ceil floor trunc rint reciprocal isnan isinf isfinite isposinf isneginf signbit logical_not"
).split()
BINARY = (
    "add subtract multiply divide floor_divide remainder pow maximum minimum fmax fmin equal not_equal greater greater_equal less less_equal "
    "hypot atan2 copysign logaddexp logical_and logical_or logical_xor"
).split()


def numpy_of(name):
    from rarefy.functions.registry import REGISTRY

    return REGISTRY[name].numpy


def test_unary_special_values(spark):
    x = R.asarray(SPECIAL)
    wide = None
    for name in UNARY:
        df = R.elemwise(name, x)
        assert df.dtype == numpy_of(name)(SPECIAL).dtype, name
        got = df.df.withColumnRenamed("v", name)
        wide = got if wide is None else wide.join(got, "d0", "full")
    rows = wide.toPandas().set_index("d0").reindex(range(len(SPECIAL)))
    for name in UNARY:
        expected = numpy_of(name)(SPECIAL)
        fill = numpy_of(name)(np.float64(0))
        got = np.array([fill if v is None or (isinstance(v, float) and v != v and not is_stored(rows, name, i, expected)) else v for i, v in enumerate(rows[name])])
        np.testing.assert_allclose(got.astype(float), expected.astype(float), rtol=1e-12, equal_nan=True, err_msg=name)


def is_stored(rows, name, i, expected):
    # pandas shows a missing cell as NaN too: a NaN is right where it is expected
    return np.isnan(float(expected[i]))


@pytest.mark.parametrize("name", BINARY)
def test_binary_special_values(spark, name):
    a, b = np.repeat(SPECIAL, len(SPECIAL)), np.tile(SPECIAL, len(SPECIAL))
    expected = numpy_of(name)(a, b)
    got = R.elemwise(name, R.asarray(a), R.asarray(b)).todense()
    if name == "atan2":  # the sign of a zero may differ
        got, expected = np.abs(got), np.abs(expected)
    np.testing.assert_allclose(got.astype(float), expected.astype(float), rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("shapes", [((2, 3, 4), (3, 4)), ((3, 1, 4), (3, 2, 4)), ((1, 5), (5, 1)), ((3, 1), (1, 4)), ((2, 2, 2), (1, 1, 1)), ((4,), (4,))])
def test_broadcasting(spark, rng, shapes):
    a, b = (holey(rng, s) for s in shapes)
    x, y = R.asarray(a), R.asarray(b)
    agree(x + y, a + b)
    agree(x * y, a * b)
    agree(R.where(x > y, x, 2.0), np.where(a > b, a, 2.0))


def test_non_zero_fills(spark, rng):
    a, b = holey(rng, (5, 6), fill=1), holey(rng, (5, 6), fill=-2)
    x, y = R.from_numpy(a, 1), R.from_numpy(b, -2)
    s = x - y
    assert s.fill_value == 3
    agree(s, a - b)
    agree(x * y, a * b)
    agree(x / 2 + 1, a / 2 + 1)


def test_zero_does_not_annihilate_what_is_not_finite(spark):
    a, b = np.array([[np.inf, 0, 2], [0, np.nan, 1]]), np.array([[0.0, 3, 2]])
    agree(R.asarray(a) * R.asarray(b), a * b)


def test_integers_wrap_and_divide_like_numpy(spark):
    a = np.array([-7, -3, 0, 3, 7, 100], "int64")
    for b in (-3, 2, 0):
        agree(R.asarray(a) // b, a // b)
        agree(R.asarray(a) % b, a % b)
    small = np.array([100, 127, -128], "int8")
    agree(R.asarray(small) + np.int8(100), small + np.int8(100))
    agree(R.asarray(small) * R.asarray(small), small * small)


def test_bits_and_shifts(spark):
    a, b = np.array([0, 1, -1, 5, 1 << 40]), np.array([3, 0, 65, 2, 1])
    x, y = R.asarray(a), R.asarray(b)
    for f in (np.bitwise_and, np.bitwise_or, np.bitwise_xor):
        agree(f(x, y), f(a, b))
    agree(~x, ~a)
    agree(x << y, np.where(b < 64, a << np.minimum(b, 63), 0))
    agree(x >> y, np.where(b < 64, a >> np.minimum(b, 63), np.where(a < 0, -1, 0)))


def test_any_callable_and_several_operands(spark, rng):
    arrays = [holey(rng, s) for s in ((2,), (3, 2), (4, 3, 2))]
    f = lambda a, b, c: a * b + np.cbrt(c)
    agree(R.elemwise(f, *map(R.asarray, arrays)), f(*arrays))
    agree(R.nextafter(R.asarray(arrays[0]), 1.0), np.nextafter(arrays[0], 1.0))


def test_dense_operands(spark, rng):
    a, d = holey(rng, (3, 4)), rng.random((3, 4)) + 1
    agree(R.asarray(a) * d, a * d)
    agree(R.asarray(a) + d, a + d)  # dense: an array
    with pytest.raises(ValueError, match="dense"):
        R.asarray(a) + d[0]
    with pytest.raises(ValueError, match="broadcast"):
        R.asarray(a) + R.asarray(np.ones((2, 2)))
    with pytest.raises(ValueError):
        R.elemwise(np.add, d, d)


def test_complex(spark, rng):
    a, b = holey(rng, (3, 3), dtype="complex128"), holey(rng, (3, 3), dtype="complex128")
    x, y = R.asarray(a), R.asarray(b)
    agree(x * y, a * b)
    agree(x + y, a + b)
    agree(x.conj(), a.conj())
    agree(abs(x), abs(a))
    agree(x.real, a.real)
    agree(x.imag, a.imag)
    agree(x.sum(axis=0), a.sum(axis=0))
    agree(x @ y, a @ b)


def test_casts_rounding_limits(spark, rng):
    a = holey(rng, (4, 5))
    x = R.asarray(a)
    for kind in ("int32", "bool", "float32", "complex128"):
        agree(x.astype(kind), a.astype(kind))
    agree(R.asarray(np.array([300, -1])).astype("uint8"), np.array([300, -1]).astype("uint8"))
    agree(R.round(x, 1), np.round(a, 1))
    agree(R.clip(x, -3, 4), np.clip(a, -3, 4))
    agree(R.clip(x, 1, None), np.clip(a, 1, None))
    agree(R.interp(x, [0, 5], [0, 1]), np.interp(a, [0, 5], [0, 1]))
    with pytest.raises(ValueError):
        R.clip(x)


def test_results_are_pruned_and_lazy(spark):
    x = R.asarray(np.array([1.0, 2.0, 0.0]))
    assert (x - x).nnz == 0
    assert (x == 1).nnz == 1
    assert not (x == 2).fill_value


def test_protocols(spark):
    a = np.array([[0.0, 2.0], [3.0, 0.0]])
    x = R.asarray(a)
    agree(np.add(x, 1), a + 1)
    agree(np.add.reduce(x, axis=1), a.sum(axis=1))
    agree(np.multiply.outer(x, R.asarray(a[0])), np.multiply.outer(a, a[0]))
    agree(np.sum(x, axis=0), a.sum(axis=0))
    agree(np.concatenate([x, x]), np.concatenate([a, a]))
    y = R.asarray(a)
    y += 1
    agree(y, a + 1)
    assert float(x.sum()) == 5.0
    with pytest.raises(RuntimeError), warnings.catch_warnings():
        np.asarray(x)
    assert x.__array_namespace__().pi == R.pi
