import numpy as np
import pytest

import rarefy as R

from .conftest import agree, holey

pytestmark = pytest.mark.filterwarnings("ignore::RuntimeWarning")
AXES = [None, 0, 2, (0, 2), -1]


@pytest.mark.parametrize("name", ["sum", "prod", "max", "min", "any", "all", "mean", "var", "std"])
def test_with_fills(spark, rng, name):
    for fill, axis, keepdims in ((0, None, False), (2, 1, True), (-1, (0, 2), False), (0, -1, False)):
        a = holey(rng, (3, 4, 2), fill=fill)
        agree(getattr(R, name)(R.from_numpy(a, fill), axis=axis, keepdims=keepdims), getattr(np, name)(a, axis=axis, keepdims=keepdims))


@pytest.mark.parametrize("name", ["sum", "prod", "max", "mean", "any"])
def test_types(spark, rng, name):
    for dtype in ("int32", "bool", "float32"):
        a = holey(rng, (3, 4), dtype=dtype)
        if not (name == "max" and dtype == "bool"):
            agree(getattr(R, name)(R.asarray(a), axis=0), getattr(np, name)(a, axis=0)) if dtype != "float32" else np.testing.assert_allclose(
                getattr(R, name)(R.asarray(a), axis=0).todense(), getattr(np, name)(a, axis=0), rtol=1e-5
            )


def test_nan(spark, rng):
    a = holey(rng, (4, 5))
    a[0, :3] = np.nan
    a[:, 4] = np.nan
    for name in ("nansum", "nanprod", "nanmax", "nanmin", "nanmean"):
        for axis in (0, 1):
            agree(getattr(R, name)(R.asarray(a), axis=axis), getattr(np, name)(a, axis=axis))
    for name in ("max", "min", "sum"):
        agree(getattr(R, name)(R.asarray(a), axis=1), getattr(np, name)(a, axis=1))
    filled = np.full((3, 3), np.nan)
    filled[0] = 1
    for name in ("nansum", "nanmax", "nanmean"):
        agree(getattr(R, name)(R.from_numpy(filled, np.nan), axis=1), getattr(np, name)(filled, axis=1))


def test_empty_and_ddof(spark):
    z = R.zeros((3, 4))
    agree(z.sum(axis=0), np.zeros(4))
    agree(z.sum(), np.float64(0))
    agree(z.max(), np.float64(0))
    agree(R.full((3, 4), 2.0).prod(axis=1), np.full(3, 16.0))
    a = np.array([[1.0, 0, 2], [0, 0, 3]])
    agree(R.var(R.asarray(a), axis=1, correction=1), a.var(axis=1, ddof=1))
    with pytest.raises(ValueError):
        R.asarray(a).sum(axis=2)


def test_other_ufuncs(spark):
    a = np.array([[1, 2, 0], [4, 0, 7]])
    x = R.asarray(a)
    agree(x.reduce(np.bitwise_xor, axis=1), np.bitwise_xor.reduce(a, axis=1))
    agree(x.reduce(np.bitwise_or, axis=0), np.bitwise_or.reduce(a, axis=0))
    agree(x.reduce(np.gcd, axis=1), np.gcd.reduce(a, axis=1))


def test_one_exchange_with_partial_sums(spark, rng):
    plan = R.asarray(holey(rng, (4, 5))).sum(axis=0).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
