"""Functions of tensors that are projections of the same rows: no exchange, and what grouping by coordinate gave."""

import numpy as np
import pytest

import rarefy as R

from .conftest import agree, holey


def _exchanges(tensor) -> int:
    plan = tensor.df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(k) for k in ("Aggregate", "Join", "Union"))


def _tensors(spark, rng):
    a = holey(rng, (7, 9), 0.5)
    a[0, :3] = 0.0, -0.0, 45.0
    x = R.asarray(a)
    i, j = np.indices(a.shape).reshape(2, -1)
    # every cell stored, zeros of both signs among them
    rows = spark.createDataFrame([(int(p), int(q), float(a[p, q])) for p, q in zip(i, j)], "i long, j long, w double")
    return a, x, R.from_df(rows, ["i", "j"], "w", a.shape)


CASES = {
    "where": (lambda m, x: m.where(x > 2, m.nan, x), 1),
    "where twice": (lambda m, x: m.where((x != 0) & (x != 3), (x - 60) / 7, 0.0), 1),
    "nested": (lambda m, x: m.where(x > 1, -m.inf, m.where(x < -1, m.inf, m.where(x == 0, 0.0, x - 4.5))), 1),
    "multiply": (lambda m, x: x * m.where(x > 0, x, 0.0), 1),
    "infinite": (lambda m, x: m.where(x > 2, m.inf, 0.0) * m.where(x < 0, x, 0.0), 1),
    "add": (lambda m, x: x + x * 2, 1),
    "maximum": (lambda m, x: m.maximum(x, m.where(x != 0, 5 - x, 0.0)), 1),
    "one tensor": (lambda m, x: m.where(True, x, 1.0), 1),
    "masks": (lambda m, x: m.logical_xor(x > 2, (x < 3) & (x != 0)), 1),
    "types": (lambda m, x: m.add(x.astype("int32"), x > 1), 1),
    "ternary": (lambda m, x: m.where(x + 1 > 2, x.astype("float32"), x * 3), 1),
    "stack": (lambda m, x: m.stack([x, x * 2, m.where(x > 1, x, 0.0)], axis=1), 1),
    "concat": (lambda m, x: m.concat([x, -x], axis=1), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_one_origin(spark, rng, name):
    f, most = CASES[name]
    a, sparse, full = _tensors(spark, rng)
    with np.errstate(all="ignore"):
        expected = f(np, a)
    for x in (sparse, full):
        got = f(R, x)
        assert _exchanges(got) <= most
        agree(got, expected)


def test_zero_without_a_sign(spark, rng):
    """Zeros of either sign aren't stored; what is made of them later is made of the fill value."""
    a, sparse, full = _tensors(spark, rng)
    for x in (sparse, full):
        agree(R.divide(1.0, x * 0.0), np.full(a.shape, np.inf))
        agree(R.divide(1.0, x * -0.0), np.full(a.shape, -np.inf))


def test_many_steps(spark, rng):
    a, x, _ = _tensors(spark, rng)
    for _ in range(4):
        a, x = np.where(a > 0, a / 2, a + a), R.where(x > 0, x / 2, x + x)
    agree(x, a)
