import numpy as np
import pytest

import rarefy as R

from .conftest import agree, holey

EINSUMS = [
    "ij->ji", "ij->", "ii->i", "ii->", "ij,jk->ik", "ij,jk", "ij,ij->ij", "i,j->ij", "ijk,jil->kl", "ij,kj,kl->il", "ab,bc,cd,de->ae", "aab,bc->c", "i,i,i->", "ijk->j",
    "...j,jk->...k", "...,...->...", "ij...->i...", "ab,ab,c->c", "abc,bad->cd",
]


@pytest.mark.parametrize("text", EINSUMS)
def test_einsum(spark, rng, text):
    terms = text.split("->")[0].split(",")
    arrays = [holey(rng, (3,) * (len(t.replace("...", "")) + ("..." in t))) for t in terms]
    agree(R.einsum(text, *map(R.asarray, arrays)), np.einsum(text, *arrays))


def test_einsum_forms(spark, rng):
    a, b = holey(rng, (3, 4)), holey(rng, (4, 5))
    x, y = R.asarray(a), R.asarray(b)
    agree(R.einsum(x, [0, 1], y, [1, 2], [0, 2]), np.einsum(a, [0, 1], b, [1, 2], [0, 2]))
    agree(R.einsum(x, [0, 1], y, [1, 2]), np.einsum(a, [0, 1], b, [1, 2]))
    for bad in ("ij,jk->iz", "ij", "i.j,jk", "ij,jk->i->k"):
        with pytest.raises(ValueError):
            R.einsum(bad, x, y)


@pytest.mark.parametrize("shapes", [((3, 4), (4, 3)), ((3, 1, 6, 5), (2, 1, 4, 5, 6)[1:]), ((1, 1, 5), (3, 5, 6)), ((4, 5), (5,)), ((5,), (5, 6)), ((5,), (5,)), ((3, 4), (1, 2, 4, 3))])
def test_matmul(spark, rng, shapes):
    a, b = (holey(rng, s) for s in shapes)
    agree(R.asarray(a) @ R.asarray(b), a @ b)


def test_products(spark, rng):
    a, b, c = holey(rng, (3, 4, 5)), holey(rng, (4, 3)), holey(rng, (2, 5, 3), dtype="int32")
    x, y, z = map(R.asarray, (a, b, c))
    agree(R.tensordot(x, y, axes=([1, 0], [0, 1])), np.tensordot(a, b, axes=([1, 0], [0, 1])))
    agree(R.tensordot(x, z, axes=0)[0], np.tensordot(a, c, axes=0)[0])
    agree(R.tensordot(x, y, axes=((1,), (0,)), salt=3), np.tensordot(a, b, axes=((1,), (0,))))
    agree(R.dot(x, z), np.dot(a, c))
    agree(R.vecdot(y, y), np.vecdot(b, b))
    agree(R.kron(y, z), np.kron(b, c))
    agree(R.outer(y, y), np.outer(b, b))
    agree(np.asarray(b) @ R.asarray(b.T), b @ b.T)
    with pytest.raises(ValueError, match="shape-mismatch"):
        R.tensordot(x, y, axes=1)
    with pytest.raises(ValueError):
        R.full((3, 3), 1.0) @ R.full((3, 3), 1.0)


@pytest.mark.parametrize("fill", [-1, 0, 2])
def test_extremes(spark, rng, fill):
    a = holey(rng, (5, 6), dtype="int64", fill=fill)
    a[1] = fill
    a[2] = np.arange(6)
    x = R.from_numpy(a, fill)
    for axis in (None, 0, 1):
        agree(R.argmax(x, axis=axis), a.argmax(axis=axis))
        agree(R.argmin(x, axis=axis), a.argmin(axis=axis))
    agree(R.argmax(x, axis=1, keepdims=True), a.argmax(axis=1, keepdims=True))


def test_extremes_with_nan_and_full_lanes(spark):
    a = np.array([[0.0, np.nan, 3], [-1, -2, -3], [0, 0, 0]])
    for f in ("argmax", "argmin"):
        agree(getattr(R, f)(R.asarray(a), axis=1), getattr(np, f)(a, axis=1))


def test_first_gap_over_blocks(spark, monkeypatch):
    from rarefy.operators import order

    monkeypatch.setattr(order, "GAP_BLOCK", 4)
    a = -np.ones((3, 20))
    a[0, 9] = a[1, 0] = a[2, 8] = 0
    agree(R.argmax(R.asarray(a), axis=1), a.argmax(axis=1))


@pytest.mark.parametrize("fill", [-1, 0, 3])
def test_sort(spark, rng, fill):
    a = holey(rng, (4, 6), fill=fill)
    x = R.from_numpy(a, fill)
    for axis in (0, 1):
        agree(R.sort(x, axis=axis), np.sort(a, axis=axis))
        agree(R.sort(x, axis=axis, descending=True), -np.sort(-a, axis=axis))
    agree(R.sort(x.flatten()), np.sort(a.ravel()))
    with pytest.raises(ValueError):
        R.sort(x, stable=True)


def test_sort_puts_nan_last(spark):
    a = np.array([[0, np.nan, -2, 5, 0]])
    agree(R.sort(R.asarray(a)), np.sort(a))


def test_unique(spark, rng):
    a = holey(rng, (4, 6), dtype="int64")
    values, counts = R.unique_counts(R.asarray(a))
    expected = np.unique(a, return_counts=True)
    assert (values == expected[0]).all() and (counts == expected[1]).all()
    b = np.array([np.nan, 1, np.nan, 0])
    assert len(R.unique_values(R.asarray(b))) == 4


def test_no_loop_over_batches(spark, rng):
    x = R.asarray(holey(rng, (3, 1, 4, 5)))
    y = R.asarray(holey(rng, (2, 5, 3)))
    plan = (x @ y).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
