"""Products by tiles against NumPy, with tiles and pieces so small that every branch is taken."""

import numpy as np
import pytest
import rarefy as R
from rarefy.operators import linalg
from rarefy.plans import tiles

from .conftest import agree, holey


@pytest.fixture
def tiled(monkeypatch):
    monkeypatch.setattr(linalg, "TILED_PAIRS", 0)
    monkeypatch.setattr(linalg, "TILED_PLACES", 0)
    monkeypatch.setattr(linalg, "TILED_RATIO", 0)


def _run(a, b, bits, dtype="int64", wraps=False, size=7):
    """_tiles over the cells of two matrices, dealt as the plan deals them."""
    import pyarrow as pa

    rows = []
    for right, x in ((False, a), (True, b.T)):
        other = b if not right else a.T
        for at, k in zip(*np.nonzero(x)):
            for block in {int(o) >> bits for o in np.flatnonzero(other[k])}:
                i, j = (int(at) >> bits, block) if not right else (block, int(at) >> bits)
                rows.append((i, j, int(k), right, int(at) & ((1 << bits) - 1), x[at, k]))
    rows.sort(key=lambda r: r[:4])
    columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int64()] * 3 + [pa.bool_(), pa.int32(), pa.from_numpy_dtype(a.dtype)])]
    table = pa.RecordBatch.from_arrays(columns, ["i", "j", "k", "right", "at", "v"])
    out = np.zeros((a.shape[0], b.shape[1]), dtype)
    for batch in tiles._tiles(iter([table.slice(n, size) for n in range(0, len(rows), size)]), bits, np.dtype(dtype), wraps):
        i, j, v = (c.to_numpy() for c in batch.columns)
        assert (out[i, j] == 0).all() and (v != 0).all()
        out[i, j] = v
    return out


@pytest.mark.parametrize("piece,pairs,inner,listed,dense", [(1, 1, 2, 1 << 20, 0), (50, 3, 2, 8, 0), (50, 1 << 20, 2, 8, 1 << 40), (1 << 20, 1 << 20, 512, 1 << 20, 100)])
def test_every_branch(monkeypatch, rng, piece, pairs, inner, listed, dense):
    for name, value in {"PIECE": piece, "PAIRS": pairs, "INNER": inner, "LISTED": listed, "DENSE": dense}.items():
        monkeypatch.setattr(tiles, name, value)
    for dtype in ("int64", "float64"):
        a, b = holey(rng, (23, 31), 0.4, dtype), holey(rng, (31, 19), 0.5, dtype)
        np.testing.assert_allclose(_run(a, b, 3, dtype), a @ b, rtol=1e-12, atol=1e-12)
    odd = np.array([[np.inf, 0, 2.0]] * 20)
    # an implicit zero annihilates what isn't finite
    np.testing.assert_array_equal(_run(odd, np.array([[1.0, 0.0], [np.nan, 0.0], [0.0, 3.0]]), 3, "float64"), [[np.inf, 6.0]] * 20)


def test_large_integers(monkeypatch):
    a, b = np.array([[3_000_000_001, 7]] * 9), np.array([[1_000_000_007], [5]])
    for listed in (1, 1 << 20):
        monkeypatch.setattr(tiles, "LISTED", listed)
        assert (_run(a, b, 3) == a @ b).all()
        with pytest.raises(ArithmeticError):
            _run(a * 4, b, 3)
        assert (_run(a * 4, b, 3, wraps=True) == (a * 4) @ b).all()
    monkeypatch.setattr(tiles, "DENSE", 1 << 40)
    big = np.full((16, 4), (1 << 27) + 1)
    assert (_run(big, big.T.copy(), 4) == big @ big.T).all()


def test_products(spark, rng, tiled):
    a, b = holey(rng, (60, 40), 0.3, "int64"), holey(rng, (40, 50), 0.3, "int64")
    x, y = R.asarray(a), R.asarray(b)
    found = x @ y
    assert "MapInArrow" in found.df._jdf.queryExecution().toString()
    agree(found, a @ b)
    agree(x.astype("float32") @ y.astype("float32"), a.astype("float32") @ b.astype("float32"))
    c = holey(rng, (6, 7, 8), 0.4, "float64")
    d = holey(rng, (7, 8, 9), 0.4, "float64")
    agree(R.tensordot(R.asarray(c), R.asarray(d), 2), np.tensordot(c, d, 2))
    agree(R.einsum("ijk,jlm->ikml", R.asarray(c), R.asarray(c.transpose(1, 0, 2).copy())), np.einsum("ijk,jlm->ikml", c, c.transpose(1, 0, 2)))
