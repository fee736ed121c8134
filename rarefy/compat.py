"""Names that code written for other array libraries calls, in one place; they add nothing of their own."""

from __future__ import annotations

import importlib

import numpy as np

from .plans.layout import DOK
from .tensor import Tensor


def scipy_matrix(coords: np.ndarray, data: np.ndarray, shape):
    """SciPy's own triplet form."""
    return importlib.import_module("scipy.sparse").coo_matrix((data, tuple(coords)), shape=shape)


def attach(api: dict) -> None:
    """Adds the names to the classes and to the public module."""
    from .sources.io import from_scipy, to_scipy

    api["SparseArray"] = Tensor
    Tensor.to_scipy_sparse = to_scipy
    DOK.from_scipy_sparse = classmethod(lambda cls, x, /, *, fill_value=None: cls.from_coo(from_scipy(x, fill_value)))
    api["_Format"].from_scipy_sparse = lambda self, x, /, *, fill_value=None: self._as(from_scipy(x, fill_value), None) if self._format != "coo" else from_scipy(x, fill_value)
