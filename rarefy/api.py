"""The public names.

They follow the Python array API. A function of tensors returns a tensor, which is a plan;
what returns driver arrays (todense, nonzero, unique_values, …) says so.
"""

from __future__ import annotations

import numpy as _np
from numpy import (  # noqa: F401
    bool_ as bool,  # noqa: A004
    complex64,
    complex128,
    e,
    finfo,
    float16,
    float32,
    float64,
    iinfo,
    inf,
    int8,
    int16,
    int32,
    int64,
    isdtype,
    nan,
    newaxis,
    pi,
    uint8,
    uint16,
    uint32,
    uint64,
)

from .functions import registry as _registry
from .operators.elementwise import astype, clip, elemwise, interp, round, side_by_side, where  # noqa: A004, F401
from .operators.index import argwhere, diagonal, diagonalize, nonzero, take, tril, triu  # noqa: F401
from .operators.linalg import dot, einsum, kron, matmul, outer, tensordot, vecdot  # noqa: F401
from .operators.order import argmax, argmin, sort, unique_counts, unique_values  # noqa: F401
from .operators.reduce import (  # noqa: A004, F401
    all,
    any,
    max,
    mean,
    min,
    nanmax,
    nanmean,
    nanmin,
    nanprod,
    nanreduce,
    nansum,
    prod,
    std,
    sum,
    var,
)
from .operators.shape import (  # noqa: F401
    broadcast_arrays,
    broadcast_to,
    concat,
    diff,
    expand_dims,
    flip,
    matrix_transpose,
    moveaxis,
    pad,
    permute_dims,
    repeat,
    reshape,
    resize,
    roll,
    squeeze,
    stack,
    tile,
    unstack,
)
from .plans.layout import DOK, asformat, format_to_string  # noqa: F401
from .sources.create import (  # noqa: F401
    as_coo,
    asarray,
    asCOO,
    coo,
    empty,
    empty_like,
    eye,
    from_array_column,
    from_df,
    from_iter,
    from_numpy,
    full,
    full_like,
    ones,
    ones_like,
    random,
    zeros,
    zeros_like,
)
from .sources.io import (  # noqa: F401
    asnumpy,
    from_constituent_arrays,
    from_scipy,
    load_npz,
    load_parquet,
    save_npz,
    save_parquet,
)
from .tensor import Tensor

concatenate, transpose = concat, permute_dims


def _function(name):
    def call(*args, dtype=None, out=None):
        result = elemwise(name, *args, dtype=dtype)
        if out is not None:
            out.__dict__.update(result.__dict__)
            return out
        return result

    call.__name__ = name
    call.__doc__ = f"numpy.{_registry.REGISTRY[name].numpy.__name__} of every cell."
    return call


globals().update({name: _function(name) for name in _registry.REGISTRY})
bitwise_not = bitwise_invert  # noqa: F821


def nextafter(x1, x2):
    """Adjacent floats; an Arrow-batched function, as SQL has none."""
    return elemwise(_np.nextafter, x1, x2)


class _Format:
    """A format as a callable: COO(coords, data, shape), GCXS(tensor or array), CSR(…), CSC(…)."""

    def __init__(self, name):
        self.__name__ = name.upper()
        self._format = name

    def __call__(self, arg, *args, compressed_axes=None, prune=False, shape=None, fill_value=None, **kwargs):
        if self._format == "coo":
            return coo(arg, *args, shape=shape, prune=prune, fill_value=fill_value, **kwargs)
        if isinstance(arg, tuple) and len(arg) == 3:
            x = self._from_buffers(arg, args[0] if args else shape, compressed_axes, fill_value)
        else:
            x = as_coo(arg, fill_value=fill_value)
        x = x.pruned() if prune else x
        more = {"compressed_axes": compressed_axes} if self._format == "gcxs" else {}
        return asformat(x, self._format, **more)

    def _from_buffers(self, arrays, shape, compressed_axes, fill_value):
        data, indices, indptr = map(_np.asarray, arrays)
        axes = {"csr": (0,), "csc": (1,)}.get(self._format) or tuple(_np.atleast_1d(0 if compressed_axes is None else compressed_axes))
        rest = [i for i in range(len(shape)) if i not in axes]
        rows = _np.repeat(_np.arange(len(indptr) - 1), _np.diff(indptr))
        coords = _np.zeros((len(shape), len(data)), _np.int64)
        coords[list(axes)] = _np.unravel_index(rows, [shape[i] for i in axes])
        coords[rest] = _np.unravel_index(indices, [shape[i] for i in rest])
        return coo(coords, data, shape, fill_value=fill_value)

    def from_numpy(self, x, fill_value=None, compressed_axes=None, idx_dtype=None):
        return self._as(from_numpy(x, fill_value), compressed_axes)

    def from_coo(self, x, compressed_axes=None, idx_dtype=None):
        return self._as(x, compressed_axes)

    def from_iter(self, x, shape=None, fill_value=None, dtype=None, compressed_axes=None):
        return self._as(from_iter(x, shape, fill_value, dtype), compressed_axes)

    def _as(self, x, compressed_axes):
        return asformat(x, self._format, **({"compressed_axes": compressed_axes} if self._format == "gcxs" else {}))


COO, GCXS, CSR, CSC = map(_Format, ("coo", "gcxs", "csr", "csc"))


def can_cast(from_, to, /, *, casting="safe"):
    return _np.can_cast(from_.dtype if isinstance(from_, (Tensor, DOK)) else from_, to, casting)


def result_type(*arrays_and_dtypes):
    return _np.result_type(*(a.dtype if isinstance(a, (Tensor, DOK)) else a for a in arrays_and_dtypes))


def broadcast_shapes(*shapes):
    return _np.broadcast_shapes(*shapes)


def equivalent(x, y, loose=False):
    """Equal values; NaN equals NaN. Strictly, zeros of different sign differ."""
    x, y = _np.asarray(x), _np.asarray(y)
    same = (x == y) | ((x != x) & (y != y))
    return same if loose else same & (_np.signbit(x) == _np.signbit(y) if x.dtype.kind == "f" else True)


def check_zero_fill_value(*args, loose=True):
    for a in args:
        if getattr(a, "size", 1) and hasattr(a, "fill_value") and not equivalent(a.fill_value, _np.zeros((), a.dtype), loose):
            raise ValueError("this operation needs fill values of zero")


def check_consistent_fill_value(arrays):
    arrays = list(arrays)
    if not arrays or any_(not isinstance(a, (Tensor, DOK)) for a in arrays):
        raise ValueError("tensors are needed")
    for a in arrays[1:]:
        if not equivalent(a.fill_value, arrays[0].fill_value, loose=True):
            raise ValueError("the fill values differ")


def any_(items):
    return next((True for i in items if i), False)


compute = lambda x: x.enable_caching() if isinstance(x, Tensor) else x
"""Plans are lazy; this keeps the rows once an action has made them."""
lazy = lambda x: x
__array_api_version__ = "2024.12"


class _Info:
    """What the array API asks of a namespace."""

    def capabilities(self):
        return {"boolean indexing": True, "data-dependent shapes": True, "max dimensions": 64}

    def default_device(self):
        return "cpu"

    def devices(self):
        return ["cpu"]

    def default_dtypes(self, *, device=None):
        return {"real floating": _np.dtype("float64"), "complex floating": _np.dtype("complex128"), "integral": _np.dtype("int64"), "indexing": _np.dtype("int64")}

    def dtypes(self, *, device=None, kind=None):
        names = "bool int8 int16 int32 int64 uint8 uint16 uint32 uint64 float32 float64 complex64 complex128".split()
        return {n: _np.dtype(n) for n in names if kind is None or isdtype(_np.dtype(n), kind)}


def __array_namespace_info__():
    return _Info()


from . import compat as _compat  # noqa: E402

_compat.attach(globals())
