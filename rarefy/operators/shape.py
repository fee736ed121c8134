"""Shape manipulation: projections of coordinates. Nothing here exchanges rows."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import cast
from ..tensor import Tensor, names, normalize_axis
from .elementwise import as_tensor, elemwise, expand, stored_side_by_side


def _div(a: Column, b: int) -> Column:
    # "/" on longs would go through doubles
    return F.call_function("div", a, F.lit(b).cast("long")) if b != 1 else a


def permute_dims(x, axes=None) -> Tensor:
    x = as_tensor(x)
    axes = tuple(range(x.ndim))[::-1] if axes is None else normalize_axis(tuple(axes), x.ndim)
    if len(axes) != x.ndim:
        raise ValueError("axes must name every dimension once")
    coords = [F.col(f"d{a}").alias(f"d{i}") for i, a in enumerate(axes)]
    layout = {"csr": "csc", "csc": "csr"}.get(x.layout, x.layout) if axes == (1, 0) else "coo" if x.layout in ("csr", "csc") else x.layout
    return x.new(x.df.select(*coords, "v"), tuple(x.shape[a] for a in axes), layout=layout)


def matrix_transpose(x) -> Tensor:
    return as_tensor(x).mT


def moveaxis(a, source, destination) -> Tensor:
    a = as_tensor(a)
    source = [source] if np.isscalar(source) else list(source)
    destination = [destination] if np.isscalar(destination) else list(destination)
    if len(source) != len(destination):
        raise ValueError("source and destination must be of one length")
    source, destination = normalize_axis(tuple(source), a.ndim), normalize_axis(tuple(destination), a.ndim)
    order = [i for i in range(a.ndim) if i not in source]
    for d, s in sorted(zip(destination, source)):
        order.insert(d, s)
    return permute_dims(a, order)


def _linear(shape, columns=None) -> Column:
    """The place of a cell in C order."""
    out = F.lit(0).cast("long")
    for i, n in enumerate(shape):
        c = F.col(f"d{i}") if columns is None else columns[i]
        out = out * F.lit(n).cast("long") + c if i else c
    return out


def _unravel(at: Column, shape) -> list[Column]:
    out, stride = [], math.prod(shape)
    for n in shape:
        stride //= max(n, 1)
        out.append(_div(at, stride) % F.lit(n).cast("long") if n != 1 else F.lit(0).cast("long"))
    return out


def reshape(x, shape, *, order="C", copy=None) -> Tensor:
    x = as_tensor(x)
    if order not in ("C", None):
        raise NotImplementedError("only C order")
    shape = (shape,) if np.isscalar(shape) else tuple(int(s) for s in shape)
    if shape.count(-1) > 1:
        raise ValueError("only one dimension can be -1")
    if -1 in shape:
        rest = -math.prod(shape)
        if rest == 0 or x.size % rest:
            raise ValueError(f"cannot reshape {x.shape} into {shape}")
        shape = tuple(x.size // rest if s == -1 else s for s in shape)
    if math.prod(shape) != x.size:
        raise ValueError(f"cannot reshape {x.shape} into {shape}")
    if shape == x.shape:
        return x
    if x.size >= 1 << 63:
        raise ValueError("cells can't be numbered by 63 bits")
    df = x.df.select(_linear(x.shape).alias("_at"), "v")
    return x.new(df.select(*(c.alias(f"d{i}") for i, c in enumerate(_unravel(F.col("_at"), shape))), "v"), shape)


def resize(x, shape, *, order="C") -> Tensor:
    """Like reshape, but to any size: cells beyond it go, new ones have the fill value."""
    x = as_tensor(x)
    shape = (shape,) if np.isscalar(shape) else tuple(int(s) for s in shape)
    size = math.prod(shape)
    df = x.df.select(_linear(x.shape).alias("_at"), "v").where(F.col("_at") < size)
    return x.new(df.select(*(c.alias(f"d{i}") for i, c in enumerate(_unravel(F.col("_at"), shape))), "v"), shape)


def squeeze(x, axis=None) -> Tensor:
    x = as_tensor(x)
    if axis is None:
        axis = tuple(i for i, n in enumerate(x.shape) if n == 1)
    axis = normalize_axis(axis if isinstance(axis, tuple) else (axis,), x.ndim)
    if any(x.shape[i] != 1 for i in axis):
        raise ValueError("only dimensions of size 1 can go")
    kept = [i for i in range(x.ndim) if i not in axis]
    return x.new(x.df.select(*(F.col(f"d{i}").alias(f"d{j}") for j, i in enumerate(kept)), "v"), [x.shape[i] for i in kept])


def expand_dims(x, axis=0) -> Tensor:
    x = as_tensor(x)
    axis = axis if isinstance(axis, tuple) else (axis,)
    n = x.ndim + len(axis)
    axis = normalize_axis(axis, n)
    old = iter(range(x.ndim))
    coords, shape = [], []
    for i in range(n):
        if i in axis:
            coords.append(F.lit(0).cast("long").alias(f"d{i}"))
            shape.append(1)
        else:
            j = next(old)
            coords.append(F.col(f"d{j}").alias(f"d{i}"))
            shape.append(x.shape[j])
    return x.new(x.df.select(*coords, "v"), shape)


def broadcast_to(x, shape) -> Tensor:
    x = as_tensor(x)
    shape = tuple(shape)
    if np.broadcast_shapes(x.shape, shape) != shape:
        raise ValueError(f"{x.shape} can't be broadcast to {shape}")
    return x.new(expand(x, shape), shape)


def broadcast_arrays(*arrays) -> tuple[Tensor, ...]:
    arrays = [as_tensor(a) for a in arrays]
    shape = np.broadcast_shapes(*(a.shape for a in arrays))
    return tuple(broadcast_to(a, shape) for a in arrays)


def _one_fill(arrays: list[Tensor]):
    first = arrays[0].fill_value
    for a in arrays[1:]:
        if not (a.fill_value == first or (a.fill_value != a.fill_value and first != first)):
            raise ValueError("the fill values differ")
    return first


def _joined(arrays: list[Tensor], shifted: list[DataFrame], shape, placed: Callable[[DataFrame], DataFrame]) -> Tensor:
    """The tensors' shifted rows; placed does the same to rows of all of them, with the number of their tensor."""
    dtype = np.result_type(*(a.dtype for a in arrays))
    if (rows := stored_side_by_side(arrays, dtype)) is not None:
        return Tensor(placed(rows).select(*names(len(shape)), "v"), shape, _one_fill(arrays), dtype)
    parts = [df.withColumn("v", cast(F.col("v"), a.dtype, dtype)) for a, df in zip(arrays, shifted)]
    return Tensor(functools.reduce(DataFrame.unionByName, parts), shape, _one_fill(arrays), dtype)


def concat(arrays, axis=0, compressed_axes=None) -> Tensor:
    arrays = [as_tensor(a) for a in arrays]
    if axis is None:
        arrays, axis = [a.flatten() for a in arrays], 0
    axis = normalize_axis(axis, arrays[0].ndim)
    rest = [tuple(s for i, s in enumerate(a.shape) if i != axis) for a in arrays]
    if any(r != rest[0] for r in rest) or any(a.ndim != arrays[0].ndim for a in arrays):
        raise ValueError("all dimensions but the joined one must agree")
    starts = np.cumsum([0] + [a.shape[axis] for a in arrays])
    shifted = [a.df.withColumn(f"d{axis}", F.col(f"d{axis}") + F.lit(int(s))) for a, s in zip(arrays, starts)]
    shape = list(arrays[0].shape)
    shape[axis] = int(starts[-1])
    start = F.element_at(F.array(*(F.lit(int(s)).cast("long") for s in starts[:-1])), F.col("_part") + 1)
    return _joined(arrays, shifted, shape, lambda rows: rows.withColumn(f"d{axis}", F.col(f"d{axis}") + start))


def stack(arrays, axis=0, compressed_axes=None) -> Tensor:
    arrays = [as_tensor(a) for a in arrays]
    if any(a.shape != arrays[0].shape for a in arrays):
        raise ValueError("all shapes must agree")
    axis = normalize_axis(axis, arrays[0].ndim + 1)
    wide = [expand_dims(a, axis) for a in arrays]
    shifted = [a.df.withColumn(f"d{axis}", F.lit(k).cast("long")) for k, a in enumerate(wide)]
    shape = list(wide[0].shape)
    shape[axis] = len(arrays)
    coords = [F.col("_part").cast("long").alias(f"d{i}") if i == axis else F.col(f"d{i - (i > axis)}").alias(f"d{i}") for i in range(len(shape))]
    return _joined(arrays, shifted, shape, lambda rows: rows.select(*coords, "v"))


def unstack(x, axis=0) -> tuple[Tensor, ...]:
    x = as_tensor(x)
    axis = normalize_axis(axis, x.ndim)
    return tuple(x[(slice(None),) * axis + (k,)] for k in range(x.shape[axis]))


def roll(a, shift, axis=None) -> Tensor:
    a = as_tensor(a)
    if axis is None:
        return roll(a.flatten(), shift, 0).reshape(a.shape)
    axis = axis if isinstance(axis, tuple) else (axis,)
    shift = shift if isinstance(shift, (tuple, list)) else (shift,) * len(axis)
    axis = [normalize_axis(i, a.ndim) for i in axis] * (len(shift) if len(axis) == 1 else 1)
    if len(shift) != len(axis):
        raise ValueError("shift and axis must be of one length")
    df = a.df
    for i, s in zip(axis, shift):
        if a.shape[i]:
            df = df.withColumn(f"d{i}", F.pmod(F.col(f"d{i}") + F.lit(int(s)), F.lit(a.shape[i]).cast("long")))
    return a.new(df)


def flip(x, *, axis=None) -> Tensor:
    x = as_tensor(x)
    axis = normalize_axis(tuple(range(x.ndim)) if axis is None else axis if isinstance(axis, tuple) else (axis,), x.ndim)
    coords = [(F.lit(x.shape[i] - 1) - F.col(f"d{i}") if i in axis else F.col(f"d{i}")).cast("long").alias(f"d{i}") for i in range(x.ndim)]
    return x.new(x.df.select(*coords, "v"))


def pad(array, pad_width, mode="constant", **kwargs) -> Tensor:
    x = as_tensor(array)
    value = kwargs.pop("constant_values", x.fill_value)
    if mode != "constant" or kwargs:
        raise NotImplementedError("only the mode 'constant'")
    if not np.all(np.asarray(value) == x.fill_value) and not np.isnan(x.fill_value):
        raise ValueError("padding must have the fill value")
    width = np.broadcast_to(np.asarray(pad_width), (x.ndim, 2))
    if (width < 0).any():
        raise ValueError("padding can't be negative")
    coords = [(F.col(f"d{i}") + F.lit(int(width[i, 0]))).alias(f"d{i}") for i in range(x.ndim)]
    return x.new(x.df.select(*coords, "v"), [n + int(w.sum()) for n, w in zip(x.shape, width)])


def _times(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.crossJoin(df.sparkSession.range(n).select(F.col("id").alias(name)))


def repeat(a, repeats, axis=None) -> Tensor:
    a = as_tensor(a)
    if not np.isscalar(repeats):
        raise ValueError("repeats must be an integer")
    if axis is None:
        a, axis = a.flatten(), 0
    axis = normalize_axis(axis, a.ndim)
    df = _times(a.df, int(repeats), "_k").withColumn(f"d{axis}", F.col(f"d{axis}") * F.lit(int(repeats)) + F.col("_k"))
    return a.new(df, [n * repeats if i == axis else n for i, n in enumerate(a.shape)])


def tile(a, reps) -> Tensor:
    a = as_tensor(a)
    reps = (reps,) if np.isscalar(reps) else tuple(reps)
    n = max(a.ndim, len(reps))
    if a.ndim < n:
        a = a.reshape((1,) * (n - a.ndim) + a.shape)
    reps = (1,) * (n - len(reps)) + reps
    df = a.df
    for i, r in enumerate(reps):
        if r != 1:
            df = _times(df, r, "_k").withColumn(f"d{i}", F.col("_k") * F.lit(a.shape[i]) + F.col(f"d{i}")).drop("_k")
    return a.new(df, [s * r for s, r in zip(a.shape, reps)])


def diff(x, axis=-1, n=1, prepend=None, append=None) -> Tensor:
    """Differences of neighbours along an axis: implicit neighbours have the fill value."""
    x = as_tensor(x)
    axis = normalize_axis(axis, x.ndim)
    parts = [p for p in (prepend, x, append) if p is not None]
    x = concat(parts, axis) if len(parts) > 1 else x
    if n < 0:
        raise ValueError("n can't be negative")
    for _ in range(n):
        head = (slice(None),) * axis
        x = elemwise("not_equal" if x.dtype.kind == "b" else "subtract", x[(*head, slice(1, None))], x[(*head, slice(None, -1))])
    return x


__all__ = [
    "broadcast_arrays", "broadcast_to", "concat", "diff", "expand_dims", "flip", "matrix_transpose", "moveaxis", "pad",
    "permute_dims", "repeat", "reshape", "resize", "roll", "squeeze", "stack", "tile", "unstack",
]
