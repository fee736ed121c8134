"""Indexing: predicates on coordinates, which reach the scans, and joins with index tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import same
from ..tensor import Tensor, normalize_axis
from .elementwise import as_tensor
from .shape import _div

#: An index array above so many entries joins without a broadcast.
BROADCAST_INDEX = 1 << 20


def _expanded(key, ndim: int) -> list:
    """One entry per dimension, with None where a dimension of size 1 is put in."""
    key = list(key) if isinstance(key, tuple) else [key]
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("only one ellipsis")
    used = sum(k is not None and k is not Ellipsis for k in key)
    if used > ndim:
        raise IndexError(f"{used} indices for {ndim} dimensions")
    fill = [slice(None)] * (ndim - used)
    at = next((i for i, k in enumerate(key) if k is Ellipsis), None)
    return [*key[:at], *fill, *key[at + 1 :]] if at is not None else key + fill


def _whole(k, n: int) -> int:
    k = int(k)
    if not -n <= k < n:
        raise IndexError(f"index {k} is out of bounds for size {n}")
    return k + n if k < 0 else k


def _positions(k, n: int) -> np.ndarray:
    """The places of an index array or mask of one dimension."""
    k = np.asarray(k)
    if k.ndim != 1:
        raise IndexError("index arrays have one dimension")
    if k.dtype.kind == "b":
        if len(k) != n:
            raise IndexError(f"a mask of {len(k)} for size {n}")
        return np.flatnonzero(k)
    if k.dtype.kind not in "iu" and len(k):
        raise IndexError("index arrays hold integers or booleans")
    if len(k) and (k.min() < -n or k.max() >= n):
        raise IndexError(f"an index is out of bounds for size {n}")
    return np.where(k < 0, k + n, k).astype(np.int64)


def _slice(k: slice, n: int, c: Column) -> tuple[Column | None, Column, int]:
    """Which coordinates a slice keeps (None: all), what they become, and how many there are."""
    start, stop, step = k.indices(n)
    size = len(range(start, stop, step))
    if (start, stop, step) == (0, n, 1):
        return None, c, n
    if not size:
        return F.lit(False), c, 0
    if step > 0:
        # plain bounds on the column: Parquet can skip by them
        keep = (c >= start) & (c < stop)
        moved = c - F.lit(start)
    else:
        keep = (c <= start) & (c > stop)
        moved = F.lit(start) - c
    if abs(step) > 1:
        keep = keep & (moved % abs(step) == 0)
        moved = _div(moved, abs(step))
    return keep, moved, size


def getitem(x: Tensor, key):
    """NumPy's basic indexing, zipped index arrays and masks, and fields of structured cells.

    A scalar where every dimension is indexed by an integer, without an ellipsis at the end; that
    is the one form that runs a job.
    """
    if isinstance(key, str) or (isinstance(key, list) and key and all(isinstance(k, str) for k in key)):
        return _field(x, key)
    if isinstance(key, Tensor):
        if key.dtype.kind != "b" or key.shape != x.shape:
            raise IndexError("a tensor as index must be a mask of the same shape")
        return _masked(x, key)
    entries = _expanded(key, x.ndim)
    scalar = len([k for k in entries if k is not None]) == x.ndim and all(
        isinstance(k, (int, np.integer)) and not isinstance(k, (bool, np.bool_)) for k in entries
    )
    scalar = scalar and not (isinstance(key, tuple) and any(k is Ellipsis for k in key)) and key is not Ellipsis
    df, where, coords, shape = x.df, [], [], []
    arrays: list[tuple[int, np.ndarray]] = []
    array_at = None
    d = 0
    for k in entries:
        if k is None:
            coords.append(F.lit(0).cast("long"))
            shape.append(1)
            continue
        c, n = F.col(f"d{d}"), x.shape[d]
        if isinstance(k, slice):
            keep, moved, size = _slice(k, n, c)
            if keep is not None:
                where.append(keep)
            coords.append(moved)
            shape.append(size)
        elif isinstance(k, (int, np.integer)) and not isinstance(k, (bool, np.bool_)):
            where.append(c == _whole(k, n))
        else:
            if not arrays:
                array_at = len(coords)
                coords.append(F.col("_pos"))
                shape.append(0)
            arrays.append((d, _positions(k, n)))
        d += 1
    for keep in where:
        df = df.where(keep)
    if arrays:
        sizes = {len(a) for _, a in arrays if len(a) != 1} or {1}
        if len(sizes) > 1:
            raise IndexError("index arrays must be of one length")
        (m,) = sizes
        shape[array_at] = m
        df = _join_index(df, [(i, np.broadcast_to(a, (m,))) for i, a in arrays], m)
    out = x.new(df.select(*(c.cast("long").alias(f"d{i}") for i, c in enumerate(coords)), "v"), shape)
    if scalar:
        row = out.df.take(1)
        if not row:
            return x.fill_value
        v = row[0]["v"]
        return (complex(*v) if x.dtype.kind == "c" else np.asarray(v if not x.dtype.fields else tuple(v), x.dtype)[()])
    return out


def _join_index(df, arrays, m: int):
    """Rows once for each output position whose indices they have."""
    spark = df.sparkSession
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"_pos": np.arange(m), **{f"_i{i}": a for i, a in arrays}})) if m else None
    if table is None:
        return df.where(F.lit(False)).withColumn("_pos", F.lit(0).cast("long"))
    # the table comes from the driver, so its size is known
    table = F.broadcast(table) if m <= BROADCAST_INDEX else table
    on = None
    for i, _ in arrays:
        hit = F.col(f"d{i}") == F.col(f"_i{i}")
        on = hit if on is None else on & hit
    return df.join(table, on)


def _field(x: Tensor, key):
    if not x.dtype.fields:
        raise IndexError("cells have no fields")
    if isinstance(key, list):
        dtype = np.dtype([(k, x.dtype.fields[k][0]) for k in key])
        return Tensor(x.df.withColumn("v", F.struct(*(F.col("v")[k].alias(k) for k in key))), x.shape, 0, dtype)
    inner = x.dtype.fields[key][0]
    if not inner.subdtype:
        return Tensor(x.df.withColumn("v", F.col("v")[key]), x.shape, 0, inner)
    base, sub = inner.subdtype
    df = x.df.select(*x.columns, F.col("v")[key].alias("v"))
    for k in range(len(sub)):
        df = df.select(*x.columns, *(f"d{x.ndim + j}" for j in range(k)), F.posexplode("v").alias(f"d{x.ndim + k}", "v"))
    coords = [F.col(f"d{i}").cast("long").alias(f"d{i}") for i in range(x.ndim + len(sub))]
    return Tensor(df.select(*coords, "v"), (*x.shape, *sub), 0, base).pruned()


def _masked(x: Tensor, mask: Tensor) -> Tensor:
    """The cells under a mask, as a 1-D tensor in C order."""
    from .order import rank

    if mask.fill_value:
        raise IndexError("a mask must be false where nothing is stored")
    chosen = mask.df.where("v").drop("v").join(x.df, x.columns, "left")
    chosen = chosen.select(*x.columns, F.coalesce("v", x.lit()).alias("v"))
    placed, n = rank(chosen, x.shape)
    return x.new(placed.select(F.col("_rank").alias("d0"), "v"), (n,)).pruned()


def take(x, indices, *, axis=None) -> Tensor:
    x = as_tensor(x)
    if axis is None:
        return x.flatten()[np.asarray(indices)]
    axis = normalize_axis(axis, x.ndim)
    return x[(slice(None),) * axis + (np.asarray(indices),)]


def nonzero_df(x):
    """Coordinates of the non-zero cells, as a DataFrame."""
    x = as_tensor(x)
    if not x.ndim:
        raise ValueError("a 0-D tensor has no coordinates")
    if x.fill_value != 0:
        raise ValueError("the fill value must be zero")
    return x.df.where(~same(F.col("v"), 0, x.dtype)).select(*x.columns)


def nonzero(x) -> tuple[np.ndarray, ...]:
    """Driver arrays of coordinates in C order; nonzero_df stays distributed."""
    t = nonzero_df(x).toPandas().to_numpy()
    t = t[np.lexsort(t.T[::-1])] if len(t) else t
    return tuple(t.T.astype(np.int64)) if len(t) else tuple(np.empty(0, np.int64) for _ in range(as_tensor(x).ndim))


def argwhere(a) -> np.ndarray:
    return np.stack(nonzero(a), axis=1)


def _zero_matrix(x) -> Tensor:
    x = as_tensor(x)
    if x.ndim < 2:
        raise ValueError("a matrix has two dimensions at least")
    if x.fill_value != 0:
        raise ValueError("the fill value must be zero")
    return x


def triu(x, k=0) -> Tensor:
    x = _zero_matrix(x)
    return x.new(x.df.where(F.col(f"d{x.ndim - 2}") + F.lit(k) <= F.col(f"d{x.ndim - 1}")))


def tril(x, k=0) -> Tensor:
    x = _zero_matrix(x)
    return x.new(x.df.where(F.col(f"d{x.ndim - 2}") + F.lit(k) >= F.col(f"d{x.ndim - 1}")))


def diagonal(a, offset=0, axis1=0, axis2=1) -> Tensor:
    a = as_tensor(a)
    p, q = normalize_axis((axis1, axis2), a.ndim)
    size = max(0, min(a.shape[p], a.shape[q] - offset) if offset >= 0 else min(a.shape[p] + offset, a.shape[q]))
    kept = [i for i in range(a.ndim) if i not in (p, q)]
    df = a.df.where(F.col(f"d{p}") + F.lit(offset) == F.col(f"d{q}"))
    last = F.col(f"d{p}") - F.lit(max(0, -offset))
    return a.new(df.select(*(F.col(f"d{i}").alias(f"d{j}") for j, i in enumerate(kept)), last.alias(f"d{len(kept)}"), "v"), [*(a.shape[i] for i in kept), size])


def diagonalize(a, axis=0) -> Tensor:
    a = as_tensor(a)
    if a.fill_value != 0:
        raise ValueError("the fill value must be zero")
    axis = normalize_axis(axis, a.ndim)
    return a.new(a.df.withColumn(f"d{a.ndim}", F.col(f"d{axis}")), [*a.shape, a.shape[axis]])


__all__ = ["argwhere", "diagonal", "diagonalize", "getitem", "nonzero", "nonzero_df", "take", "tril", "triu"]
