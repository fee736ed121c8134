"""Constructors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import literal, numpy_type, python_value, spark_type
from ..plans import layout as layouts
from ..tensor import Tensor, names


#: Rounds of the permutation behind random, and how often it is repeated at most.
ROUNDS, CYCLE = 6, 64


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def schema(ndim: int, dtype) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names(ndim)] + [T.StructField("v", spark_type(dtype))])


def _frame(coords: np.ndarray, data: np.ndarray) -> DataFrame:
    """Driver arrays as rows, by Arrow where the values allow."""
    kind = schema(len(coords), data.dtype)
    if data.dtype.kind == "c" or data.dtype.fields or data.dtype.name == "uint64":
        from decimal import Decimal

        def value(x):
            if data.dtype.fields:
                return tuple(f.tolist() if isinstance(f, np.ndarray) else f.item() for f in x)
            return Decimal(int(x)) if data.dtype.name == "uint64" else python_value(x)

        rows = [(*map(int, c), value(x)) for c, x in zip(coords.T, data)] if len(coords) else [(value(x),) for x in data]
        return session().createDataFrame(rows, kind)
    wide = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}.get(data.dtype.name, data.dtype.name)
    return session().createDataFrame(pd.DataFrame({**{c: coords[i] for i, c in enumerate(names(len(coords)))}, "v": data.astype(wide)}), kind)


def coo(coords, data=None, shape=None, has_duplicates=True, sorted=False, prune=False, cache=False, fill_value=None, idx_dtype=None) -> Tensor:  # noqa: A002
    """From coordinates (ndim, nnz) and values on the driver; repeated coordinates are summed."""
    if data is None:
        return as_coo(coords, shape=shape, fill_value=fill_value)
    coords = np.asarray(coords)
    coords = coords[None, :] if coords.ndim == 1 else coords
    if coords.size and coords.dtype.kind not in "iu":
        if not np.array_equal(coords, coords.astype(np.int64)):
            raise ValueError("coordinates must be integers")
    coords = coords.astype(np.int64)
    data = np.asarray(data)
    data = np.broadcast_to(data, coords.shape[1:]) if data.ndim == 0 else data
    if data.shape != coords.shape[1:]:
        raise ValueError("as many values as coordinates are needed")
    if shape is None:
        raise ValueError("shape must be given")
    shape = (shape,) if np.isscalar(shape) else tuple(shape)
    if len(shape) != len(coords):
        raise ValueError(f"{len(coords)} rows of coordinates for {len(shape)} dimensions")
    if coords.size and ((coords < 0).any() or (coords >= np.array(shape)[:, None]).any()):
        raise ValueError("a coordinate lies outside the shape")
    out = Tensor(_frame(coords, data), shape, 0 if fill_value is None else fill_value, data.dtype)
    if has_duplicates and not data.dtype.fields:
        out = out.summed()
    out = out.pruned() if prune else out
    return out.enable_caching() if cache else out


def from_df(df: DataFrame, coords: list[str], value, shape, fill_value=0, dtype=None, has_duplicates=True, prune=False, cells=None) -> Tensor:
    """From a table: columns (or expressions) as coordinates and one as value. Nothing is collected.

    has_duplicates: sum the values of repeated coordinates; False where they are known not to repeat.
    cells: about how many rows there are, where that is known.
    """
    value = F.col(value) if isinstance(value, str) else value
    out = df.select(*((F.col(c) if isinstance(c, str) else c).cast("long").alias(f"d{i}") for i, c in enumerate(coords)), value.alias("v"))
    dtype = np.dtype(dtype) if dtype is not None else numpy_type(out.schema["v"].dataType)
    t = Tensor(out.withColumn("v", F.col("v").cast(spark_type(dtype))), shape, fill_value, dtype, cells=cells)
    t = t.summed() if has_duplicates else t
    return t.pruned() if prune else t


def from_array_column(df: DataFrame, row: str, array: str, width: int, rows: int, dtype=None) -> Tensor:
    """A dense operand from an array column: one row of the matrix per table row."""
    out = df.select(F.col(row).cast("long").alias("d0"), F.posexplode(array).alias("d1", "v"))
    dtype = np.dtype(dtype) if dtype is not None else numpy_type(out.schema["v"].dataType)
    return Tensor(out.withColumn("d1", F.col("d1").cast("long")), (rows, width), 0, dtype).pruned()


def from_numpy(x, fill_value=None, idx_dtype=None) -> Tensor:
    x = np.asarray(x)
    fill = np.zeros((), x.dtype)[()] if fill_value is None else np.asarray(fill_value).astype(x.dtype)[()]
    if x.dtype.fields:
        kept = np.array([any(np.any(v[f]) for f in x.dtype.names) for v in x.ravel()], bool).reshape(x.shape)
    else:
        kept = ~((x == fill) | ((x != x) & (fill != fill)))
    at = np.nonzero(np.atleast_1d(kept))
    coords = np.array(at, np.int64).reshape(len(at), -1)
    return Tensor(_frame(coords[: x.ndim] if x.ndim else np.empty((0, 0), np.int64), np.atleast_1d(x)[at]), x.shape, fill, x.dtype)


def from_iter(x, shape=None, fill_value=None, dtype=None) -> Tensor:
    """A dict, (coordinate, value) pairs, or (values, coordinates)."""
    if isinstance(x, dict):
        x = list(x.items())
    x = list(x)
    if len(x) == 2 and isinstance(x[0], (list, np.ndarray)) and not np.isscalar(x[0]) and len(x[1]) and len(np.shape(x[1])) == 2:
        values, at = x
    else:
        at, values = [np.atleast_1d(k) for k, _ in x], [v for _, v in x]
    values = np.asarray(values, dtype)
    if shape is None:
        raise ValueError("shape must be given")
    shape = (shape,) if np.isscalar(shape) else tuple(shape)
    coords = np.asarray(at, np.int64).reshape(-1, len(shape)).T if len(x) else np.empty((len(shape), 0), np.int64)
    return coo(coords, values, shape, fill_value=fill_value)


def as_coo(x, shape=None, fill_value=None, idx_dtype=None) -> Tensor:
    if hasattr(x, "shape") and shape is not None and tuple(x.shape) != tuple(shape):
        raise ValueError("the shape differs")
    if isinstance(x, Tensor):
        if fill_value is not None and fill_value != x.fill_value:
            raise ValueError("the fill value differs")
        return layouts.asformat(x, "coo")
    if isinstance(x, layouts.DOK):
        return x.to_coo()
    if hasattr(x, "tocoo") and hasattr(x, "toarray"):
        from .io import from_scipy

        return from_scipy(x, fill_value)
    if isinstance(x, np.ndarray) or np.isscalar(x):
        return from_numpy(x, fill_value)
    return from_iter(x, shape, fill_value)


def asCOO(x, name="asCOO", check=True) -> Tensor:  # noqa: N802
    if check and not isinstance(x, (Tensor, layouts.DOK)) and not hasattr(x, "tocoo"):
        raise ValueError(f"performing this operation would produce a dense result: {name}")
    return as_coo(x)


def asarray(obj, /, *, dtype=None, format="coo", copy=False, device=None):  # noqa: A002
    if device not in (None, "cpu"):
        raise ValueError("there is only the device 'cpu'")
    if isinstance(obj, (list, tuple, int, float, complex, bool)):
        obj = np.asarray(obj)
    out = as_coo(obj) if not isinstance(obj, Tensor) else obj
    if dtype is not None and np.dtype(dtype) != out.dtype:
        out = out.astype(dtype)
    return layouts.asformat(out, layouts.format_to_string(format))


def _cells(df: DataFrame, coords, value, dtype) -> DataFrame:
    return df.select(*(c.cast("long").alias(f"d{i}") for i, c in enumerate(coords)), literal(value, dtype).alias("v"))


def eye(N, M=None, k=0, dtype=float, format="coo", *, device=None):  # noqa: A002, N803
    M = N if M is None else M  # noqa: N806
    n = max(0, min(N, M - k) if k >= 0 else min(N + k, M))
    i = F.col("id")
    df = _cells(session().range(n), [i + F.lit(max(0, -k)), i + F.lit(max(0, k))], 1, dtype)
    return layouts.asformat(Tensor(df, (N, M), 0, dtype), layouts.format_to_string(format))


def full(shape, fill_value, dtype=None, format="coo", order="C", *, device=None):  # noqa: A002
    """No stored cell: everything has the fill value."""
    if order not in ("C", None):
        raise NotImplementedError("only C order")
    shape = (shape,) if np.isscalar(shape) else tuple(shape)
    dtype = np.dtype(dtype) if dtype is not None else np.asarray(fill_value).dtype
    df = session().createDataFrame([], schema(len(shape), dtype))
    return layouts.asformat(Tensor(df, shape, fill_value, dtype), layouts.format_to_string(format))


def full_like(a, fill_value, dtype=None, shape=None, format=None, *, device=None, **kwargs):  # noqa: A002
    a = a if isinstance(a, (Tensor, layouts.DOK)) else np.asarray(a)
    kept = getattr(a, "format", "coo")
    return full(a.shape if shape is None else shape, fill_value, a.dtype if dtype is None else dtype, format or kept)


def zeros(shape, dtype=float, format="coo", *, device=None, **kwargs):  # noqa: A002
    return full(shape, 0, np.dtype(dtype or float), format)


def ones(shape, dtype=float, format="coo", *, device=None, **kwargs):  # noqa: A002
    return full(shape, 1, np.dtype(dtype or float), format)


def zeros_like(a, dtype=None, shape=None, format=None, *, device=None, **kwargs):  # noqa: A002
    return full_like(a, 0, dtype, shape, format)


def ones_like(a, dtype=None, shape=None, format=None, *, device=None, **kwargs):  # noqa: A002
    return full_like(a, 1, dtype, shape, format)


empty, empty_like = zeros, zeros_like


def _scatter(i, n: int, seed: int):
    """A pseudorandom permutation of range(n), evaluated row by row.

    A Feistel network over a grid of a columns and b rows, with a * b just above n: each round moves
    a row by a hash of its column and a column by a hash of its row. What lands beyond n is permuted
    again until it lies within; at most a cells lie beyond, so up to 4,096 cells CYCLE rounds always
    do, and above that a place needs them with a probability below (1/64) ** CYCLE.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    keys = F.lit(np.random.default_rng(seed).integers(1 << 62, size=ROUNDS).tolist()).cast("array<bigint>")
    columns, rows, end = (F.lit(m).cast("long") for m in (a, b, n))

    def permuted(at):
        def one_round(s, k):
            x = F.pmod(s["x"] + F.pmod(F.xxhash64(s["y"], k), columns), columns)
            return F.struct(x.alias("x"), F.pmod(s["y"] + F.pmod(F.xxhash64(x, k + 1), rows), rows).alias("y"))

        start = F.struct((at % columns).alias("x"), F.call_function("div", at, columns).alias("y"))
        return F.aggregate(keys, start, one_round, lambda s: s["y"] * columns + s["x"])

    # the cells of the grid beyond n are walked over
    walk = F.sequence(F.lit(1), F.lit(CYCLE))
    return F.aggregate(walk, permuted(i), lambda at, _: F.when(at < end, at).otherwise(permuted(at)))


def random(shape, density=None, nnz=None, random_state=None, data_rvs=None, format="coo", fill_value=None, idx_dtype=None, **kwargs):  # noqa: A002
    """Exactly nnz cells at distinct, uniformly drawn places, made where they are stored; the same seed gives the same tensor.

    data_rvs: a driver function n -> values; without it values are uniform in [0, 1).
    """
    shape = (shape,) if np.isscalar(shape) else tuple(shape)
    size = math.prod(shape)
    if density is not None and nnz is not None:
        raise ValueError("density and nnz exclude each other")
    if nnz is None:
        density = 0.01 if density is None else density
        if not 0 <= density <= 1:
            raise ValueError("density lies between 0 and 1")
        nnz = int(size * density)
    if not 0 <= nnz <= size:
        raise ValueError(f"nnz lies between 0 and {size}")
    seed = random_state if isinstance(random_state, (int, np.integer)) else int((random_state or np.random.default_rng()).integers(1 << 31))
    from ..operators.shape import _unravel

    at = session().range(nnz).select("id", _scatter(F.col("id"), max(size, 1), seed).alias("_at"))
    coords = [c.alias(f"d{i}") for i, c in enumerate(_unravel(F.col("_at"), shape))]
    if data_rvs is None:
        # from the place itself, so that it doesn't depend on partitions
        v = F.shiftrightunsigned(F.xxhash64("_at", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
        df, dtype = at.select(*coords, v.alias("v")), np.dtype("float64")
    else:
        data = np.asarray(data_rvs(nnz))
        dtype = data.dtype
        values = _frame(np.arange(nnz, dtype=np.int64)[None, :], data).withColumnRenamed("d0", "id")
        df = at.join(values, "id").select(*coords, "v")
    return layouts.asformat(Tensor(df, shape, 0 if fill_value is None else fill_value, dtype), layouts.format_to_string(format))


def random_value_array(value, fraction: float):
    """A data_rvs with a share of one special value."""

    def values(n):
        out = np.random.default_rng(42).random(n)
        out[: int(n * fraction)] = value
        return out

    return values
